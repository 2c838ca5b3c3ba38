"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), 4096, 1)


@query("op10_token_binary")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=2))


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_quality_fm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_toxicity_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_progressive_media")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


@query("op8_minmax_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _op6_oracle() -> str:
    from .decontaminate import ORACLE

    return ORACLE


@query("op6_benchmark_decontamination", _op6_oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_hits

    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_compact_window_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op5_warc_derivatives")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivative_digests

    return derivative_digests(table(spark, sf_dir, "pages"))
