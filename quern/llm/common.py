"""Helpers shared by the training-data operators: words, shared storage, links."""

from __future__ import annotations

import ctypes
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import traverse
from quern.session import bounded, cleanup, discard, materialise, salted_join, shared_dir, ship  # noqa: F401 - used by the operators as common.*

#: Byte map for the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z lower-cased:
#: separators become blanks, bytes of non-ASCII characters stay.
AZ_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
#: Byte map that lower-cases A-Z only; ``bytes.split()`` then yields the words ``[^\x20\x09-\x0D]+``.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

def az_words(text: bytes) -> list[bytes]:
    """Words made of digits, lower-cased ASCII letters and non-ASCII characters."""
    return text.translate(AZ_TABLE).split()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames no longer referenced; a frame held in a variable keeps its own."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def shrink_executors(spark: SparkSession) -> None:
    """Let the executors' heaps, which only grow while tasks make garbage, shrink to what they hold.

    Their Python workers need the memory more. Twice as many tasks as slots, so that every executor gets one.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: Rows of an Arrow batch, where the session does not say otherwise: whole texts of so many rows are held at once, several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, body)``: only the two needed columns, text as UTF-8 bytes, null text as empty."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("body"),
    )


def emit(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run):
    """``run`` over batches that gives a worker's freed memory back to the system when a task ends."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table, as ``(node, root)`` with root the smallest node reachable."""
    return traverse.components(edges, a, b)


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores added until ``df`` has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def take_batches(items, size: int):
    it = iter(items)
    while chunk := list(itertools.islice(it, size)):
        yield chunk
