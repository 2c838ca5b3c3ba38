"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item's windows (13 consecutive words, or the whole of a shorter item) are sets of word shingles
with places. One scan joins the documents' shingles with the benchmark's and so counts how often each occurs
in all documents. Shingles are ordered by that rarity; since a window must be contained whole, its necessary
prefix is its one rarest shingle, and a shingle that no document has prunes its windows. Prefix hits give
window starts (positional bound) that must lie within the document (length bound); each is then verified
word by word on the document's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words before A-Z are lower-cased: the same places, as case changes no separator.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_CASE_WORD), F.lit(0))


def _exact(words: Column) -> Column:
    """The words with A-Z, and nothing else, lower-cased."""
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def _hashes(lowered: Column, width: int) -> Column:
    """Hashes of the ``width``-word shingles at each place; empty where there are fewer words.

    ``lower`` of single words is a function of the words as compared, so equal windows have equal hashes.
    """
    return F.when(
        F.size(lowered) >= width,
        F.transform(F.sequence(F.lit(0), F.size(lowered) - width), lambda i: F.xxhash64(*(F.get(lowered, i + k) for k in range(width)))),
    ).otherwise(F.array().cast("array<long>"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: int = 20, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document row.

    Null and empty texts have no words and no hits; items without words have no windows. Rows that repeat an
    id are judged each by its own text. Either table may be empty.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tkey = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("tkey")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _exact(_words(F.col(item_text))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    spans = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - length)))
    spans = spans.select("item", F.slice("w", F.col("at") + 1, length).alias("w"))
    found = spans.groupBy(F.array_join("w", " ").alias("window")).agg(F.collect_set("item").alias("items"), F.first("w").alias("w"))
    windows = common.materialise(found, "windows")
    # shingles of short windows are the windows themselves
    size = F.least(F.size("w"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size.alias("n")).distinct().collect())
    lowered = F.transform("w", lambda w: F.lower(w))
    by_size = F.concat(*(F.when(size == n, _hashes(F.col("lw"), n)).otherwise(F.array().cast("array<long>")) for n in sizes)) if sizes else F.array().cast("array<long>")
    keys = windows.withColumn("lw", lowered).select("window", F.size("w").alias("n"), F.posexplode(by_size).alias("offset", "h"))
    keys = common.materialise(keys, "keys")

    # place 0 of each document's array is its number of words; shingles of different sizes follow each other
    hashed = docs.select("doc_id", tkey, F.transform(_words(F.col("text")), lambda w: F.lower(w)).alias("lw"))
    parts = [F.transform(_hashes(F.col("lw"), n), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for n in sizes]
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.size("lw").cast("long").alias("h"))), *parts)
    cells = hashed.select("doc_id", "tkey", F.explode(cells).alias("e")).select("doc_id", "tkey", "e.pos", "e.h")
    known = common.bounded(keys.select(F.col("h").alias("k")).distinct())
    hits = cells.join(known, (F.when(F.col("pos") >= 0, F.col("h")) == F.col("k")), "left").where("pos < 0 or k is not null").drop("k")
    hits = common.materialise(hits, "hits")
    about, hits = hits.where("pos < 0").select("doc_id", "tkey", F.col("h").alias("n_words")), hits.where("pos >= 0").distinct()
    rarity = hits.groupBy("h").agg(F.count("*").alias("df"))
    rarest = keys.join(rarity, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "h")).alias("k"), F.first("n").alias("n"))
    prefix = rarest.where("k.df > 0").select("window", "n", "k.h", "k.offset")
    cand = hits.join(common.bounded(prefix), "h").select("doc_id", "tkey", (F.col("pos") - F.col("offset")).alias("start"), "n", "window").where("start >= 0")
    # a document has at most as many candidates as places times windows with the same rarest shingle
    cand = common.materialise(cand.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "n", "window")).alias("c")), "candidates")

    # stored words: were they an expression, each candidate would split its text anew
    near = common.bounded(cand.select(F.col("doc_id").alias("cd"), F.col("tkey").alias("ck")))
    touched = docs.withColumn("tkey", tkey).join(near, F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("tkey") == F.col("ck")), "left_semi")
    touched = touched.dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", _exact(_words(F.col("text"))).alias("w"))
    touched = common.materialise(touched, "touched").join(cand.withColumnsRenamed({"doc_id": "cd", "tkey": "ck"}), F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("tkey") == F.col("ck")))
    true = F.filter("c", lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["n"]), " ") == c["window"])
    true = common.materialise(touched.select("doc_id", "tkey", F.array_sort(true).alias("c")), "held").where(F.size("c") > 0)
    covered = F.aggregate(
        "c", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, c: F.struct(
            F.greatest(a["end"], c["start"] + c["n"]).alias("end"),
            (a["hit"] + F.greatest(F.lit(0), c["start"] + c["n"] - F.greatest(a["end"], c["start"]))).alias("hit"),
        ),
    )["hit"]
    true = common.materialise(true.select("doc_id", "tkey", covered.cast("long").alias("n_hit"), F.array_distinct(F.transform("c", lambda c: c["window"])).alias("ws")), "verified")
    named = true.select("doc_id", "tkey", F.explode("ws").alias("window")).join(windows.select("window", F.explode("items").alias("item")), "window")
    named = named.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = true.select(F.col("doc_id").alias("hd"), F.col("tkey").alias("hk"), "n_hit")
    both = both.join(named.withColumnsRenamed({"doc_id": "nd", "tkey": "nk"}), F.col("hd").eqNullSafe(F.col("nd")) & (F.col("hk") == F.col("nk")))
    out = about.join(both, F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("tkey") == F.col("hk")), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, in which no window of a benchmark item occurs.

    One occurrence is enough, however long the document: the share of :func:`benchmark_hits` reports, it does not
    filter. Null and empty texts stay; rows without an id go or stay together, as do rows that repeat one; either
    table may be empty.
    """
    key = common.unused_name(docs, "_hit")
    marked = benchmark_hits(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(common.bounded(common.materialise(marked, "contaminated")), docs[options.get("id_col", "doc_id")].eqNullSafe(F.col(key)), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM bi),
lens AS (SELECT DISTINCT n FROM win),
dn AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n),
occ AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM dn),
hit AS (SELECT doc_id, occ.n AS n, i, item_id FROM occ JOIN win ON occ.n = win.n AND occ.k = win.k),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
cov AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN names ON d.doc_id = names.doc_id
"""
