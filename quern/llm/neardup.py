"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle space gives two values, the smallest and the largest of the set, so half
the hash evaluations make a signature of the same length, each value agreeing with the sets' similarity as
probability. Values are grouped into bands; documents that share a band are candidates.

Equal sets are one representative from the start. Within a band's bucket every member is compared with the
bucket's least and greatest documents, on the full sets; these are found by grouped minima and joins, so pairs
grow with the bucket, not its square. Buckets whose other members are of several components then are compared
exactly: the members outside a bucket's main component, in blocks, are leads,
and all members stream past each block, so every two members of different components have met.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingle

BANDS, ROWS = 42, 6
_FACTORS = np.random.default_rng(8).integers(0, 2**63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIXERS = np.random.default_rng(9).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of one representative that one task compares, about.
SALT_ROWS = 64
#: Leads of a block, and members that one task streams past it, in the exact comparison, about.
BLOCK, STREAM = 64, 512


def band_keys(own: np.ndarray) -> np.ndarray:
    """The band keys of a non-empty set of 64-bit shingle hashes: minima and maxima of multiplicative permutations."""
    sig = np.empty((len(_FACTORS), 2), np.uint64)
    step = max(1, 65536 // len(own))
    for at in range(0, len(_FACTORS), step):
        values = _FACTORS[at : at + step, None] * own[None, :]
        values.min(axis=1, out=sig[at : at + step, 0])
        values.max(axis=1, out=sig[at : at + step, 1])
    mixed = (sig.reshape(BANDS, ROWS) * _MIXERS).sum(axis=1, dtype=np.uint64)
    return shingle.mix(mixed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signatures(src: DataFrame, width: int) -> DataFrame:
    """Of each row of ``src(doc_id, tkey, body)``: ``doc_id, tkey, n_shingles, set_key, bands``."""
    ddl = "doc_id long, tkey long, n_shingles long, set_key binary, bands array<long>"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            bodies, ids, texts = (b.column(c).to_pylist() for c in ("body", "doc_id", "tkey"))
            for x, y in shingle.chunks(bodies, 4 << 20):
                out = {k: [] for k in schema.names}
                for key, text, own in zip(ids[x:y], texts[x:y], shingle.shingle_sets(bodies[x:y], width)):
                    out["doc_id"].append(key)
                    out["tkey"].append(text)
                    out["n_shingles"].append(len(own))
                    out["set_key"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    out["bands"].append(band_keys(own).view(np.int64).tolist() if len(own) else [])
                yield common.emit(out, schema)

    return src.mapInArrow(common.tidy(run), ddl)


def verified(src: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs (member, rep)`` whose full shingle sets have at least ``percent`` % similarity.

    Members stream past their representative's set, in tasks of about ``SALT_ROWS`` members of one representative.
    """
    salts = common.materialise(pairs.groupBy("rep").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1"), "salts")
    salted = common.salted_join(pairs, salts, "rep", ("member",), "left").select("rep", "member", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    heads = salted.select("rep", F.lit(None).cast("long").alias("member"), "salt").distinct()
    need = common.materialise(
        salted.union(heads.select("rep", "member", "salt")).select("rep", "salt", F.col("member").isNotNull().alias("is_member"), F.coalesce("member", "rep").alias("doc_id")), "needed"
    )
    common.discard(salts)
    held = src.join(common.bounded(need), "doc_id").repartition("rep", "salt").sortWithinPartitions("rep", "salt", "is_member")
    ddl = "u long, v long"
    schema = common.arrow_schema(ddl)

    def run(batches):
        at, rep = None, None
        for b in batches:
            bodies = b.column("body").to_pylist()
            sets = iter(shingle.shingle_sets(bodies, width))
            out = {"u": [], "v": []}
            for r, salt, is_member, key in zip(*(b.column(c).to_pylist() for c in ("rep", "salt", "is_member", "doc_id"))):
                own = next(sets)
                if not is_member:
                    at, rep = (r, salt), own
                elif at == (r, salt) and min(len(own), len(rep)) * 100 >= percent * max(len(own), len(rep)):
                    same = len(np.intersect1d(own, rep, assume_unique=True))
                    if 100 * same >= percent * (len(own) + len(rep) - same):
                        out["u"].append(key)
                        out["v"].append(r)
            yield common.emit(out, schema)

    return held.mapInArrow(common.tidy(run), ddl)


class Leads:
    """Sets of hashes, each of a root, that other sets are counted against at once."""

    def __init__(self):
        self.keys, self.roots, self.sets, self.flat = [], [], [], None

    def add(self, key: int, root: int, own: np.ndarray) -> None:
        self.keys.append(key)
        self.roots.append(root)
        self.sets.append(own)
        self.flat = None

    def links(self, own: np.ndarray, root: int, percent: int) -> list[int]:
        """The leads of other roots with at least ``percent`` % similarity, one a root."""
        if self.flat is None:
            self.sizes = np.array([len(x) for x in self.sets])
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        lo, hi = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        same = np.bincount(self.owner[at], minlength=len(self.sets))
        near = np.flatnonzero(100 * same >= percent * (self.sizes + len(own) - same))
        return list({self.roots[i]: self.keys[i] for i in near.tolist() if self.roots[i] != root}.values())


def _exact_links(src: DataFrame, left: DataFrame, width: int, percent: int) -> DataFrame:
    """Links, enough to join what is linked, of every two members of different roots in the buckets ``left (key, doc_id, root)``."""
    per = left.groupBy("key", "root").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    per = per.select("key", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / STREAM).cast("int").alias("salts"))
    at = common.materialise(common.salted_join(left, common.materialise(per, "per"), "key", ("doc_id",)), "residual")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lead = at.where("root <> main").withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int")).withColumn("salt", cells("salts"))
    past = at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.col("salts")).cast("int")).withColumn("block", cells("blocks"))
    names = ("key", "block", "salt")
    need = lead.select(*names, F.lit(False).alias("is_member"), "doc_id", "root").union(past.select(*names, F.lit(True).alias("is_member"), "doc_id", "root"))
    held = src.join(common.bounded(common.materialise(need, "blocks")), "doc_id").repartition(*names).sortWithinPartitions(*names, "is_member")
    ddl = "u long, v long"
    schema = common.arrow_schema(ddl)

    def run(batches):
        met, leads = None, Leads()
        for b in batches:
            out = {"u": [], "v": []}
            sets = iter(shingle.shingle_sets(b.column("body").to_pylist(), width))
            for *where, is_member, key, root in zip(*(b.column(c).to_pylist() for c in (*names, "is_member", "doc_id", "root"))):
                own = next(sets)
                if met != where:
                    met, leads = where, Leads()
                if not is_member:
                    leads.add(key, root, own)
                elif leads.keys:
                    for x in leads.links(own, root, percent):
                        out["u"].append(key)
                        out["v"].append(x)
            yield common.emit(out, schema)

    return held.mapInArrow(common.tidy(run), ddl)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document; links are confirmed on full sets.

    ``component_id`` is the smallest document id reachable over links, ``kept`` whether it is the document's
    own. Texts without words, null ones too, have no shingles, are linked with nothing and kept. Rows that
    repeat an id are one document with all their texts: what is linked with one of them is linked with the id.
    Rows without an id keep a null component.
    """
    spark = docs.sparkSession
    src = common.documents(docs, id_col, text_col)
    sig = common.materialise(_signatures(src.select("doc_id", F.xxhash64("body").alias("tkey"), "body"), width), "signatures")
    # rows compared are texts: an id that several of them share is told apart by the text until the end
    many = common.materialise(sig.where("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("tkey").alias("a"), F.max("tkey").alias("b")).where("a <> b").select("doc_id"), "many")
    shared = not many.isEmpty()
    if shared:
        mark = common.bounded(many.withColumn("is_many", F.lit(True)))
        own = F.when(F.col("is_many"), F.xxhash64("doc_id", "tkey")).otherwise(F.col("doc_id"))
        sig = common.materialise(sig.join(mark, "doc_id", "left").withColumn("row", own).drop("is_many"), "signatures")
        src = src.withColumn("tkey", F.xxhash64("body")).join(mark, "doc_id", "left").select(own.alias("doc_id"), "body")
    else:
        sig = sig.withColumn("row", F.col("doc_id"))
    reps = sig.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("rep")).where("rep is not null")
    reps = common.materialise(reps, "reps")
    lone = sig.join(reps, "set_key").where("row = rep").dropDuplicates(["rep"])
    rows = common.materialise(lone.select(F.explode("bands").alias("key"), F.col("rep").alias("doc_id")), "bands", "lz4")
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last")
    ends = common.materialise(ends, "ends", "lz4")
    buckets = common.materialise(common.salted_join(rows, ends, "key", ("doc_id",)), "buckets", "lz4")
    common.discard(rows, ends)
    rows = buckets
    common.free_shuffles(spark)
    first, last = rows.where("doc_id <> rep").select("rep", F.col("doc_id").alias("member")), rows.where("doc_id <> rep AND doc_id <> last").select("last", "doc_id")
    edges = common.materialise(verified(src, first.union(last).distinct(), width, percent), "links")
    if shared:
        of = sig.join(many, "doc_id", "left_semi").join(reps, "set_key").select("doc_id", "rep")
        least = of.groupBy("doc_id").agg(F.min("rep").alias("u"))
        edges = common.materialise(edges.union(of.join(least, "doc_id").where("rep <> u").select("u", "rep").distinct()), "links")
    roots = common.components(edges, "u", "v")
    # the ends have been compared with their whole bucket
    left = rows.where("doc_id <> rep AND doc_id <> last").join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    left = common.materialise(left, "rest", "lz4")
    several = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    several = common.materialise(several, "several", "lz4")
    left = common.materialise(common.salted_join(left, several, "key", ("doc_id",)), "left")
    if not left.isEmpty():
        found = common.materialise(_exact_links(src, left, width, percent), "links")
        if not found.isEmpty():
            roots = common.components(edges.union(found), "u", "v")
    named = reps.join(roots, reps.rep == roots.node, "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    if shared:
        smallest = out.where("doc_id is not null and component_id is not null").groupBy("component_id").agg(F.min("doc_id").alias("smallest"))
        # a row without words of an id that has others belongs with them
        of_id = out.join(smallest, "component_id").groupBy("doc_id").agg(F.min("smallest").alias("component_id"))
        out = out.drop("component_id").join(of_id, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", **options) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates, with all columns.

    Null and empty texts and rows without an id stay; rows that repeat an id are one document and stay or go
    together. An empty table stays empty.
    """
    key = common.unused_name(docs, "_gone")
    gone = near_duplicates(docs, width, percent, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    gone = common.bounded(common.materialise(gone, "gone"))
    return docs.join(gone, docs[id_col].cast("long") == F.col(key), "left_anti")
