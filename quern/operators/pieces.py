"""Kernels on whole weak components: a graph in pieces that no edge leaves, dealt over tasks.

A piece is one component or several small ones, so a kernel must take a disjoint union as well. Components of more
than ``limit`` edges are no piece; callers treat them by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise, ship

#: Components of so many edges at most share pieces of about that many.
SMALL_EDGES = 50_000
#: Searches from one task's seeds step over so many edges, about; their marks take so many cells at a time.
BLOCK_STEPS, CELLS = 200_000_000, 8_000_000
#: Rows of a batch that a kernel gives, about.
BATCH_ROWS = 200_000


@dataclass
class Dealt:
    """``at(node, piece)`` of the nodes of pieces, ``edges(piece, src, dst)``, and ``giant(src, dst)``, the edges of larger
    components, or None; all stored, without loops, each edge once. ``tasks``: about how many pieces there are."""

    at: DataFrame
    edges: DataFrame
    giant: DataFrame | None
    tasks: int


def deal(edges: DataFrame, limit: int) -> Dealt:
    """The pieces of ``edges(src, dst)``."""
    from quern.operators.traverse import components

    spark = ship(edges.sparkSession)
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    label = materialise(components(e), "labels")
    rooted = materialise(e.join(label.toDF("src", "root").hint("merge"), "src"), "rooted")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rooted.count() // SMALL_EDGES))
    # at most one row for SMALL_EDGES edges
    large = materialise(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > min(SMALL_EDGES, limit)), "large")
    piece = F.when(F.col("n").isNull(), F.xxhash64(F.lit(0), F.pmod(F.xxhash64("root"), F.lit(tasks)))).otherwise(F.xxhash64(F.lit(1), "root")).alias("piece")
    sized = lambda df: df.join(F.broadcast(large), "root", "left")
    is_piece = F.coalesce(F.col("n") <= limit, F.lit(True))
    giant = None
    if not large.where(F.col("n") > limit).isEmpty():
        giant = materialise(sized(rooted).where(~is_piece).select("src", "dst"), "giant")
    return Dealt(materialise(sized(label).where(is_piece).select("node", piece), "pieces"), materialise(sized(rooted).where(is_piece).select(piece, "src", "dst"), "edges"), giant, tasks)


def _wholes(batches: Iterator, key: str = "piece") -> Iterator:
    """Arrow tables of the rows of one key each; rows come sorted by it."""
    import numpy as np
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and k[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = k[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def by_piece(rows: DataFrame, kernel: Callable, schema: str, tasks: int) -> DataFrame:
    """``kernel(Arrow table of a piece's rows) -> pandas frames`` for every piece of ``rows(piece, ...)``."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        for table in _wholes(batches):
            for out in kernel(table):
                yield from pa.Table.from_pandas(out, preserve_index=False).to_batches()

    return rows.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(run, schema)


def searches(src, dst, seeds, hops: int | None, keep_seed: bool) -> Iterator[tuple]:
    """Arrays (seed, node, depth) of breadth-first searches from every seed; blocks of seeds advance together, level by level."""
    import numpy as np

    ids = np.unique(np.concatenate((src, dst)))
    n = len(ids)
    s = np.searchsorted(ids, src)
    heads = np.searchsorted(ids, dst)[np.argsort(s, kind="stable")]
    degree = np.bincount(s, minlength=n)
    start = np.cumsum(degree) - degree
    at = np.searchsorted(ids, seeds)
    for lo in range(0, len(at), max(1, CELLS // n)):
        own = at[lo : lo + max(1, CELLS // n)]
        seen, stamp = np.zeros(len(own) * n, bool), np.empty(len(own) * n, np.int32)
        keys = np.arange(len(own)) * n + own
        seen[keys] = True
        if keep_seed:
            yield ids[own], ids[own], np.zeros(len(own), np.int32)
        depth = 0
        while len(keys) and (hops is None or depth < hops):
            depth += 1
            v = keys % n
            c = degree[v]
            ends = np.cumsum(c)
            new = np.repeat(keys - v, c) + heads[np.repeat(start[v] - ends + c, c) + np.arange(ends[-1])]
            new = new[~seen[new]]
            turn = np.arange(len(new), dtype=np.int32)
            stamp[new] = turn
            keys = new[stamp[new] == turn]  # each once
            seen[keys] = True
            yield ids[own[keys // n]], ids[keys % n], np.full(len(keys), depth, np.int32)


def _search_kernel(hops: int | None, keep_seed: bool):
    def run(table):
        import numpy as np
        import pandas as pd

        a, b = table["a"].to_numpy(), table["b"]
        is_edge = b.is_valid().to_numpy(zero_copy_only=False)
        held, rows = [], 0
        for part in searches(a[is_edge], b.drop_null().to_numpy(), a[~is_edge], hops, keep_seed):
            held.append(part)
            rows += len(part[0])
            if rows >= BATCH_ROWS:
                yield pd.DataFrame(dict(zip(("seed", "node", "depth"), map(np.concatenate, zip(*held)))))
                held, rows = [], 0
        if rows:
            yield pd.DataFrame(dict(zip(("seed", "node", "depth"), map(np.concatenate, zip(*held)))))

    return run


def wide_closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False, hops: int | None = None, keep_seed: bool = False, limit: int | None = None, dealt: Dealt | None = None) -> DataFrame:
    """:func:`traverse.closure` for many seeds: one search a seed within its piece.

    The seeds of a piece are dealt over as many tasks as their searches' steps need, each with the piece's edges.
    Components of more than ``limit`` edges are searched by joins. ``dealt`` are the edges' pieces, if known.
    """
    from quern.operators.traverse import KERNEL_EDGES, closure

    d = dealt or deal(edges, KERNEL_EDGES if limit is None else limit)
    s = materialise(seeds.select("seed").where("seed is not null").distinct(), "seeds")
    own = materialise(s.join(d.at.toDF("seed", "piece").hint("merge"), "seed").select("piece", "seed"), "seeds")
    sizes = d.edges.groupBy("piece").agg(F.count("*").alias("e")).join(own.groupBy("piece").agg(F.count("*").alias("s")), "piece")
    blocks = F.ceil(F.col("e").cast("double") * F.col("s") / BLOCK_STEPS).cast("int").alias("blocks")
    sizes = F.broadcast(materialise(sizes.select("piece", blocks), "blocks"))  # one row a piece, and these are few
    ends = (F.col("dst"), F.col("src")) if reverse else (F.col("src"), F.col("dst"))
    rows = d.edges.join(sizes, "piece").select("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), ends[0].alias("a"), ends[1].alias("b"))
    rows = rows.union(own.join(sizes, "piece").select("piece", F.pmod(F.xxhash64("seed"), F.col("blocks")).cast("int"), "seed", F.lit(None).cast("long")))
    out = by_piece(rows.select(F.xxhash64("piece", "block").alias("piece"), "a", "b"), _search_kernel(hops, keep_seed), "seed long, node long, depth int", 2 * d.tasks)
    if keep_seed:  # seeds without an edge to another node
        ends_of = d.at.select("node") if d.giant is None else d.at.select("node").union(d.giant.select("src")).union(d.giant.select("dst"))
        out = out.union(s.join(ends_of.withColumnRenamed("node", "seed").hint("merge"), "seed", "left_anti").select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    if d.giant is not None:
        far = d.giant.select(F.col("src").alias("seed")).union(d.giant.select("dst")).distinct()
        out = out.union(closure(d.giant, s.join(far, "seed", "left_semi"), reverse, hops, keep_seed))
    return out
