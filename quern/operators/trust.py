"""Trust: axiom footprints, cohorts and leverage; proof debt with a greedy schedule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators.pieces import by_piece, deal, wide_closure
from quern.operators.traverse import KERNEL_EDGES
from quern.plans.graph import Graph
from quern.plans.numbering import numbered, running
from quern.session import materialise


def in_scope(graph: Graph, prefixes: tuple[str, ...] = (), externals: tuple[str, ...] | None = None) -> Column:
    """Modules under one of ``prefixes``; without any, all but foundational ones and, where known, ``externals``."""
    module = F.col("module")
    any_of = lambda ps: reduce(lambda x, y: x | y, (names.is_module_prefix(F.lit(p), module) for p in ps), F.lit(False))
    if prefixes:
        return any_of(prefixes)
    return ~names.is_foundational(module) & ~any_of(externals or ())


def axiom_sets(graph: Graph, source: str = "postulate", prefixes: tuple[str, ...] = (), externals: tuple[str, ...] | None = None) -> DataFrame:
    """``def_id, foundational``: what theorems can rest on. ``source``: postulate, record-field (projections in scope) or both."""
    if source not in ("postulate", "record-field", "both"):
        raise ValueError(f"unknown axiom source: {source}")
    is_post, base = F.col("state") == "P", names.is_foundational(F.col("module"))
    field = (F.col("kind") == "projection") & in_scope(graph, prefixes, externals)
    paper = (is_post & ~base) if source == "postulate" else field if source == "record-field" else (is_post & ~base) | field
    return graph.nodes.where(paper | (is_post & base)).select("def_id", (~paper).alias("foundational"))


def footprints(graph: Graph, source: str = "postulate", theorem_prefixes: tuple[str, ...] = (), axiom_prefixes: tuple[str, ...] = (), externals: tuple[str, ...] | None = None) -> DataFrame:
    """``def_id, axiom, foundational``: the axioms each public theorem rests on, directly or not; a null axiom if none.

    Theorems are public, in scope and of any kind but ``other``, whatever their state; one is never among its own
    axioms. Axioms' ancestors are computed, not the theorems' closures: there are few axioms.
    """
    axioms = axiom_sets(graph, source, axiom_prefixes, externals)
    theorems = graph.nodes.where((F.col("access") == "public") & (F.col("kind") != "other") & in_scope(graph, theorem_prefixes, externals)).select("def_id")
    up = wide_closure(graph.edges, axioms.select(F.col("def_id").alias("seed")), reverse=True).select(F.col("node").alias("def_id"), F.col("seed").alias("axiom"))
    up = up.join(axioms.withColumnRenamed("def_id", "axiom"), "axiom").select("def_id", "axiom", "foundational")
    return materialise(theorems.join(up, "def_id", "left"), "footprints")


def ledger(foot: DataFrame, min_axioms: int = 0) -> DataFrame:
    """``def_id, n_axioms, n_foundational``: each theorem's trust budget."""
    out = foot.groupBy("def_id").agg(F.count_if(F.col("axiom").isNotNull() & ~F.col("foundational")).alias("n_axioms"), F.count_if(F.coalesce("foundational", F.lit(False))).alias("n_foundational"))
    return out.where(F.col("n_axioms") >= min_axioms)


def cohorts(foot: DataFrame, least: int = 2) -> DataFrame:
    """``axioms, n``: theorems grouped by their exact axiom set, the empty set too."""
    sets = foot.groupBy("def_id").agg(F.array_sort(F.collect_set(F.when(~F.col("foundational"), F.col("axiom")))).alias("axioms"))
    return sets.groupBy("axioms").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def leverage(foot: DataFrame) -> DataFrame:
    """``axiom, n``: how many theorems use each axiom."""
    return foot.where("axiom is not null and not foundational").groupBy("axiom").agg(F.count_distinct("def_id").alias("n"))


def exported(graph: Graph) -> DataFrame:
    """``node``: all public definitions; without any, what nothing uses."""
    public = graph.nodes.where("access = 'public'")
    return (graph.terminals() if public.isEmpty() else public).select(F.col("def_id").alias("node"))


def debt_coverage(graph: Graph, postulates: bool = True, foundational: bool = False) -> DataFrame:
    """``hole, def_id``: which exported definitions depend on each hole (and postulate); a hole is not among its own ancestors."""
    kept = F.col("state") == "H"
    if postulates:
        kept = kept | ((F.col("state") == "P") & (F.lit(foundational) | ~names.is_foundational(F.col("module"))))
    holes = graph.nodes.where(kept)
    up = wide_closure(graph.edges, holes.select(F.col("def_id").alias("seed")), reverse=True)
    return materialise(up.join(exported(graph), "node", "left_semi").select(F.col("seed").alias("hole"), F.col("node").alias("def_id")), "coverage")


def greedy(holes, defs) -> list[tuple[int, int, int]]:
    """(hole, coverage, gain) of greedy maximum coverage of the pairs, ties to the lowest hole, until nothing is gained.

    Gains only fall, so a hole's last known gain bounds it.
    """
    import heapq

    import numpy as np

    order = np.lexsort((defs, holes))
    _, at = np.unique(defs[order], return_inverse=True)
    ids, starts = np.unique(holes[order], return_index=True)
    sets = np.split(at, starts[1:])
    covered = np.zeros(len(at), bool)
    heap = [(-len(s), int(h), i) for i, (h, s) in enumerate(zip(ids, sets))]
    heapq.heapify(heap)
    rows = []
    while heap:
        bound, hole, i = heapq.heappop(heap)
        gain = int((~covered[sets[i]]).sum())
        if not gain:
            continue
        if gain < -bound:
            heapq.heappush(heap, (-gain, hole, i))
            continue
        covered[sets[i]] = True
        rows.append((hole, len(sets[i]), gain))
    return rows


def _greedy_kernel(table):
    import pandas as pd

    yield pd.DataFrame(greedy(table["hole"].to_numpy(), table["def_id"].to_numpy()), columns=["hole", "coverage", "gain"]).astype("int64")


def _greedy_by_joins(left: DataFrame) -> DataFrame:
    """As :func:`greedy`, ``hole, coverage, gain``: each round counts anew the holes of largest bounds only, 64 at a time, against what is left."""
    # one row a hole on the driver: definitions that are open or assumed
    size = {r.hole: r.n for r in left.groupBy("hole").agg(F.count("*").alias("n")).collect()}
    bound, rows = dict(size), []
    while bound:
        known: dict[int, int] = {}
        best = None
        while True:
            ahead = sorted((h for h in bound if h not in known), key=lambda h: (-bound[h], h))[:64]
            if not ahead or (best is not None and (bound[ahead[0]], -ahead[0]) < (known[best], -best)):
                break
            got = {r.hole: r.n for r in left.where(F.col("hole").isin(ahead)).groupBy("hole").agg(F.count("*").alias("n")).collect()}
            for h in ahead:
                known[h] = bound[h] = got.get(h, 0)
            best = min(known, key=lambda h: (-known[h], h))
        if best is None or not known[best]:
            break
        rows.append((best, size[best], known[best]))
        del bound[best]
        left = materialise(left.join(left.where(F.col("hole") == best).select("def_id"), "def_id", "left_anti").select("hole", "def_id"), "coverage")
    return left.sparkSession.createDataFrame(rows, "hole long, coverage long, gain long")


def debt_schedule(graph: Graph, coverage: DataFrame, steps: int | None = None, limit: int = KERNEL_EDGES) -> DataFrame:
    """``step, hole, coverage, gain, cum_pct``: greedy maximum coverage, ties to the lowest hole, until nothing is gained.

    ``cum_pct`` is the share of all exported definitions. Holes of different weak components share no dependents, and
    within one the steps fall in gain and, of equal gains, rise in hole: so the schedule is that of all components, sorted.
    Components of more than ``limit`` edges are scheduled by joins.
    """
    total = exported(graph).count()
    d = deal(graph.edges, limit)
    left = coverage.select("hole", "def_id").distinct()
    own = left.join(d.at.toDF("hole", "piece").hint("merge"), "hole").select("piece", "hole", "def_id")
    rows = by_piece(own, _greedy_kernel, "hole long, coverage long, gain long", d.tasks)
    if d.giant is not None:
        far = d.giant.select(F.col("src").alias("hole")).union(d.giant.select("dst")).distinct()
        rows = rows.union(_greedy_by_joins(materialise(left.join(far, "hole", "left_semi"), "coverage")))
    order = [F.desc("gain"), F.col("hole")]
    out = running(numbered(materialise(rows, "schedule"), *order, name="step", start=1), "gain", *order, name="covered")
    out = out.select(F.col("step").cast("int").alias("step"), "hole", "coverage", "gain", (100.0 * F.col("covered") / total).alias("cum_pct"))
    return out if steps is None else out.where(F.col("step") <= steps)


def prerequisites(graph: Graph, coverage: DataFrame) -> DataFrame:
    """``hole, needs, shared``: holes that use other holes, with the number of dependents both block."""
    holes = coverage.select("hole").distinct()
    down = wide_closure(graph.edges, holes.select(F.col("hole").alias("seed"))).join(holes.withColumnRenamed("hole", "node"), "node", "left_semi")
    both = coverage.toDF("ha", "def_id").join(coverage.toDF("hb", "def_id"), "def_id")
    pairs = down.select(F.col("seed").alias("ha"), F.col("node").alias("hb"))
    shared = pairs.join(both, ["ha", "hb"], "left").groupBy("ha", "hb").agg(F.count("def_id").alias("shared"))
    return shared.toDF("hole", "needs", "shared")
