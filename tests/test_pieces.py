"""Kernels on whole components against joins and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pieces, traverse


def some_edges(spark, seed=1):
    """Four components of ten nodes with cycles and loops, and a node with only a loop."""
    rng = np.random.default_rng(seed)
    e = {(int(10 * c + a), int(10 * c + b)) for c in range(4) for a, b in rng.integers(0, 10, (14, 2))} | {(99, 99)}
    return spark.createDataFrame(sorted(e), "src long, dst long")


@pytest.mark.parametrize("reverse,hops,keep,limit,steps", [(False, None, False, 100, 10**9), (True, 2, True, 100, 20), (False, None, True, 0, 20), (True, None, False, 12, 20)])
def test_wide_closure_is_the_closure(spark, monkeypatch, reverse, hops, keep, limit, steps):
    monkeypatch.setattr(pieces, "BLOCK_STEPS", steps)  # seeds of a piece in several blocks
    e = some_edges(spark)
    seeds = spark.createDataFrame([(i,) for i in (0, 3, 3, 11, 25, 34, 99, 500, None)], "seed long")
    rows = lambda df: sorted(tuple(r) for r in df.select("seed", "node", "depth").collect())
    want = rows(traverse.closure(e, seeds, reverse, hops, keep))
    assert rows(pieces.wide_closure(e, seeds, reverse, hops, keep, limit=limit)) == want and want


def test_closure_of_a_long_chain_takes_no_round_a_level(spark, monkeypatch):
    written = []
    keep = pieces.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df, name, *a: written.append(name) or keep(df, name, *a))
    got = traverse.every_closure(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long"))
    assert got.agg(F.count("*"), F.max("depth")).first()[:] == (820, 40)
    assert len(written) < 20


def test_many_small_components_are_not_coloured(spark, monkeypatch):
    def never(edges):
        raise AssertionError("coloured")

    monkeypatch.setattr(traverse, "colouring_components", never)
    e = spark.createDataFrame([(3 * c + i, 3 * c + (i + 1) % 3) for c in range(5) for i in range(3)] + [(50, 50)], "src long, dst long")
    assert {r.node: r.scc for r in traverse.strong_components(e, limit=3).collect()} == {i: i // 3 * 3 for i in range(15)} | {50: 50}


def test_components_beyond_the_limit_are_coloured_alone(spark):
    e = some_edges(spark, 2)
    want = {r.node: r.scc for r in traverse.strong_components(e).collect()}
    assert {r.node: r.scc for r in traverse.strong_components(e, limit=11).collect()} == want == {r.node: r.scc for r in traverse.colouring_components(e).collect()}
