"""Every registered query of the graph engine against its SQL twin, and kernels on small hand-made graphs."""

import glob
import os

import duckdb
import pytest

from quern.operators import traverse
from quern.plans import registry


def normal(rows):
    return sorted(repr([None if v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = db.execute(registry.ORACLES[name])
    columns = sorted(x[0] for x in want.description)
    order = [x[0] for x in want.description]
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    expected = [[r[order.index(c)] for c in columns] for r in want.fetchall()]
    assert normal(got.select(*columns).collect()) == normal(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    assert len(got.collect()) >= 0 and got.columns


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_closure_on_a_diamond(spark):
    got = {(r.seed, r.node): r.depth for r in traverse.every_closure(edges(spark, (1, 2), (1, 3), (2, 4), (3, 4))).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 4): 1, (3, 4): 1}


def test_strong_components_of_a_cycle_with_a_tail(spark):
    got = {r.node: r.scc for r in traverse.strong_components(edges(spark, (1, 2), (2, 3), (3, 1), (3, 4))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_of_a_disconnected_pair(spark):
    got = {r.node: r.root for r in traverse.components(edges(spark, (5, 1), (9, 8))).collect()}
    assert got == {5: 1, 1: 1, 9: 8, 8: 8}


def test_pagerank_converges(spark, sf):
    import numpy as np

    from quern.plans import derive

    g = derive.star_graph(spark, sf, cyclic=True)
    at = {r.def_id: i for i, r in enumerate(g.nodes.select("def_id").collect())}
    move = np.zeros((len(at), len(at)))
    for r in g.edges.select("src", "dst").distinct().collect():
        move[at[r.dst], at[r.src]] = 1
    out = move.sum(axis=0)
    move = np.where(out > 0, move / np.maximum(out, 1), 1 / len(at))
    mass = np.full(len(at), 1 / len(at))
    for _ in range(500):
        mass = 0.15 / len(at) + 0.85 * move @ mass
    got = {r.node: r.mass for r in registry.QUERIES["pagerank_converged"](spark, sf).collect()}
    assert got.keys() == at.keys() and sum(abs(got[k] - mass[i]) for k, i in at.items()) < 1e-5


def test_term_clusters_of_documents(spark, sf):
    import math
    import re
    from collections import Counter, defaultdict

    per, defs = defaultdict(Counter), defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect():
        for w in re.findall(r"[^ \t-\r]+", r.text or ""):
            per[w][r.source or ""] += 1
            defs[w].add(r.doc_id)
    got = {r.hash: r for r in registry.QUERIES["term_clusters_documents"](spark, sf).collect()}
    assert got.keys() == {w for w, c in per.items() if sum(c.values()) >= 2}
    for w, r in got.items():
        n, c = sum(per[w].values()), per[w].values()
        div = sum(-x / n * math.log(x / n) for x in c) / math.log(min(len(c), 10)) if len(c) > 1 else 0.0
        assert (r.size, r.n_defs, r.n_modules) == (n, len(defs[w]), len(c))
        assert r.score == pytest.approx(n * len(w) * (1 + div), abs=1e-4)
