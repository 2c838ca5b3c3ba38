"""Communities, cuts and owners by pieces."""

import numpy as np

from quern.operators import community, flow, points
from tests.test_kernels import graph


def test_communities_of_components_are_those_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = sorted({(12 * c + int(a), 12 * c + int(b)) for c in range(3) for a, b in rng.integers(0, 12, (26, 2))})
    g = graph(spark, {i: {} for i in range(38)}, edges)
    rows = lambda df: {r.node: (r.community, round(r.modularity, 9)) for r in df.collect()}
    want = rows(community.communities(g, limit=0))  # one task
    monkeypatch.setattr(community, "one_task", None)
    assert rows(community.communities(g)) == want and len(want) == 38 and len({c for c, _ in want.values()}) > 3
    near = [{} for _ in range(38)]
    for a, b in edges:
        if a != b:
            near[a][b], near[b][a] = near[a].get(b, 0.0) + 1, near[b].get(a, 0.0) + 1
    of, _ = community.two_levels([dict(sorted(x.items())) for x in near])
    assert [want[i][0] for i in range(38)] == of


def test_cuts_of_components(spark, monkeypatch):
    monkeypatch.setattr(flow, "one_task", None)
    one = {0: {}, 1: {}, **{i: {"access": "private", "line": 9} for i in (2, 3, 4)}, 5: {"access": "private", "state": "P"}}
    edges = [(0, 2), (1, 2), (2, 3), (3, 4), (4, 5)]
    g = graph(spark, {i + 10 * c: d for c in range(2) for i, d in one.items()}, [(a + 10 * c, b + 10 * c) for c in range(2) for a, b in edges])
    got = {r.node: (r.cut, r.articulation, r.upstream, r.downstream, r.score) for r in flow.chokepoints(g).collect()}
    assert {k for k, v in got.items() if v[0]} == {2, 12} and got[2] == got[12] == (True, True, 2, 3, 9.0)


def test_owners_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    nodes = {}
    for i in range(60):
        module, line = ("M", "M.A", "M.A.B", "Z")[int(rng.integers(0, 4))], None if i % 11 == 0 else int(rng.integers(1, 9))
        nodes[i] = {"name": f"{module}.n{i}" + (f"@{line}" if i % 3 == 0 else ""), "module": module, "line": line}
    want = {}
    for i, d in nodes.items():
        if i % 3 == 0 and d["line"] is not None:
            own = [(o["line"], j) for j, o in nodes.items() if j % 3 and o["line"] is not None and o["line"] <= d["line"] and (d["module"] + ".").startswith(o["module"] + ".")]
            if own:
                want[i] = max(own)[1]
    g = graph(spark, nodes, [(0, 1)])
    assert {r.def_id: r.owner for r in points.owners(g).collect()} == want and want
    plan = points.owners(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan  # no join of all lines of a module
