"""The debt schedule by components."""

from collections import defaultdict

import numpy as np

from quern.operators import trust
from tests.test_kernels import graph


def test_schedule_merges_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = sorted({(10 * c + int(min(a, b)), 10 * c + int(max(a, b))) for c in range(4) for a, b in rng.integers(0, 10, (15, 2)) if a != b})
    g = graph(spark, {i: {"state": "H" if i % 3 == 0 else "D"} for i in range(40)}, edges).stored()
    cov = trust.debt_coverage(g)
    left, want = defaultdict(set), []
    for r in cov.collect():
        left[r.hole].add(r.def_id)
    size = {h: len(c) for h, c in left.items()}
    while left and max(map(len, left.values())):
        h = min(left, key=lambda x: (-len(left[x]), x))
        new = left.pop(h)
        want.append((len(want) + 1, h, size[h], len(new)))
        left = {x: c - new for x, c in left.items()}
    rows = lambda df: [tuple(r)[:4] for r in df.orderBy("step").collect()]
    assert rows(trust.debt_schedule(g, cov, limit=0)) == want
    # no job a step: components are scheduled in their tasks
    monkeypatch.setattr(trust, "_greedy_by_joins", None)
    assert rows(trust.debt_schedule(g, cov)) == want and len(want) > 4
    assert rows(trust.debt_schedule(g, cov, steps=2)) == want[:2]
