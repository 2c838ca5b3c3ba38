"""Chokepoints: minimum vertex cuts between results and assumptions, and articulation points, on the condensation."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators.geometry import condensed
from quern.operators.points import without_names
from quern.operators.pieces import by_piece, deal, wide_closure
from quern.operators.traverse import KERNEL_EDGES, one_task
from quern.plans.graph import Graph
from quern.session import materialise

ENDLESS, LEAST = 1e18, 1e-12


def vertex_cut(n: int, edges: list[tuple[int, int]], capacity: list[float], sources: set[int], sinks: set[int]) -> tuple[float, list[int]]:
    """(maximum flow, the vertices of the minimum cut nearest to the sources): every vertex is split into an arc of its capacity.

    Flow is pushed level graph by level graph; the cut is what the residual graph still reaches from the sources.
    """
    head, room, arcs = [], [], [[] for _ in range(2 * n + 2)]
    start, end = 2 * n, 2 * n + 1

    def arc(u, v, c):
        for x, y, cap in ((u, v, c), (v, u, 0.0)):
            arcs[x].append(len(head))
            head.append(y)
            room.append(cap)

    for v in range(n):
        arc(2 * v, 2 * v + 1, capacity[v])
    for u, v in edges:
        arc(2 * u + 1, 2 * v, ENDLESS)
    for v in sorted(sources):
        arc(start, 2 * v, ENDLESS)
    for v in sorted(sinks):
        arc(2 * v + 1, end, ENDLESS)

    def levels():
        at = [-1] * (2 * n + 2)
        at[start] = 0
        queue = deque([start])
        while queue:
            u = queue.popleft()
            for a in arcs[u]:
                if room[a] > LEAST and at[head[a]] < 0:
                    at[head[a]] = at[u] + 1
                    queue.append(head[a])
        return at

    total = 0.0
    while (level := levels())[end] >= 0:
        todo = [0] * (2 * n + 2)
        path: list[int] = []
        u = start
        while True:
            if u == end:
                push = min(room[a] for a in path)
                for a in path:
                    room[a] -= push
                    room[a ^ 1] += push
                total += push
                keep = next(i for i, a in enumerate(path) if room[a] <= LEAST)
                u = head[path[keep] ^ 1]
                del path[keep:]
            while todo[u] < len(arcs[u]):
                a = arcs[u][todo[u]]
                if room[a] > LEAST and level[head[a]] == level[u] + 1:
                    break
                todo[u] += 1
            else:
                if u == start:
                    break
                level[u] = -1
                u = head[path.pop() ^ 1]
                continue
            path.append(a)
            u = head[a]
    reached = levels()
    return total, [v for v in range(n) if reached[2 * v] >= 0 and reached[2 * v + 1] < 0]


def articulation_points(n: int, neighbours: list[list[int]]) -> list[int]:
    """Vertices of an undirected graph whose removal parts their component; an iterative depth-first search."""
    order, low, found, clock = [-1] * n, [0] * n, set(), 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        children, stack = 0, [(root, -1, iter(neighbours[root]))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if order[w] < 0:
                    order[w] = low[w] = clock
                    clock += 1
                    children += v == root
                    stack.append((w, v, iter(neighbours[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[v])
                    if parent != root and low[v] >= order[parent]:
                        found.add(parent)
        if children > 1:
            found.add(root)
    return sorted(found)


def _kernel(pdf):
    """Rows of one table: edges (tag e: a -> b) and vertices (tag v: a, capacity, b = 1 source, 2 sink)."""
    import pandas as pd

    v = pdf[pdf.tag == "v"].sort_values("a")
    ids = v.a.to_numpy()
    at = {int(x): i for i, x in enumerate(ids)}
    edges = sorted({(at[int(a)], at[int(b)]) for a, b in zip(*(pdf[pdf.tag == "e"][c] for c in "ab"))})
    role = v.b.to_numpy()
    _, cut = vertex_cut(len(ids), edges, v.cap.tolist(), {i for i, r in enumerate(role) if r == 1}, {i for i, r in enumerate(role) if r == 2})
    near: list[list[int]] = [[] for _ in ids]
    for a, b in sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges}):
        near[a].append(b)
    art = articulation_points(len(ids), near)
    picked = sorted({*cut, *art})
    is_cut, is_art = set(cut), set(art)
    return pd.DataFrame({"scc": [int(ids[i]) for i in picked], "cut": [i in is_cut for i in picked], "articulation": [i in is_art for i in picked]}).astype({"scc": "int64", "cut": bool, "articulation": bool})


def _piece_kernel(table):
    yield _kernel(table.to_pandas())


def pick_sources(graph: Graph, mode: str = "exported-theorems") -> DataFrame:
    public = graph.nodes.where("access = 'public'")
    if mode == "exported-theorems":
        out = public.where((F.col("kind") != "other") & ~names.is_foundational(F.col("module")))
    elif mode == "all-public":
        out = public
    elif mode == "terminals":
        out = graph.terminals()
    else:
        raise ValueError(f"unknown sources: {mode}")
    return out.select(F.col("def_id").alias("node"))


def chokepoints(graph: Graph, sources: str = "exported-theorems", sinks: str | None = None, exclude_names: str = "") -> DataFrame:
    """``node, cut, articulation, upstream, downstream, score``: components in the minimum cut from results to assumptions, or whose loss parts the graph.

    A vertex costs 1 / (line + 1) of its least member (1 without a line), so the cut prefers some lines; the node is
    the least member. Sinks are assumptions (``postulates-axioms``); if none is given and these are missing or all
    sources themselves, the components that use nothing (``terminal-leaves``). score = upstream x downstream of cut
    vertices, half as much again for articulation points; other articulation points score 0. The flow is one task for each
    weak component of the condensation, as augmenting paths follow each other; cuts of different components do not meet.
    """
    scc, dag = condensed(graph)
    lift = lambda df: df.join(scc, "node").select("scc").distinct()
    src = materialise(lift(pick_sources(graph, sources)), "sources")
    if src.isEmpty():
        raise ValueError(f"no sources: {sources}")
    axioms = lift(graph.nodes.where("state = 'P'").select(F.col("def_id").alias("node"))).join(src, "scc", "left_anti")
    leaves = scc.select("scc").distinct().join(dag.select(F.col("src").alias("scc")), "scc", "left_anti").join(src, "scc", "left_anti")
    if sinks not in (None, "postulates-axioms", "terminal-leaves"):
        raise ValueError(f"unknown sinks: {sinks}")
    dst = materialise(leaves if sinks == "terminal-leaves" or (sinks is None and axioms.isEmpty()) else axioms, "sinks")
    if dst.isEmpty():
        raise ValueError("no sinks apart from the sources; choose other sources or sinks")
    first = scc.groupBy("scc").agg(F.min("node").alias("node")).join(graph.nodes.select(F.col("def_id").alias("node"), "line"), "node")
    v = first.join(src.withColumn("s", F.lit(1)), "scc", "left").join(dst.withColumn("t", F.lit(2)), "scc", "left")
    v = v.select(F.lit("v").alias("tag"), F.col("scc").alias("a"), F.coalesce("s", "t", F.lit(0)).cast("long").alias("b"), F.when(F.col("line").isNull(), 1.0).otherwise(1.0 / (F.col("line") + 1)).alias("cap"))
    v, schema = materialise(v, "vertices"), "scc long, cut boolean, articulation boolean"
    d = deal(dag, KERNEL_EDGES)  # vertices without an edge are neither
    both = v.join(d.at.toDF("a", "piece").hint("merge"), "a").select("piece", "tag", "a", "b", "cap").union(d.edges.select("piece", F.lit("e"), "src", "dst", F.lit(0.0)))
    picked = by_piece(both, _piece_kernel, schema, d.tasks)
    if d.giant is not None:
        far = d.giant.select(F.col("src").alias("a")).union(d.giant.select("dst")).distinct()
        picked = picked.union(one_task(v.join(far, "a", "left_semi").select("tag", "a", "b", "cap").union(d.giant.select(F.lit("e"), "src", "dst", F.lit(0.0))), _kernel, schema))
    found = materialise(picked.join(first.select("scc", "node"), "scc"), "choke")
    whole = deal(graph.edges, KERNEL_EDGES)
    count = lambda reverse, c: wide_closure(graph.edges, found.select(F.col("node").alias("seed")), reverse, dealt=whole).groupBy(F.col("seed").alias("node")).agg(F.count("*").alias(c))
    out = found.join(count(True, "upstream"), "node", "left").join(count(False, "downstream"), "node", "left").fillna(0, ["upstream", "downstream"])
    score = F.when(F.col("cut"), F.col("upstream") * F.col("downstream") * F.when(F.col("articulation"), 1.5).otherwise(1.0)).otherwise(0.0)
    kept = without_names(graph.nodes, exclude_names).select(F.col("def_id").alias("node"))
    return out.join(kept, "node", "left_semi").select("node", "cut", "articulation", "upstream", "downstream", score.alias("score"))
