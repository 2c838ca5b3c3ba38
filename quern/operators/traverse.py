"""Reachability: semi-naive closure, filtered distances, shortest paths, components, strong components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.pieces import by_piece, deal, wide_closure
from quern.session import discard, materialise, ship

#: Weak components of so many edges at most are one task's; larger ones are treated by joins.
KERNEL_EDGES = 2_000_000


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False, hops: int | None = None, keep_seed: bool = False, first: DataFrame | None = None) -> DataFrame:
    """``seed, node, depth``: what each ``seeds(seed)`` reaches over ``edges(src, dst)``, with hop distance.

    Seeds are pushed down: only their reach is computed. A seed is not in its own closure, even on a cycle,
    unless ``keep_seed``. ``first`` replaces the edges of the first hop. Each round joins the newest nodes only
    and is written to the shared folder.
    """
    step = lambda e: e.select(F.col("dst" if reverse else "src").alias("a"), F.col("src" if reverse else "dst").alias("b")).distinct()
    hop = step(edges)
    new = materialise(seeds.select("seed").where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")), "reach")
    found, depth = [new], 0
    while hops is None or depth < hops:
        over = step(first) if first is not None and depth == 0 else hop
        depth += 1
        nxt = new.join(over, new.node == over.a).select("seed", F.col("b").alias("node")).distinct()
        seen = reduce(DataFrame.union, found).select("seed", "node")
        new = materialise(nxt.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(depth).alias("depth")), "reach")
        if new.isEmpty():
            break
        found.append(new)
        if len(found) > 12:
            found = [materialise(reduce(DataFrame.union, found), "reach")]
    out = reduce(DataFrame.union, found)
    return out if keep_seed else out.where("node <> seed")


def every_closure(edges: DataFrame, reverse: bool = False, **options) -> DataFrame:
    """The closure of every node that has an edge to start with."""
    return wide_closure(edges, edges.select(F.col("dst" if reverse else "src").alias("seed")), reverse, **options)


def shortest_paths(edges: DataFrame, source: int, target: int, k: int = 3, allowed: DataFrame | None = None) -> DataFrame:
    """``rank, path``: up to ``k`` minimal-length paths in ascending order of ids; inner nodes are ``allowed`` ones."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(1, [source])], "rank int, path array<long>")
    if allowed is not None:
        ok = allowed.select("def_id").union(spark.createDataFrame([(source,), (target,)], "def_id long")).distinct()
        edges = edges.join(ok.withColumnRenamed("def_id", "src"), "src", "left_semi").join(ok.withColumnRenamed("def_id", "dst"), "dst", "left_semi")
    one = spark.createDataFrame([(source,)], "seed long")
    there = closure(edges, one, keep_seed=True).select(F.col("node"), F.col("depth"))
    end = there.where(F.col("node") == target).first()
    if end is None:
        return spark.createDataFrame([], "rank int, path array<long>")
    back = closure(edges, spark.createDataFrame([(target,)], "seed long"), reverse=True, keep_seed=True).select(F.col("node"), F.col("depth").alias("left"))
    # nodes on some shortest path, layer by layer; each prefix kept is one of the k least, as all can be completed
    on = materialise(there.join(back, "node").where(F.col("depth") + F.col("left") == end.depth).select("node", "depth"), "layers")
    paths = spark.createDataFrame([([source],)], "path array<long>")
    for d in range(1, end.depth + 1):
        layer = on.where(F.col("depth") == d).select(F.col("node").alias("b"))
        hop = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().join(layer, "b", "left_semi")
        paths = materialise(paths.join(hop, F.element_at("path", -1) == hop.a).select(F.concat("path", F.array("b")).alias("path")).orderBy("path").limit(k), "paths")
    return paths.select(F.row_number().over(Window.orderBy("path")).alias("rank"), "path")


def witness_paths(edges: DataFrame, source: int) -> DataFrame:
    """``node, path``: a shortest path from the source to each node it reaches, of equal ones the least by ids; the source's own is itself.

    This is the tree of a breadth-first search that takes neighbours in ascending order, as the order of discovery
    within a layer is that of the paths.
    """
    hop = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    new = materialise(edges.sparkSession.createDataFrame([(source, [source])], "node long, path array<long>"), "witness")
    found = [new]
    while True:
        nxt = new.join(hop, new.node == hop.a).select(F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.union, found).select("node")
        new = materialise(nxt.join(seen, "node", "left_anti"), "witness")
        if new.isEmpty():
            return reduce(DataFrame.union, found)
        found.append(new)


def _digest(edges: DataFrame) -> tuple:
    """Number and combined hashes of distinct edges: equal tables, equal digests."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, root``: connected components of the nodes with an edge to another, labelled by their least node.

    Alternating large-star and small-star contraction: each round is two grouped minima, no node's
    neighbourhood is ever gathered in one row, and every round's edges are written to the shared folder.
    """
    cur = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):  # in the end every node hangs on its root
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
        small = large.join(small_min, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = materialise(small, "edges")
        same = _digest(nxt) == _digest(cur)
        discard(cur)
        cur = nxt
        if same:
            done = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return done.union(cur.select("v", F.col("v")).distinct())
    raise RuntimeError("components: no fixed point within max_rounds")


def tarjan(n: int, heads: list[list[int]]) -> list[int]:
    """Strong component of each of ``n`` nodes, numbered in reverse topological order; iterative."""
    index, low, comp, stack, on = [-1] * n, [0] * n, [-1] * n, [], [False] * n
    count = found = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            for j in range(i, len(heads[v])):
                w = heads[v][j]
                if index[w] < 0:
                    work += [(v, j + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        on[w], comp[w] = False, found
                        if w == v:
                            break
                    found += 1
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return comp


def one_task(edges: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(pandas edges) -> pandas`` on the whole edge table in a single task."""
    import pandas as pd

    ship(edges.sparkSession)

    def run(batches):
        parts = list(batches)
        yield kernel(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=cols))

    cols = edges.columns
    return edges.coalesce(1).mapInPandas(run, schema)


def _tarjan_kernel(table):
    import numpy as np
    import pandas as pd

    src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
    nodes = np.unique(np.concatenate((src, dst)))
    heads: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(np.searchsorted(nodes, src).tolist(), np.searchsorted(nodes, dst).tolist()):
        heads[a].append(b)
    comp = pd.Series(tarjan(len(nodes), heads), dtype="int64")
    yield pd.DataFrame({"node": nodes, "scc": pd.Series(nodes).groupby(comp).transform("min").astype("int64")})


def strong_components(edges: DataFrame, limit: int = KERNEL_EDGES) -> DataFrame:
    """``node, scc``: strong components of the nodes with edges, named by their least node; stored.

    Each weak component is one task's; those of more than ``limit`` edges are coloured by joins.
    """
    d = deal(edges, limit)
    out = materialise(by_piece(d.edges, _tarjan_kernel, "node long, scc long", d.tasks), "scc")
    if d.giant is not None:
        out = out.union(materialise(colouring_components(d.giant), "scc"))
    alone = materialise(edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(out.hint("merge"), "node", "left_anti"), "alone")
    return out.union(alone.select("node", F.col("node").alias("scc")))


def _spread(label: DataFrame, hop: DataFrame) -> DataFrame:
    """The least label that reaches each node over ``hop(a, b)``, its own included."""
    while True:
        near = hop.join(label.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        nxt = materialise(label.join(near, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label")), "labels")
        if nxt.join(label, ["node", "label"], "left_anti").isEmpty():
            return nxt
        label = nxt


def colouring_components(edges: DataFrame) -> DataFrame:
    """As :func:`strong_components`, by joins only: the least id that reaches a node colours it; those of a colour
    that reach the colour's own node backwards are one component; the rest goes on."""
    live = materialise(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct(), "live")
    todo = materialise(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "todo")
    done = []
    while not todo.isEmpty():
        colour = _spread(todo.select("node", F.col("node").alias("label")), live)
        named = live.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb")
        back = materialise(named.select(F.col("b").alias("src"), F.col("a").alias("dst")), "back")
        inside = closure(back, colour.where("node = label").select(F.col("node").alias("seed")), keep_seed=True)
        part = materialise(inside.select("node", F.col("seed").alias("scc")), "part")
        done.append(part)
        todo = materialise(todo.join(part, "node", "left_anti"), "todo")
        live = materialise(live.join(todo.withColumnRenamed("node", "a"), "a", "left_semi").join(todo.withColumnRenamed("node", "b"), "b", "left_semi"), "live")
    least = reduce(DataFrame.union, done) if done else todo.select("node", F.col("node").alias("scc"))
    # the colour's node is the least id reaching the component, so also its least member
    return least


def condensation(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """``src, dst``: distinct edges between different strong components."""
    a, b = scc.toDF("src", "ca"), scc.toDF("dst", "cb")
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()


def longest_depth(dag: DataFrame, nodes: DataFrame, reverse: bool = False, stops: DataFrame | None = None) -> DataFrame:
    """``node, depth``: the longest path from each node to a node without edges on (``reverse``: from one without edges in).

    With ``stops(node)``: those are 0 and end paths, and nodes that reach none are left out.
    """
    hop = dag.select(F.col("dst" if reverse else "src").alias("a"), F.col("src" if reverse else "dst").alias("b"))
    if stops is None:
        cur = nodes.join(hop.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.lit(0).alias("depth"))
        fixed = None
    else:
        fixed = materialise(stops.select("node").distinct(), "stops")
        cur = fixed.select("node", F.lit(0).alias("depth"))
        hop = hop.join(fixed.withColumnRenamed("node", "a"), "a", "left_anti")
    hop = materialise(hop, "hop")
    cur = materialise(cur, "depths")
    wave = cur
    while True:
        new = hop.join(wave.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg((F.max("depth") + 1).alias("depth"))
        old = cur.withColumnRenamed("depth", "was")
        wave = materialise(new.join(old, "node", "left").where("was is null or depth > was").select("node", "depth"), "depths")
        if wave.isEmpty():
            return cur
        cur = materialise(cur.union(wave).groupBy("node").agg(F.max("depth").alias("depth")), "depths")
