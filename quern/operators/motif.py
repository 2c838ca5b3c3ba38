"""Recurring labelled shapes: connected induced subgraphs, grown by joins, keyed up to isomorphism and counted by minimum image."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.graph import Graph
from quern.session import materialise, ship


def embeddings(edges: DataFrame, active: DataFrame, min_size: int, max_size: int, fan_out: int) -> DataFrame:
    """``members``: sorted ids of connected sets, each grown from its least member by one of the first ``fan_out`` ids around it at a time."""
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    near = near.union(near.select("b", "a")).distinct().join(active.withColumnRenamed("node", "a"), "a", "left_semi").join(active.withColumnRenamed("node", "b"), "b", "left_semi")
    near = materialise(near.select("a", "b"), "near")
    cur = active.select(F.array("node").alias("members"))
    found = [cur] if min_size <= 1 else []
    for size in range(2, max_size + 1):
        around = cur.select("members", F.explode("members").alias("a")).join(near, "a").select("members", "b").distinct()
        around = around.where((F.col("b") > F.element_at("members", 1)) & ~F.array_contains("members", F.col("b")))
        first = around.withColumn("at", F.row_number().over(Window.partitionBy("members").orderBy("b"))).where(F.col("at") <= fan_out)
        cur = materialise(first.select(F.array_sort(F.array_append("members", F.col("b"))).alias("members")).distinct(), "embeddings")
        if size >= min_size:
            found.append(cur)
    return reduce(DataFrame.union, found)


def shape_key(labels: list[str], edges: list[tuple[int, int]]) -> tuple[str, bool]:
    """(a key that equal labelled shapes share, whether the shape is a plain chain of one colour): four rounds of colour refinement."""
    digest = lambda x: hashlib.blake2b(repr(x).encode(), digest_size=8).hexdigest()
    colour = list(labels)
    for _ in range(4):
        around = [sorted([(1, colour[b]) for a, b in edges if a == i] + [(-1, colour[a]) for a, b in edges if b == i]) for i in range(len(labels))]
        colour = [digest((c, n)) for c, n in zip(colour, around)]
    pairs = sorted((colour[a], colour[b]) for a, b in edges)
    touching = {c: sum((a == c) + (b == c) for a, b in pairs) for c in colour}
    chain = len(pairs) == len(labels) - 1 and all(n <= 2 for n in touching.values())
    return digest((sorted(colour), pairs)), len(labels) <= 3 and chain and len(touching) <= 1


def motifs(graph: Graph, min_support: int = 3, min_size: int = 2, max_size: int = 3, fan_out: int = 32, min_labels: int = 2, hub_percent: float = 0.0) -> DataFrame:
    """``key, size, support, score, labels, example, modules``: shapes over (kind, state) labels that recur.

    Support is the least, over the slots of a shape in ascending order of ids, of how many nodes stand in it;
    score = support x max(0, size - 2). Left out: shapes of one module only, plain chains up to three nodes of one
    colour, and shapes with fewer than ``min_labels`` labels. ``hub_percent`` of the nodes, those of most edges, take no part.
    """
    ship(graph.spark)
    nodes = graph.nodes.select(F.col("def_id").alias("node"), F.concat_ws("/", "kind", "state").alias("label"), "module")
    e = materialise(graph.edges.select("src", "dst").distinct(), "edges")
    active = nodes.select("node")
    if hub_percent > 0:
        n = int(hub_percent / 100 * nodes.count())
        degree = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("d"))
        hubs = nodes.select("node").join(degree, "node", "left").fillna(0).orderBy(F.desc("d"), "node").limit(n).select("node")
        active = active.join(hubs, "node", "left_anti")
    found = materialise(embeddings(e, materialise(active, "active"), min_size, max_size, fan_out), "found")
    slot = found.select("members", F.posexplode("members").alias("pos", "node")).join(nodes, "node")
    about = slot.groupBy("members").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"))
    inside = found.select("members", F.explode("members").alias("src")).join(e, "src").where(F.array_contains("members", F.col("dst")) & (F.col("src") != F.col("dst")))
    at = lambda c: (F.array_position("members", F.col(c)) - 1).cast("int")
    inner = inside.select("members", F.struct(at("src").alias("a"), at("dst").alias("b")).alias("e")).groupBy("members").agg(F.sort_array(F.collect_list("e")).alias("es"))
    shaped = about.join(inner, "members", "left").select("members", F.transform("l", lambda x: x["label"]).alias("labels"), F.coalesce("es", F.array().cast("array<struct<a:int,b:int>>")).alias("es"))

    @F.pandas_udf("struct<key: string, dull: boolean>")
    def keyed(labels: pd.Series, edges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_key(list(x), [(y["a"], y["b"]) for y in z]) for x, z in zip(labels, edges)], columns=["key", "dull"])

    k = materialise(shaped.select("members", "labels", keyed("labels", "es").alias("k")).select("members", "labels", "k.key", "k.dull", F.size("members").alias("size")), "shapes")
    images = k.select("key", F.posexplode("members").alias("pos", "node")).groupBy("key", "pos").agg(F.count_distinct("node").alias("n")).groupBy("key").agg(F.min("n").alias("support"))
    spread = k.select("key", F.explode("members").alias("node")).join(nodes.select("node", "module"), "node").groupBy("key").agg(F.count_distinct("module").alias("modules"))
    one = k.groupBy("key").agg(F.min(F.struct("members", "labels")).alias("x"), F.first("size").alias("size"), F.first("dull").alias("dull"))
    out = one.join(images, "key").join(spread, "key").where((F.col("support") >= min_support) & (F.col("modules") >= 2) & ~F.col("dull"))
    out = out.where(F.size(F.array_distinct("x.labels")) >= min_labels)
    score = F.col("support") * F.greatest(F.lit(0), F.col("size") - 2)
    return out.select("key", "size", "support", score.alias("score"), F.array_sort("x.labels").alias("labels"), F.col("x.members").alias("example"), "modules")
