"""Module cohesion and shared subterms: plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.plans.graph import Graph


def strata(graph: Graph, min_size: int = 3, exclude_modules: str = "", abstract_kinds: tuple[str, ...] = ("datatype", "record", "postulate")) -> DataFrame:
    """Per module: cohesion, coupling, instability, abstractness, distance, incoherence and the modal sibling leak.

    Edges are internal, to an enclosing module (neither internal nor external), or external. Order: by
    incoherence, then module.
    """
    nodes = graph.nodes
    if exclude_modules:
        nodes = nodes.where(~F.col("module").rlike(exclude_modules))
    mods = nodes.groupBy("module").agg(F.count("*").alias("size"), F.count_if(F.col("kind").isin(*abstract_kinds)).alias("abstract_n"))
    at = nodes.select("def_id", "module")
    e = graph.edges.select("src", "dst").join(at.toDF("src", "ms"), "src").join(at.toDF("dst", "mt"), "dst")
    e = e.withColumn("cls", F.when(F.col("ms") == F.col("mt"), "internal").when(names.is_module_prefix(F.col("mt"), F.col("ms")), "parent").otherwise("external"))
    a, b = F.split("ms", r"\."), F.split("mt", r"\.")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda n: F.slice("a", F.lit(1), n) == F.slice("b", F.lit(1), n)))
    e = e.withColumns({"a": a, "b": b}).withColumn("same", same)
    prefix = F.when(F.col("same") == 0, F.element_at("b", 1)).otherwise(F.array_join(F.slice("b", F.lit(1), F.col("same")), "."))
    sibling = F.when((F.size("a") > 1) & (F.col("same") == F.size("a") - 1) & (F.size("b") >= F.size("a")), F.array_join(F.slice("b", F.lit(1), F.size("a")), "."))
    e = e.withColumns({"prefix": prefix, "sibling": sibling})
    ext = F.col("cls") == "external"
    out = e.groupBy(F.col("ms").alias("module")).agg(
        F.count_if(F.col("cls") == "internal").alias("internal"), F.count_if(ext).alias("external"),
        F.count_distinct(F.when(ext, F.col("prefix"))).alias("spread"), F.count_distinct(F.when(ext, F.col("mt"))).alias("ce"),
    )
    into = e.where(ext).groupBy(F.col("mt").alias("module")).agg(F.count_distinct("ms").alias("ca"))
    sib = e.where(ext & F.col("sibling").isNotNull()).groupBy(F.col("ms").alias("module"), "sibling").agg(F.count("*").alias("sibling_hits"))
    sib = sib.withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("sibling_hits"), "sibling"))).where("rn = 1").drop("rn")
    m = mods.join(out, "module", "left").join(into, "module", "left").join(sib, "module", "left").fillna(0, ["internal", "external", "spread", "ce", "ca", "sibling_hits"])
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.nullif(y, F.lit(0)))
    within = F.col("internal") + F.col("external")
    m = m.withColumns({
        "lcom": F.when(within == 0, 0.0).otherwise(1 - ratio(F.col("internal"), within)),
        "instability": ratio(F.col("ce"), F.col("ca") + F.col("ce")), "abstractness": ratio(F.col("abstract_n"), F.col("size")),
    })
    m = m.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    m = m.withColumn("incoherence", F.col("lcom") * F.log(1.0 + F.col("spread")) * F.abs(F.col("distance") - (1 - F.col("instability"))))
    return m.where(F.col("size") >= min_size).drop("abstract_n")


def term_clusters(subterms: DataFrame, nodes: DataFrame, min_cluster: int = 2, min_span: int = 1) -> DataFrame:
    """Per subterm hash: occurrences, definitions, modules, mean depth, module diversity and score = size x mean depth x (1 + diversity).

    A missing depth counts as 1. Diversity is entropy over modules divided by ln(min(modules, 10)), 0 for one.
    """
    t = subterms.select("def_id", "hash", F.coalesce("depth", F.lit(1)).alias("depth")).join(nodes.select("def_id", "module"), "def_id")
    per = t.groupBy("hash", "module").agg(F.count("*").alias("c"), F.sum("depth").alias("ds"), F.count_distinct("def_id").alias("defs"))
    total = per.groupBy("hash").agg(F.sum("c").alias("size"), F.sum("defs").alias("n_defs"), F.count("*").alias("n_modules"), F.sum("ds").alias("ds"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    total = total.where((F.col("size") >= min_cluster) & (F.col("n_modules") >= min_span))
    entropy = F.log("size") - F.col("clogc") / F.col("size")
    div = F.when(F.col("n_modules") <= 1, 0.0).otherwise(entropy / F.log(F.least("n_modules", F.lit(10))))
    total = total.withColumns({"mean_depth": F.col("ds") / F.col("size"), "diversity": div})
    return total.select("hash", "size", "n_defs", "n_modules", "mean_depth", "diversity", (F.col("size") * F.col("mean_depth") * (1 + F.col("diversity"))).alias("score"))


def exact_duplicates(subterms: DataFrame, nodes: DataFrame) -> DataFrame:
    """``bag, sig, members, size``: definitions with equal hash multisets and equal (or equally missing) signatures, two or more."""
    bags = subterms.groupBy("def_id").agg(F.array_sort(F.collect_list("hash")).alias("bag"))
    own = bags.join(nodes.select("def_id", "sig"), "def_id").withColumn("key", F.sha2(F.to_json(F.struct("bag")), 256))
    out = own.groupBy("key", "sig").agg(F.array_sort(F.collect_list("def_id")).alias("members"), F.first(F.size("bag")).alias("bag_size"))
    return out.withColumn("size", F.size("members")).where("size >= 2")


def graph_stats(graph: Graph) -> DataFrame:
    """``axis, value, n``: all nodes, by state and by kind, in one pass over grouping sets."""
    n = graph.nodes.select("state", "kind").groupingSets([[], ["state"], ["kind"]], "state", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "state").otherwise("kind")
    return n.select(axis.alias("axis"), F.coalesce(F.when(F.col("g") == 1, F.col("state")), F.when(F.col("g") == 2, F.col("kind")), F.lit("")).alias("value"), "n")
