"""Co-usage mining over baskets ``(owner, item)``: association rules, entanglement, concept bundles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.plans.graph import Graph
from quern.session import materialise


def usage_baskets(graph: Graph, provenance: str | None = None, real_only: bool = True, drop_kinds: tuple[str, ...] = ("constructor", "postulate")) -> DataFrame:
    """A basket per definition: what it uses directly. Self-uses stay."""
    edges = graph.by_provenance(provenance) if provenance else graph.edges
    items = graph.nodes.where(F.col("is_real") | (not real_only))
    if drop_kinds:
        items = items.where(~F.col("kind").isin(*drop_kinds))
    owners = graph.nodes.where(F.col("is_real") | (not real_only)).select(F.col("def_id").alias("src"))
    kept = edges.select("src", "dst").distinct().join(owners, "src", "left_semi")
    return kept.join(items.select(F.col("def_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("owner"), F.col("dst").alias("item"))


def qualifying(baskets: DataFrame, least: int = 2, cap: int | None = 64) -> DataFrame:
    """Baskets of ``least`` to ``cap`` distinct items; the cap is part of the analysis and None lifts it."""
    b = baskets.select("owner", "item").distinct()
    size = b.groupBy("owner").agg(F.count("*").alias("n"))
    return b.join(size.where((F.col("n") >= least) & (F.col("n") <= (cap or 2**62))).select("owner"), "owner", "left_semi")


def erfc(x: Column) -> Column:
    """Abramowitz and Stegun's rational approximation 7.1.26, for x >= 0."""
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def _pairs(b: DataFrame) -> DataFrame:
    x, y = b.toDF("owner", "a"), b.toDF("owner", "b")
    return x.join(y, "owner").where("a < b")


def top_items(b: DataFrame, share: float) -> DataFrame:
    """Exactly ``ceil(share * items)`` (one at least) most frequent items; ties by item."""
    counts = b.groupBy("item").agg(F.count("*").alias("c"))
    n = counts.count()
    take = max(1, math.ceil(share * n)) if share > 0 and n else 0
    return counts.orderBy(F.desc("c"), "item").limit(take).select("item")


def association_rules(baskets: DataFrame, min_support: float = 0.05, min_confidence: float = 0.6, min_lift: float = 1.5, exclude_top: float = 0.05, cap: int = 64, alpha: float = 0.01, triples: bool = True) -> DataFrame:
    """``lhs, rhs, joint, support, confidence, lift, p, p_corrected``: rules of one or two items to one.

    Support is a share of the qualifying baskets; p is the chi-square tail, corrected by the number of all
    candidate rules. Triples are counted only where all their pairs are frequent.
    """
    b = materialise(qualifying(baskets, 2, cap), "baskets")
    n = b.select("owner").distinct().count()
    least = max(1, math.ceil(min_support * n))
    one = b.groupBy("item").agg(F.count("*").alias("s"))
    freq = b.join(one.where(F.col("s") >= least).select("item"), "item", "left_semi").select("owner", "item")
    pair_rows = _pairs(freq)
    two = materialise(pair_rows.groupBy("a", "b").agg(F.count("*").alias("joint")).where(F.col("joint") >= least), "pairs")
    rules = two.select(F.explode(F.array(F.struct(F.array("a").alias("lhs"), F.col("b").alias("rhs")), F.struct(F.array("b").alias("lhs"), F.col("a").alias("rhs")))).alias("r"), "joint")
    if triples:
        ok = two.select("a", "b")
        p = pair_rows.join(ok, ["a", "b"], "left_semi")
        t = p.join(p.select("owner", F.col("a").alias("b"), F.col("b").alias("c")), ["owner", "b"]).join(ok.toDF("a", "c"), ["a", "c"], "left_semi")
        three = t.groupBy("a", "b", "c").agg(F.count("*").alias("joint")).where(F.col("joint") >= least)
        forms = [F.struct(F.array(x, y).alias("lhs"), F.col(z).alias("rhs")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))]
        rules = rules.union(three.select(F.explode(F.array(*forms)).alias("r"), "joint"))
    rules = materialise(rules.select("r.lhs", "r.rhs", "joint"), "rules")
    tested = rules.count()
    left = one.select(F.array("item").alias("lhs"), F.col("s").alias("sl")).union(two.select(F.array("a", "b"), "joint"))
    r = rules.join(left, "lhs").join(one.toDF("rhs", "sr"), "rhs")
    total = F.lit(float(n))
    a, sl, sr = (F.col(c).cast("double") for c in ("joint", "sl", "sr"))
    det = a * (total - sl - sr + a) - (sl - a) * (sr - a)
    den = sl * (total - sl) * sr * (total - sr)
    p_raw = F.when((sl >= total) | (sr >= total) | (den <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), erfc(F.sqrt(total * det * det / den / 2)))))
    r = r.withColumns({"support": a / total, "confidence": a / sl, "lift": (a / sl) / (sr / total), "p": p_raw})
    banned = top_items(b, exclude_top).agg(F.collect_set("item").alias("banned"))  # a share of the items; one row
    r = r.crossJoin(F.broadcast(banned)).where(~F.arrays_overlap(F.array_append("lhs", F.col("rhs")), "banned"))
    r = r.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * tested))
    return r.where(F.col("p_corrected") <= alpha).select("lhs", "rhs", "joint", "support", "confidence", "lift", "p", "p_corrected")


def near_misses(baskets: DataFrame, rules: DataFrame, top: int = 5, shown: int = 3, cap: int = 64) -> DataFrame:
    """For the ``top`` bundles of rules with two items on the left: up to ``shown`` baskets that lack exactly one item."""
    bundle = F.array_sort(F.array_union("lhs", F.array("rhs")))
    best = rules.where(F.size("lhs") >= 2).select(bundle.alias("bundle"), (F.col("support") * F.col("confidence")).alias("w")).groupBy("bundle").agg(F.max("w").alias("w"))
    best = best.orderBy(F.desc("w"), "bundle").limit(top)
    parts = best.select("bundle", F.explode("bundle").alias("item"))
    held = parts.join(qualifying(baskets, 2, cap), "item").groupBy("bundle", "owner").agg(F.collect_set("item").alias("has"))
    miss = held.where(F.size("has") == F.size("bundle") - 1)
    miss = miss.withColumn("rn", F.row_number().over(Window.partitionBy("bundle").orderBy("owner"))).where(F.col("rn") <= shown)
    return miss.select("bundle", "owner", F.element_at(F.array_except("bundle", "has"), 1).alias("missing"))


def entwined_pairs(baskets: DataFrame, min_joint: int = 3, min_iqr: float = 0.5, min_g: float = 6.635, cap: int | None = None) -> DataFrame:
    """``x, y, n11, n10, n01, n00, mi, h, iqr, g, anti`` of item pairs over 2 x 2 tables, mutual information in bits."""
    b = materialise(qualifying(baskets, 1, cap), "baskets")
    n = b.select("owner").distinct().count()
    one = b.groupBy("item").agg(F.count("*").alias("c"))
    p = _pairs(b).groupBy("a", "b").agg(F.count("*").alias("n11")).where(F.col("n11") >= min_joint)
    p = p.join(one.toDF("a", "nx"), "a").join(one.toDF("b", "ny"), "b")
    zero = F.lit(0).cast("long")
    p = p.withColumns({"n10": F.greatest(zero, F.col("nx") - F.col("n11")), "n01": F.greatest(zero, F.col("ny") - F.col("n11")), "n00": F.greatest(zero, F.lit(n) - F.col("nx") - F.col("ny") + F.col("n11"))})
    nd = float(max(n, 1))
    px, py = F.col("nx") / nd, F.col("ny") / nd
    cells = {"n11": (px, py), "n10": (px, 1 - py), "n01": (1 - px, py), "n00": (1 - px, 1 - py)}
    log2 = lambda x: F.log(x) / math.log(2)
    mi, h, g = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c, (u, v) in cells.items():
        q, o = F.col(c) / nd, F.col(c).cast("double")
        mi = mi + F.when((q > 0) & (u > 0) & (v > 0), q * log2(q / (u * v))).otherwise(0.0)
        h = h + F.when(q > 0, -q * log2(q)).otherwise(0.0)
        g = g + F.when((o > 0) & (u > 0) & (v > 0), o * F.log(q / (u * v))).otherwise(0.0)
    flat = (F.col("nx") >= n) | (F.col("ny") >= n)
    p = p.withColumns({"mi": mi, "h": h}).withColumns({"iqr": F.when(F.col("h") <= 0, 0.0).otherwise(F.col("mi") / F.col("h")), "g": F.when(flat, 0.0).otherwise(2 * g)})
    anti = (F.col("n10") + F.col("n01") > F.col("n11")) & (F.col("n11") < F.least("nx", "ny"))
    return p.where((F.col("iqr") >= min_iqr) & (F.col("g") >= min_g)).select(F.col("a").alias("x"), F.col("b").alias("y"), "n11", "n10", "n01", "n00", "mi", "h", "iqr", "g", anti.alias("anti"))


def concept_bundles(baskets: DataFrame, owners: DataFrame, min_support: int = 3, min_lift: float = 2.0, min_span: int = 3, k: int = 3, cap: int = 64) -> DataFrame:
    """``items, support, lift, span, specificity``: frequent sets of two to ``k`` (four at most) items, with the modules ``owners(owner, module)`` span.

    specificity = support x lift x ln(span + 1). Larger sets are counted only where their subsets are frequent.
    """
    b = materialise(qualifying(baskets, 2, cap), "baskets")
    n = b.select("owner").distinct().count()
    one = b.groupBy("item").agg(F.count("*").alias("s")).where(F.col("s") >= min_support)
    b = b.join(one.select("item"), "item", "left_semi").select("owner", "item")
    rows, found = b.select("owner", F.array("item").alias("items")), []
    frequent = one.select(F.array("item").alias("items"))
    for size in range(2, min(k, 4) + 1):
        rows = rows.join(b, "owner").where(F.col("item") > F.element_at("items", -1)).select("owner", F.array_append("items", F.col("item")).alias("items"))
        if size > 2:  # all subsets less one item must be frequent
            for gone in range(1, size + 1):
                sub = F.concat(F.slice("items", 1, gone - 1), F.slice("items", gone + 1, size)) if 1 < gone < size else F.slice("items", 2, size - 1) if gone == 1 else F.slice("items", 1, size - 1)
                rows = rows.withColumn("sub", sub).join(frequent.withColumnRenamed("items", "sub"), "sub", "left_semi").drop("sub")
        frequent = materialise(rows.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= min_support), "frequent")
        rows = materialise(rows.join(frequent, "items", "left_semi").select("owner", "items"), "bundles")
        span = rows.join(owners, "owner").groupBy("items").agg(F.count_distinct("module").alias("span"))
        found.append(frequent.join(span, "items"))
        frequent = frequent.select("items")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    share = out.select("items", F.explode("items").alias("item")).join(one, "item").groupBy("items").agg(F.sum(F.log(F.col("s") / float(max(n, 1)))).alias("logs"))
    out = out.join(share, "items").withColumn("lift", (F.col("support") / float(max(n, 1))) / F.exp("logs"))
    out = out.where((F.col("lift") >= min_lift) & (F.col("span") >= min_span))
    return out.select("items", "support", "lift", "span", (F.col("support") * F.col("lift") * F.log(F.col("span") + 1.0)).alias("specificity"))


def family_forced(bundles: DataFrame, nodes: DataFrame, share: float = 0.5, items: str = "items") -> DataFrame:
    """``items``: the bundles of which one ``stem-digits`` family (the bare stem counts) covers ``share`` with two members or more."""
    named = nodes.select(F.col("def_id").alias("item"), names.last_segment(F.col("name")).alias("short"))
    flat = bundles.select(items, F.explode(items).alias("item")).join(named, "item").withColumn("stem", F.coalesce(names.family(F.col("short")), F.col("short")))
    tagged = flat.withColumn("numbered", names.family(F.col("short")).isNotNull())
    fam = tagged.groupBy(items, "stem").agg(F.count("*").alias("c"), F.max("numbered").alias("any_number"))
    return fam.where((F.col("c") >= 2) & F.col("any_number") & (F.col("c") >= share * F.size(items))).select(items).distinct()
