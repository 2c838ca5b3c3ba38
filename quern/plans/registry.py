"""Registered queries: operators applied to graphs derived from the star schema, and their SQL twins.

Every query runs over its whole tables. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import cohesion, mining, rank, traverse, trust
from quern.plans import derive
from quern.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTE = f"WITH RECURSIVE nodes AS ({derive.NODES}), edges AS ({derive.DAG})"
CTE_CYCLIC = f"WITH RECURSIVE nodes AS ({derive.NODES}), edges AS ({derive.CYCLIC})"
CTE_SUCCESSION = f"WITH RECURSIVE nodes AS ({derive.NODES}), edges AS ({derive.SUCCESSION})"
#: The closure of every node, forwards, with hop distances; terms end as the derived graph is acyclic.
CLOSURE = "reach(seed, node) AS (SELECT src, dst FROM edges UNION SELECT seed, dst FROM reach JOIN edges ON node = src)"
UP = "up(seed, node) AS (SELECT dst, src FROM edges UNION SELECT seed, src FROM up JOIN edges ON node = dst)"


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["impact_by_module"](spark, sf_dir)


@query("impact_by_module", f"""{CTE}, {UP}
SELECT seed, module, count(*) AS n FROM up JOIN nodes ON node = def_id GROUP BY seed, module""")
def impact_by_module(spark, sf_dir):
    g = derive.star_graph(spark, sf_dir)
    up = traverse.every_closure(g.edges, reverse=True)
    return up.join(g.nodes.select(F.col("def_id").alias("node"), "module"), "node").groupBy("seed", "module").agg(F.count("*").alias("n"))


@query("closure_counts", f"""{CTE}, {CLOSURE}, {UP}
SELECT def_id, coalesce(o.n, 0) AS descendants, coalesce(i.n, 0) AS ancestors FROM nodes
LEFT JOIN (SELECT seed, count(*) AS n FROM reach GROUP BY seed) o ON o.seed = def_id LEFT JOIN (SELECT seed, count(*) AS n FROM up GROUP BY seed) i ON i.seed = def_id""")
def closure_counts(spark, sf_dir):
    g = derive.star_graph(spark, sf_dir)
    c = traverse.every_closure(g.edges)
    down, up = c.groupBy(F.col("seed").alias("def_id")).agg(F.count("*").alias("descendants")), c.groupBy(F.col("node").alias("def_id")).agg(F.count("*").alias("ancestors"))
    return g.nodes.select("def_id").join(down, "def_id", "left").join(up, "def_id", "left").fillna(0)


@query("closure_distances", f"""{CTE}, walk(seed, node, d) AS (SELECT src, dst, 1 FROM edges UNION SELECT seed, dst, d + 1 FROM walk JOIN edges ON node = src)
SELECT seed, node, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY seed, node""")
def closure_distances(spark, sf_dir):
    return traverse.every_closure(derive.star_graph(spark, sf_dir).edges)


@query("closure_cyclic", f"""{CTE_CYCLIC}, {CLOSURE}
SELECT seed, node FROM reach WHERE seed <> node""")
def closure_cyclic(spark, sf_dir):
    return traverse.every_closure(derive.star_graph(spark, sf_dir, derive.CYCLIC).edges).select("seed", "node")


@query("graph_components", f"""{CTE_SUCCESSION}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(seed, node) AS (SELECT a, a FROM both_ways UNION SELECT seed, b FROM reach JOIN both_ways ON node = a)
SELECT seed AS node, min(node) AS root FROM reach GROUP BY seed""")
def graph_components(spark, sf_dir):
    return traverse.components(derive.star_graph(spark, sf_dir, derive.SUCCESSION).edges)


SCC = "scc AS (SELECT n.node AS node, least(n.node, coalesce(min(r.node), n.node)) AS scc FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN (SELECT a.seed, a.node FROM reach a JOIN reach b ON a.seed = b.node AND a.node = b.seed) r ON n.node = r.seed GROUP BY n.node)"


@query("strong_components", f"{CTE_CYCLIC}, {CLOSURE}, {SCC} SELECT node, scc FROM scc")
def strong_components(spark, sf_dir):
    return traverse.strong_components(derive.star_graph(spark, sf_dir, derive.CYCLIC).edges)


@query("strong_components_by_colouring", f"{CTE_CYCLIC}, {CLOSURE}, {SCC} SELECT node, scc FROM scc")
def strong_components_by_colouring(spark, sf_dir):
    return traverse.colouring_components(derive.star_graph(spark, sf_dir, derive.CYCLIC).edges)


@query("condensation_edges", f"{CTE_CYCLIC}, {CLOSURE}, {SCC} SELECT DISTINCT a.scc AS src, b.scc AS dst FROM edges JOIN scc a ON src = a.node JOIN scc b ON dst = b.node WHERE a.scc <> b.scc")
def condensation_edges(spark, sf_dir):
    e = derive.star_graph(spark, sf_dir, derive.CYCLIC).edges
    return traverse.condensation(e, traverse.strong_components(e))


@query("longest_depth", f"""{CTE}, walk(node, depth) AS (SELECT def_id, 0 FROM nodes WHERE def_id NOT IN (SELECT src FROM edges) UNION SELECT src, depth + 1 FROM walk JOIN edges ON node = dst)
SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM walk GROUP BY node""")
def longest_depth(spark, sf_dir):
    g = derive.star_graph(spark, sf_dir)
    return traverse.longest_depth(g.edges, g.nodes.select(F.col("def_id").alias("node")))


@query("terminals", f"{CTE_SUCCESSION} SELECT def_id, name FROM nodes WHERE def_id NOT IN (SELECT dst FROM edges)")
def terminals(spark, sf_dir):
    return derive.star_graph(spark, sf_dir, derive.SUCCESSION).terminals().select("def_id", "name")


@query("graph_stats", f"""WITH nodes AS ({derive.NODES}) SELECT 'total' AS axis, '' AS value, count(*) AS n FROM nodes
UNION ALL SELECT 'state', state, count(*) FROM nodes GROUP BY state UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY kind""")
def graph_stats(spark, sf_dir):
    return cohesion.graph_stats(derive.star_graph(spark, sf_dir))


@query("strata", f"""WITH nodes AS ({derive.NODES}), edges AS ({derive.SUCCESSION}),
mods AS (SELECT module, count(*) AS size, count(*) FILTER (kind IN ('datatype', 'record', 'postulate')) AS an FROM nodes GROUP BY module),
e AS (SELECT s.module AS ms, t.module AS mt, split_part(s.module, '.', 1) AS s1, split_part(t.module, '.', 1) AS t1 FROM edges JOIN nodes s ON src = s.def_id JOIN nodes t ON dst = t.def_id),
o AS (SELECT ms AS module, count(*) FILTER (ms = mt) AS internal, count(*) FILTER (ms <> mt) AS external, count(DISTINCT t1) FILTER (ms <> mt) AS spread, count(DISTINCT mt) FILTER (ms <> mt) AS ce FROM e GROUP BY ms),
i AS (SELECT mt AS module, count(DISTINCT ms) AS ca FROM e WHERE ms <> mt GROUP BY mt),
sib AS (SELECT ms AS module, mt AS sibling, count(*) AS h, row_number() OVER (PARTITION BY ms ORDER BY count(*) DESC, mt) AS rn FROM e WHERE ms <> mt AND s1 = t1 GROUP BY ms, mt),
m AS (SELECT mods.module, size, an, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, coalesce(spread, 0) AS spread, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, sibling, coalesce(h, 0) AS sibling_hits
 FROM mods LEFT JOIN o ON mods.module = o.module LEFT JOIN i ON mods.module = i.module LEFT JOIN sib ON mods.module = sib.module AND rn = 1),
r AS (SELECT *, CASE WHEN internal + external = 0 THEN 0.0e0 ELSE 1.0e0 - internal / (internal + external)::DOUBLE END AS lcom, CASE WHEN ca + ce = 0 THEN 0.0e0 ELSE ce / (ca + ce)::DOUBLE END AS inst, an / size::DOUBLE AS ab FROM m)
SELECT module, size, internal, external, spread, ce, ca, sibling, sibling_hits, round(lcom, 6) AS lcom, round(inst, 6) AS instability, round(ab, 6) AS abstractness,
 round(abs(ab + inst - 1), 6) AS distance, round(lcom * ln(1.0e0 + spread) * abs(abs(ab + inst - 1) - (1 - inst)), 6) AS incoherence FROM r WHERE size >= 3""")
def strata(spark, sf_dir):
    return rounded(cohesion.strata(derive.star_graph(spark, sf_dir, derive.SUCCESSION)), "lcom", "instability", "abstractness", "distance", "incoherence")


#: Subterms: the words of benchmark-sized texts, a definition a document, a module its source.
SUBTERMS = "SELECT item_id AS def_id, unnest(string_split(text, ' ')) AS hash FROM benchmark"


def _subterms(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sub = b.select(F.col("item_id").alias("def_id"), F.posexplode(F.split("text", " ")).alias("pos", "hash")).withColumn("depth", F.length("hash"))
    return sub, b.select(F.col("item_id").alias("def_id"), F.concat(F.lit("M"), (F.col("item_id") % 12).cast("string")).alias("module"), F.lit(None).cast("string").alias("sig"))


@query("term_clusters", f"""WITH t AS (SELECT def_id, hash, length(hash) AS depth, 'M' || (def_id % 12) AS module FROM ({SUBTERMS})),
per AS (SELECT hash, module, count(*) AS c, sum(depth) AS ds, count(DISTINCT def_id) AS defs FROM t GROUP BY hash, module),
tot AS (SELECT hash, CAST(sum(c) AS BIGINT) AS size, CAST(sum(defs) AS BIGINT) AS n_defs, count(*) AS n_modules, sum(ds) AS ds, sum(c * ln(c)) AS cl FROM per GROUP BY hash HAVING sum(c) >= 2),
d AS (SELECT *, ds / size::DOUBLE AS md, CASE WHEN n_modules <= 1 THEN 0.0e0 ELSE (ln(size) - cl / size) / ln(least(n_modules, 10)) END AS dv FROM tot)
SELECT hash, size, n_defs, n_modules, round(md, 6) AS mean_depth, round(dv, 6) AS diversity, round(size * md * (1 + dv), 6) AS score FROM d""")
def term_clusters(spark, sf_dir):
    return rounded(cohesion.term_clusters(*_subterms(spark, sf_dir)), "mean_depth", "diversity", "score")


@query("term_clusters_documents")
def term_clusters_documents(spark, sf_dir):
    """Subterm clusters of the whole documents: the words of ``text``, a definition a document, a module its source. Rows without an id are no definitions."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sub = d.select(F.col("doc_id").alias("def_id"), F.explode(F.split("text", r"[ \t-\r]+")).alias("hash")).where("hash <> ''").withColumn("depth", F.length("hash"))
    nodes = d.groupBy(F.col("doc_id").alias("def_id")).agg(F.min(F.coalesce("source", F.lit(""))).alias("module"))
    return rounded(cohesion.term_clusters(sub, nodes), "mean_depth", "diversity", "score")


@query("exact_duplicates", """WITH bags AS (SELECT doc_id AS def_id, text AS bag, lang AS sig FROM documents)
SELECT min(def_id) AS first_member, count(*) AS size FROM bags GROUP BY bag, sig HAVING count(*) >= 2""")
def exact_duplicates(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sub = d.select(F.col("doc_id").alias("def_id"), F.md5("text").alias("hash"))
    out = cohesion.exact_duplicates(sub, d.select(F.col("doc_id").alias("def_id"), F.col("lang").alias("sig")))
    return out.select(F.element_at("members", 1).alias("first_member"), F.col("size").cast("long").alias("size"))


def _baskets(spark, sf_dir):
    return derive.run_sql(spark, sf_dir, derive.BASKETS)


_Q = f"""b0 AS ({derive.BASKETS}), sz AS (SELECT owner, count(*) AS k FROM b0 GROUP BY owner), b AS (SELECT b0.owner, item FROM b0 JOIN sz ON b0.owner = sz.owner WHERE k BETWEEN {{least}} AND {{cap}}),
nn AS (SELECT count(DISTINCT owner)::DOUBLE AS n FROM b), one AS (SELECT item, count(*) AS s FROM b GROUP BY item), two AS (SELECT x.item AS a, y.item AS b, count(*) AS j FROM b x JOIN b y ON x.owner = y.owner AND x.item < y.item GROUP BY 1, 2)"""


@query("entwine", f"""WITH {_Q.format(least=1, cap=10000)}, t AS (SELECT a AS x, two.b AS y, j AS n11, u.s AS nx, v.s AS ny, n FROM two JOIN one u ON a = u.item JOIN one v ON two.b = v.item, nn WHERE j >= 3),
c AS (SELECT *, nx - n11 AS n10, ny - n11 AS n01, CAST(n AS BIGINT) - nx - ny + n11 AS n00 FROM t),
k AS (SELECT x, y, n11, n10, n01, n00, least(nx, ny) AS mn, nx >= n OR ny >= n AS flat, unnest([n11, n10, n01, n00]) AS o, unnest([nx / n, nx / n, 1 - nx / n, 1 - nx / n]) AS px, unnest([ny / n, 1 - ny / n, ny / n, 1 - ny / n]) AS py, n FROM c),
s AS (SELECT x, y, n11, n10, n01, n00, mn, bool_or(flat) AS flat, sum(CASE WHEN o > 0 AND px > 0 AND py > 0 THEN o / n * log2(o / n / (px * py)) ELSE 0.0e0 END) AS mi, sum(CASE WHEN o > 0 THEN -(o / n) * log2(o / n) ELSE 0.0e0 END) AS h, sum(CASE WHEN o > 0 AND px > 0 AND py > 0 THEN 2 * o * ln(o / n / (px * py)) ELSE 0.0e0 END) AS g FROM k GROUP BY ALL)
SELECT x, y, n11, n10, n01, n00, round(mi, 6) AS mi, round(h, 6) AS h, round(CASE WHEN h <= 0 THEN 0.0e0 ELSE mi / h END, 6) AS iqr, round(CASE WHEN flat THEN 0.0e0 ELSE g END, 6) AS g, n10 + n01 > n11 AND n11 < mn AS anti FROM s WHERE h > 0 AND NOT flat AND g >= 6.635e0""".replace("GROUP BY ALL", "GROUP BY x, y, n11, n10, n01, n00, mn"))
def entwine(spark, sf_dir):
    return rounded(mining.entwined_pairs(_baskets(spark, sf_dir), min_iqr=0.0), "mi", "h", "iqr", "g")


_ERFC = "((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-x * x)"


@query("association_rules", f"""WITH {_Q.format(least=2, cap=64)}, f2 AS (SELECT * FROM two, nn WHERE j >= ceil(0.002e0 * n)),
f3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS j FROM b x JOIN b y ON x.owner = y.owner AND x.item < y.item JOIN b z ON y.owner = z.owner AND y.item < z.item GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT ceil(0.002e0 * n) FROM nn)),
r AS (SELECT [a] AS lhs, b AS rhs, j FROM f2 UNION ALL SELECT [b], a, j FROM f2 UNION ALL SELECT [a, b], c, j FROM f3 UNION ALL SELECT [a, c], b, j FROM f3 UNION ALL SELECT [b, c], a, j FROM f3),
l AS (SELECT [item] AS lhs, s AS sl FROM one UNION ALL SELECT [a, b], j FROM two), m AS (SELECT count(*) AS tested FROM r),
v AS (SELECT r.lhs, r.rhs, j, sl::DOUBLE AS sl, one.s::DOUBLE AS sr, n, tested FROM r JOIN l ON r.lhs = l.lhs JOIN one ON rhs = one.item, nn, m),
w AS (SELECT *, sqrt(n * (j * (n - sl - sr + j) - (sl - j) * (sr - j)) ** 2 / (sl * (n - sl) * sr * (n - sr)) / 2) AS x FROM v), z AS (SELECT *, 1 / (1 + 0.3275911e0 * x) AS t FROM w)
SELECT array_to_string(lhs, ',') AS lhs, rhs, j AS joint, round(j / n, 6) AS support, round(j / sl, 6) AS confidence, round(j / sl / (sr / n), 6) AS lift, round({_ERFC}, 6) AS p, round(least(1.0e0, {_ERFC} * tested), 6) AS p_corrected FROM z WHERE j / sl >= 0.05e0 AND j / sl / (sr / n) >= 1.02e0""")
def association_rules(spark, sf_dir):
    r = mining.association_rules(_baskets(spark, sf_dir), 0.002, 0.05, 1.02, exclude_top=0.0, alpha=1.0)
    return rounded(r, "support", "confidence", "lift", "p", "p_corrected").withColumn("lhs", F.array_join("lhs", ","))


@query("concept_bundles", f"""WITH {_Q.format(least=2, cap=64)}, t AS (SELECT x.owner, [x.item, y.item] AS items FROM b x JOIN b y ON x.owner = y.owner AND x.item < y.item UNION ALL
SELECT x.owner, [x.item, y.item, z.item] FROM b x JOIN b y ON x.owner = y.owner AND x.item < y.item JOIN b z ON y.owner = z.owner AND y.item < z.item),
c AS (SELECT items, count(*) AS support, count(DISTINCT o_custkey % 9) AS span FROM t JOIN orders ON owner = o_orderkey GROUP BY items HAVING count(*) >= 3),
s AS (SELECT items, sum(ln(one.s / n)) AS logs FROM (SELECT items, unnest(items) AS item FROM c) u JOIN one ON u.item = one.item, nn GROUP BY items),
d AS (SELECT c.items, support, span, support / n / exp(logs) AS lift FROM c JOIN s ON c.items = s.items, nn)
SELECT array_to_string(items, ',') AS items, support, round(lift, 6) AS lift, span, round(support * lift * ln(span + 1.0e0), 6) AS specificity FROM d WHERE lift >= 1.1e0 AND span >= 3""")
def concept_bundles(spark, sf_dir):
    owners = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("owner"), (F.col("o_custkey") % 9).alias("module"))
    return rounded(mining.concept_bundles(_baskets(spark, sf_dir), owners, 3, 1.1, 3, 3), "lift", "specificity").withColumn("items", F.array_join("items", ","))


_THEOREMS = "theorems AS (SELECT def_id FROM nodes WHERE access = 'public' AND kind <> 'other'), foot AS (SELECT t.def_id, a.def_id AS axiom FROM theorems t LEFT JOIN (SELECT r.seed, n.def_id FROM reach r JOIN nodes n ON r.node = n.def_id WHERE n.state = 'P') a ON t.def_id = a.seed)"


@query("ledger_footprints", f"{CTE}, {CLOSURE}, {_THEOREMS} SELECT def_id, axiom FROM foot")
def ledger_footprints(spark, sf_dir):
    return trust.footprints(derive.star_graph(spark, sf_dir)).select("def_id", "axiom")


@query("ledger", f"{CTE}, {CLOSURE}, {_THEOREMS} SELECT def_id, count(axiom) AS n_axioms, CAST(0 AS BIGINT) AS n_foundational FROM foot GROUP BY def_id")
def ledger(spark, sf_dir):
    return trust.ledger(trust.footprints(derive.star_graph(spark, sf_dir)))


@query("ledger_cohorts", f"""{CTE}, {CLOSURE}, {_THEOREMS}, s AS (SELECT def_id, coalesce(string_agg(axiom, ',' ORDER BY axiom), '') AS axioms FROM foot GROUP BY def_id)
SELECT axioms, count(*) AS n FROM s GROUP BY axioms HAVING count(*) >= 2""")
def ledger_cohorts(spark, sf_dir):
    return trust.cohorts(trust.footprints(derive.star_graph(spark, sf_dir))).withColumn("axioms", F.array_join("axioms", ","))


@query("ledger_leverage", f"{CTE}, {CLOSURE}, {_THEOREMS} SELECT axiom, count(DISTINCT def_id) AS n FROM foot WHERE axiom IS NOT NULL GROUP BY axiom")
def ledger_leverage(spark, sf_dir):
    return trust.leverage(trust.footprints(derive.star_graph(spark, sf_dir)))


@query("debt_coverage", f"{CTE}, {UP} SELECT h.def_id AS hole, e.def_id FROM up JOIN nodes h ON seed = h.def_id JOIN nodes e ON node = e.def_id WHERE h.state IN ('H', 'P') AND e.access = 'public'")
def debt_coverage(spark, sf_dir):
    return trust.debt_coverage(derive.star_graph(spark, sf_dir))


@query("debt_schedule")
def debt_schedule(spark, sf_dir):
    g = derive.star_graph(spark, sf_dir).stored()
    return rounded(trust.debt_schedule(g, trust.debt_coverage(g)), "cum_pct")


_PR = "nn AS (SELECT count(*)::DOUBLE AS n FROM nodes), deg AS (SELECT src, count(*)::DOUBLE AS d FROM edges GROUP BY src), m0 AS (SELECT def_id AS node, 1 / n AS m FROM nodes, nn)"
_PR_ROUND = ", m{b} AS (SELECT def_id AS node, (1 - 0.85e0) / n + 0.85e0 * (SELECT coalesce(sum(m), 0.0e0) FROM m{a} WHERE node NOT IN (SELECT src FROM deg)) / n + 0.85e0 * coalesce(g.s, 0.0e0) AS m FROM nodes CROSS JOIN nn LEFT JOIN (SELECT dst, sum(m / d) AS s FROM m{a} JOIN edges ON node = edges.src JOIN deg ON edges.src = deg.src GROUP BY dst) g ON g.dst = def_id)"


@query("pagerank", f"WITH nodes AS ({derive.NODES}), edges AS ({derive.SUCCESSION}), {_PR}" + "".join(_PR_ROUND.format(a=i, b=i + 1) for i in range(5)) + " SELECT node, round(m, 9) AS mass FROM m5")
def pagerank(spark, sf_dir):
    g = derive.star_graph(spark, sf_dir, derive.SUCCESSION)
    return rank.pagerank(g.nodes.select(F.col("def_id").alias("node")), g.edges, rounds=5, tol=0.0).select("node", F.round("mass", 9).alias("mass"))


@query("pagerank_converged")
def pagerank_converged(spark, sf_dir):
    """The power iteration up to its tolerance, which the fixed five rounds of ``pagerank`` and its SQL do not reach."""
    g = derive.star_graph(spark, sf_dir, derive.SUCCESSION)
    return rank.pagerank(g.nodes.select(F.col("def_id").alias("node")), g.edges).select("node", F.round("mass", 9).alias("mass"))


# --- similarity and geometry ---------------------------------------------------------------------------------

from quern.operators import geometry, similarity  # noqa: E402


@query("signature_fingerprint_pairs", f"""WITH RECURSIVE nodes AS ({derive.NODES}), edges AS ({derive.DAG}), reach(seed, node) AS (SELECT def_id, def_id FROM nodes UNION SELECT seed, dst FROM reach JOIN edges ON node = src),
bag AS (SELECT seed AS owner, kind AS item, count(*) AS w FROM reach JOIN nodes ON node = def_id GROUP BY seed, kind), s AS (SELECT owner, sum(w) AS s FROM bag GROUP BY owner HAVING sum(w) >= 3),
m AS (SELECT x.owner AS a, y.owner AS b, sum(least(x.w, y.w)) AS m FROM bag x JOIN bag y ON x.item = y.item AND x.owner < y.owner GROUP BY 1, 2)
SELECT a, b, round(m / (u.s + v.s - m)::DOUBLE, 6) AS sim FROM m JOIN s u ON a = u.owner JOIN s v ON b = v.owner WHERE m / (u.s + v.s - m)::DOUBLE >= 0.8e0""")
def signature_fingerprint_pairs(spark, sf_dir):
    from quern.session import materialise

    g = derive.star_graph(spark, sf_dir)
    colors = g.nodes.select(F.col("def_id").alias("node"), F.col("kind").alias("color"))
    bags = similarity.fingerprints(g.nodes.select(F.col("def_id").alias("seed")), g.edges, colors)
    big = bags.groupBy("owner").agg(F.sum("w").alias("s")).where("s >= 3").select("owner")
    return rounded(similarity.weighted_jaccard(materialise(bags.join(big, "owner", "left_semi"), "bags"), 0.8), "sim")


def _flat(df, *cols):
    return df.select(*cols, F.array_join("members", ",").alias("members"))


@query("fingerprint")
def fingerprint(spark, sf_dir):
    return _flat(similarity.fingerprint(derive.star_graph(spark, sf_dir)), "root", "size", F.round("avg_sim", 6).alias("avg_sim"))


@query("echo")
def echo(spark, sf_dir):
    return _flat(similarity.echo(derive.star_graph(spark, sf_dir)), "root", "size", "spread")


@query("silhouette")
def silhouette(spark, sf_dir):
    return _flat(similarity.silhouette(derive.star_graph(spark, sf_dir)), "root", "size", "pairs", F.round("overlap", 6).alias("overlap"), "tag")


@query("load_bearing")
def load_bearing(spark, sf_dir):
    return rounded(geometry.load_bearing(derive.star_graph(spark, sf_dir, derive.CYCLIC).stored(), top=None), "span", "score")


_WALK = "f(node, d) AS (SELECT def_id, 0 FROM nodes WHERE state = 'P' UNION SELECT src, d + 1 FROM f JOIN edges ON node = dst WHERE src NOT IN (SELECT def_id FROM nodes WHERE state = 'P')), r(node, d) AS (SELECT def_id, 0 FROM nodes WHERE access = 'public' UNION SELECT dst, d + 1 FROM r JOIN edges ON node = src WHERE dst NOT IN (SELECT def_id FROM nodes WHERE access = 'public'))"


@query("horizon", f"""{CTE}, {_WALK}
SELECT def_id AS node, CAST(coalesce(max(f.d), -1) AS INTEGER) AS forward, CAST(coalesce((SELECT max(d) FROM r WHERE r.node = def_id), -1) AS INTEGER) AS backward FROM nodes LEFT JOIN f ON f.node = def_id GROUP BY def_id""")
def horizon(spark, sf_dir):
    return geometry.horizon(derive.star_graph(spark, sf_dir))


@query("build_cost", f"""{CTE}, reach(seed, node) AS (SELECT def_id, def_id FROM nodes UNION SELECT seed, dst FROM reach JOIN edges ON node = src),
own AS (SELECT def_id, (SELECT count(*) FROM edges WHERE src = def_id) * (SELECT count(*) FROM edges WHERE dst = def_id) AS f, CASE kind WHEN 'function' THEN 6 WHEN 'projection' THEN 4 WHEN 'datatype' THEN 3 WHEN 'record' THEN 2 ELSE 1 END AS k FROM nodes),
walk(node, depth) AS (SELECT def_id, 0 FROM nodes WHERE def_id NOT IN (SELECT src FROM edges) UNION SELECT src, depth + 1 FROM walk JOIN edges ON node = dst),
d AS (SELECT node, max(depth) AS depth FROM walk GROUP BY node), s AS (SELECT seed, count(*) AS reach, sum(f) AS fan, sum(k) AS kinds FROM reach JOIN own ON node = def_id GROUP BY seed), b AS (SELECT node, count(*) AS reachers FROM reach GROUP BY node)
SELECT own.def_id AS scc, reach, CAST(fan AS BIGINT) AS fan, CAST(kinds AS BIGINT) AS kinds, CAST(depth AS INTEGER) AS depth, round(reach + 0.5e0 * fan + 2.0e0 * kinds + 10.0e0 * depth / (SELECT greatest(max(depth), 1) FROM d), 6) AS cost, reachers, round(reachers * (1.0e0 + 0.5e0 * f + 2.0e0 * k), 6) AS lever
FROM own JOIN s ON seed = def_id JOIN d ON d.node = def_id JOIN b ON b.node = def_id""")
def build_cost(spark, sf_dir):
    return rounded(geometry.build_cost(derive.star_graph(spark, sf_dir)), "cost", "lever")


from quern.plans import answers  # noqa: E402, F401 - registers its queries
