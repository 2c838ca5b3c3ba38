"""Registered point queries, document round trips, audit, retrieval and structural kernels, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import goals, names
from quern.operators import audit, community, flow, lemmas, motif, points, spectral, traverse
from quern.plans import derive
from quern.plans.registry import CLOSURE, CTE, UP, query, rounded
from quern.plans.union import union_documents
from quern.session import materialise, shared_dir
from quern.sources import document
from quern.streaming.snapshots import Daemon, Store


def _graph(spark, sf_dir, edges=derive.DAG):
    return derive.star_graph(spark, sf_dir, edges).stored()


def _temporary(spark, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def _subject(g) -> str:
    """The name of the least node that uses another."""
    i = g.edges.agg(F.min("src")).first()[0]
    return g.nodes.where(F.col("def_id") == i).first().name if i is not None else ""


SUBJECT = "me AS (SELECT min(src) AS id FROM edges)"
NAMED = "JOIN nodes n ON n.def_id = x.id"


# --- documents -------------------------------------------------------------------------------------------------


def _read_back(spark, sf_dir, edges=derive.DAG):
    path = _temporary(spark, "written")
    document.write_document(document.document_of(_graph(spark, sf_dir, edges), entry_module="STANDARD"), path)
    return document.read_document(spark, path)


@query("document_nodes", f"WITH nodes AS ({derive.NODES}) SELECT row_number() OVER (ORDER BY def_id) - 1 AS def_id, name, module, kind, state, access, CAST(line AS INTEGER) AS line, sig, is_unsafe AS is_tainted, true AS is_real FROM nodes")
def document_nodes(spark, sf_dir):
    """Nodes of the graph after it was written as a document, read and indexed."""
    n = document.build_index(_read_back(spark, sf_dir)).nodes
    return n.select("def_id", "name", "module", "kind", "state", "access", "line", "sig", (F.size("unsafe") > 0).alias("is_tainted"), "is_real")


@query("document_edges", f"{CTE} SELECT s.name AS src, t.name AS dst, prov FROM edges JOIN nodes s ON src = s.def_id JOIN nodes t ON dst = t.def_id")
def document_edges(spark, sf_dir):
    g = document.build_index(_read_back(spark, sf_dir))
    named = g.nodes.select("def_id", "name")
    return g.edges.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "prov")


@query("document_union", f"""WITH nodes AS ({derive.NODES}), e AS (SELECT src, dst, prov FROM ({derive.DAG}) d UNION SELECT src, dst, prov FROM ({derive.CYCLIC}) c)
SELECT s.name AS src, t.name AS dst, prov FROM e JOIN nodes s ON src = s.def_id JOIN nodes t ON dst = t.def_id""")
def document_union(spark, sf_dir):
    g = document.build_index(union_documents([_read_back(spark, sf_dir), _read_back(spark, sf_dir, derive.CYCLIC)]))
    named = g.nodes.select("def_id", "name")
    return g.edges.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "prov")


@query("snapshot_edges", f"{CTE} SELECT s.name AS src, t.name AS dst, prov FROM edges JOIN nodes s ON src = s.def_id JOIN nodes t ON dst = t.def_id")
def snapshot_edges(spark, sf_dir):
    """Edges of the snapshot that two entries, rebuilt by one batch of file events, are published as."""
    g = _graph(spark, sf_dir)
    half = lambda r: document.document_of(type(g)(g.nodes, g.edges.where((F.col("src") % 2) == r)))
    closures = spark.createDataFrame([("even", "A.agda"), ("odd", "B.agda")], "entry string, path string")
    d = Daemon(Store(spark, _temporary(spark, "daemon")), lambda entry: half(0 if entry == "even" else 1), closures)
    d.on_batch(spark.createDataFrame([("A.agda", None, "1"), ("B.agda", None, "1")], "path string, ts timestamp, signature string"))
    s = d.snapshot().graph
    named = s.nodes.select("def_id", "name")
    return s.edges.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "prov")


# --- point queries -----------------------------------------------------------------------------------------------


@query("search", f"""WITH nodes AS ({derive.NODES}), b AS (SELECT *, lower(split_part(name, '.', -1)) AS base FROM nodes WHERE contains(lower(name), 'p1'))
SELECT def_id, name, module, kind, state, line, CAST(CASE WHEN base = 'p1' THEN 0 WHEN starts_with(base, 'p1') THEN 1 WHEN contains(base, 'p1') THEN 2 ELSE 3 END AS INTEGER) AS score FROM b
WHERE kind = 'function' AND state = 'D' ORDER BY score, length(name), name LIMIT 30""")
def search(spark, sf_dir):
    return points.search(_graph(spark, sf_dir), "P1", 30, kind="function", state="defined")


@query("locate", f"""{CTE}, {SUBJECT}, d(node) AS (SELECT dst FROM edges, me WHERE src = id UNION SELECT dst FROM d JOIN edges ON src = node), u(node) AS (SELECT src FROM edges, me WHERE dst = id UNION SELECT src FROM u JOIN edges ON dst = node)
SELECT def_id, name, module, kind, state, access, line, (SELECT count(*) FROM edges, me WHERE src = id) AS uses, (SELECT count(*) FROM edges, me WHERE dst = id) AS used_by,
 (SELECT count(*) FROM d) AS reaches, (SELECT count(*) FROM u) AS reached_by, false AS recursive FROM nodes, me WHERE def_id = id""")
def locate(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return points.locate(g, _subject(g))


@query("callees", f"{CTE}, {SUBJECT}, x AS (SELECT dst AS id, prov FROM edges, me WHERE src = me.id) SELECT def_id, name, module, prov FROM x {NAMED}")
def callees(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return points.callees(g, _subject(g))


@query("callees_by_body", f"""{CTE}, {SUBJECT}, d(node) AS (SELECT dst FROM edges, me WHERE src = me.id AND prov = 'body' UNION SELECT dst FROM d JOIN edges ON src = node),
x AS (SELECT node AS id FROM d) SELECT def_id, name, module, CAST(NULL AS VARCHAR) AS prov FROM x {NAMED}""")
def callees_by_body(spark, sf_dir):
    """All that the subject reaches, the first hop over edges of bodies only."""
    g = _graph(spark, sf_dir)
    return points.callees(g, _subject(g), transitive=True, provenance="body")


@query("callers", f"""{CTE}, u(node) AS (SELECT src FROM edges WHERE dst = (SELECT max(dst) FROM edges) UNION SELECT src FROM u JOIN edges ON dst = node),
x AS (SELECT node AS id FROM u) SELECT def_id, name, module, CAST(NULL AS VARCHAR) AS prov FROM x {NAMED}""")
def callers(spark, sf_dir):
    g = _graph(spark, sf_dir)
    last = g.edges.agg(F.max("dst")).first()[0]
    return points.callers(g, g.nodes.where(F.col("def_id") == last).first().name, transitive=True)


@query("impact", f"""{CTE}, u(node) AS (SELECT src FROM edges WHERE dst = (SELECT max(dst) FROM edges) UNION SELECT src FROM u JOIN edges ON dst = node)
SELECT module, count(*) AS n FROM u JOIN nodes ON node = def_id GROUP BY module ORDER BY n DESC, module LIMIT 12""")
def impact(spark, sf_dir):
    g = _graph(spark, sf_dir)
    last = g.edges.agg(F.max("dst")).first()[0]
    return points.impact(g, g.nodes.where(F.col("def_id") == last).first().name)


_LAYERS = "walk(node, d) AS (SELECT id, 0 FROM me UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = node), dist AS (SELECT node, min(d) AS d FROM walk GROUP BY node)"


@query("path", f"""{CTE}, {SUBJECT}, {_LAYERS}, aim AS (SELECT max(node) AS t FROM dist WHERE d = (SELECT max(d) FROM dist)),
p(node, d, path) AS (SELECT id, 0, CAST(id AS VARCHAR) FROM me UNION ALL SELECT e.dst, p.d + 1, path || ',' || e.dst FROM p JOIN edges e ON e.src = p.node JOIN dist ON dist.node = e.dst AND dist.d = p.d + 1)
SELECT CAST(row_number() OVER (ORDER BY string_split(path, ',')::BIGINT[]) AS INTEGER) AS rank, path FROM p JOIN aim ON node = t ORDER BY rank LIMIT 3""")
def path(spark, sf_dir):
    """The three least shortest paths from the subject to the farthest node it reaches."""
    g = _graph(spark, sf_dir)
    name = _subject(g)
    i = g.nodes.where(F.col("name") == name).first().def_id
    far = traverse.closure(g.edges, spark.createDataFrame([(i,)], "seed long")).orderBy(F.desc("depth"), F.desc("node")).first()
    found = points.path(g, name, g.nodes.where(F.col("def_id") == far.node).first().name, 3)
    return found.select("rank", F.array_join("path", ",").alias("path"))


@query("roots", f"""{CTE}, {SUBJECT}, {_LAYERS},
p(node, d, path) AS (SELECT id, 0, CAST(id AS VARCHAR) FROM me UNION ALL SELECT e.dst, p.d + 1, path || ',' || e.dst FROM p JOIN edges e ON e.src = p.node JOIN dist ON dist.node = e.dst AND dist.d = p.d + 1),
f AS (SELECT node, d, path, row_number() OVER (PARTITION BY node ORDER BY string_split(path, ',')::BIGINT[]) AS rn FROM p)
SELECT def_id, name, module, CAST(d AS INTEGER) AS depth, path FROM f JOIN nodes ON node = def_id, me WHERE rn = 1 AND node <> id AND (state = 'P' OR kind IN ('postulate', 'primitive'))""")
def roots(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return points.roots(g, _subject(g)).withColumn("path", F.array_join("path", ","))


@query("transitive_escapes", f"""{CTE}, {CLOSURE} SELECT nodes.def_id, coalesce(u, 0) AS unsafe_below, coalesce(m, 0) AS unsolved_below FROM nodes
LEFT JOIN (SELECT seed, count(*) FILTER (is_unsafe) AS u, count(*) FILTER (is_unsolved) AS m FROM reach JOIN nodes ON node = def_id GROUP BY seed) r ON seed = nodes.def_id""")
def transitive_escapes(spark, sf_dir):
    return points.transitive_escapes(_graph(spark, sf_dir))


_LOCAL = f"n AS (SELECT def_id, module, line, def_id % 3 = 0 AS is_local FROM ({derive.NODES}) q)"


@query("owners", f"""WITH {_LOCAL}, c AS (SELECT l.def_id, o.def_id AS owner, row_number() OVER (PARTITION BY l.def_id ORDER BY o.line DESC, o.def_id DESC) AS rn
FROM n l JOIN n o ON o.line <= l.line AND (l.module = o.module OR starts_with(l.module, o.module || '.')) WHERE l.is_local AND NOT o.is_local) SELECT def_id, owner FROM c WHERE rn = 1""")
def owners(spark, sf_dir):
    """The as-of join of local definitions (every third one, tagged with its line) with the definitions they stand in."""
    g = _graph(spark, sf_dir)
    tagged = F.when(F.col("def_id") % 3 == 0, F.concat("name", F.lit("@"), F.col("line"))).otherwise(F.col("name"))
    return points.owners(type(g)(g.nodes.withColumn("name", tagged), g.edges))


@query("suffix_matches", f"WITH nodes AS ({derive.NODES}), q AS (SELECT DISTINCT substr(name, strpos(name, '.') + 1) AS query FROM nodes WHERE def_id % 20 = 0) SELECT query, min(def_id) AS def_id FROM q JOIN nodes ON name = query OR ends_with(name, '.' || query) GROUP BY query HAVING count(*) = 1")
def suffix_matches(spark, sf_dir):
    """Names less their first segment, of every definition whose id is divisible by 20, matched with the only definition they can mean."""
    g = _graph(spark, sf_dir)
    q = g.nodes.where("def_id % 20 = 0").select(F.expr("substr(name, locate('.', name) + 1)").alias("query"))
    return points.suffix_join(q, g)


@query("similar_types")
def similar_types(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return rounded(points.similar_types(g, _subject(g)), "sim")


# --- audit -----------------------------------------------------------------------------------------------------


@query("unused_definitions", f"""{CTE}, e AS (SELECT s.def_id AS src, t.def_id AS dst, s.module = t.module AS inside FROM edges JOIN nodes s ON src = s.def_id JOIN nodes t ON dst = t.def_id WHERE src <> dst),
u AS (SELECT dst, count(*) FILTER (inside) AS near, count(*) FILTER (NOT inside) AS far FROM e GROUP BY dst), d AS (SELECT nodes.*, coalesce(near, 0) AS near, coalesce(far, 0) AS far FROM nodes LEFT JOIN u ON dst = def_id)
SELECT CASE WHEN kind = 'projection' THEN 'field' WHEN near = 0 THEN 'dead' ELSE 'internal-only' END AS kind, module, substr(name, length(module) + 2) AS symbol, CASE WHEN kind = 'projection' THEN 'low' ELSE 'high' END AS confidence
FROM d WHERE far = 0 AND CASE WHEN kind = 'projection' THEN near = 0 ELSE near = 0 OR access <> 'private' END""")
def unused_definitions(spark, sf_dir):
    """Dead, internal-only and never projected definitions of the acyclic graph, with sources that mention nothing."""
    doc = document.document_of(_graph(spark, sf_dir))
    files = doc.files.select("path", F.concat(F.lit("module "), "module", F.lit(" where\n")).alias("text"))
    return audit.audit(doc, files, ("dead", "internal-only", "field")).select("kind", "module", "symbol", "confidence")


# --- retrieval ---------------------------------------------------------------------------------------------------


@query("goal_buckets", """WITH w AS (SELECT p_partkey, p_type, string_split(p_name, ' ') AS w FROM part), c AS (SELECT p_partkey, (CASE WHEN len(w) > 1 AND w[1] = w[2] THEN 'v0 v0' WHEN len(w) > 1 THEN 'v0 v1' ELSE 'v0' END) || ' → ' || p_type AS canonical FROM w)
SELECT canonical, count(*) AS size, min(p_partkey) AS first_goal FROM c GROUP BY canonical""")
def goal_buckets(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    g = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("{- goal -} "), "p_name", F.lit("  →\n"), "p_type", F.lit(" -- open")).alias("raw_type"))
    return goals.buckets(g).select("canonical", "size", F.col("centroid.ord").alias("first_goal"))


#: Signatures of capitalised words, so that every one is a token of its own.
_SIG = "concat_ws(' ', initcap(split(p_name, ' ')[0]), initcap(split(p_name, ' ')[1]), concat('S', p_size), replace(p_brand, '#', ''))"
_WORDS = "[upper(substr(string_split(p_name, ' ')[1], 1, 1)) || substr(string_split(p_name, ' ')[1], 2), upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2), 'S' || p_size, replace(p_brand, '#', '')]"


def _lemma_graph(spark, sf_dir):
    g = _graph(spark, sf_dir)
    sig = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("def_id"), F.expr(_SIG).alias("sig"))
    return type(g)(g.nodes.drop("sig").join(sig, "def_id").select(*g.nodes.columns), g.edges).stored()


@query("lemma_ranking", f"""WITH w AS (SELECT p_partkey AS def_id, p_type || '.' || p_brand || '.P' || p_partkey AS name, list_distinct({_WORDS}) AS ws, 'P' || p_partkey AS own FROM part),
p AS (SELECT g.def_id AS goal_id, l.def_id, l.name, len(list_intersect(g.ws, l.ws)) AS same, len(g.ws) AS ng, len(list_distinct(list_append(l.ws, l.own))) AS nb FROM w g JOIN w l ON g.def_id <> l.def_id WHERE g.def_id % 20 = 0 AND list_has_any(g.ws, l.ws)),
s AS (SELECT *, same / ng::DOUBLE AS coverage, same / (ng + nb - same)::DOUBLE AS jaccard FROM p WHERE same / ng::DOUBLE >= 0.6e0)
SELECT goal_id, def_id, round(coverage, 6) AS coverage, round(jaccard, 6) AS jaccard, CAST(nb AS INTEGER) AS bag_size, CAST(row_number() OVER (PARTITION BY goal_id ORDER BY coverage DESC, jaccard DESC, nb, name) AS INTEGER) AS rank FROM s""")
def lemma_ranking(spark, sf_dir):
    """Every definition whose id is divisible by 20 as a goal, against all signatures."""
    g = _lemma_graph(spark, sf_dir)
    asked = g.nodes.where("def_id % 20 = 0").select(F.col("def_id").alias("goal_id"), F.col("sig").alias("goal"), F.col("name").alias("exclude"))
    found = lemmas.rank_lemmas(materialise(asked, "goals"), lemmas.corpus(g), 0.6)
    return rounded(found, "coverage", "jaccard").select("goal_id", "def_id", "coverage", "jaccard", "bag_size", "rank")


@query("hint_bench")
def hint_bench(spark, sf_dir):
    """Every strategy, asked for the premises of every proved definition whose id is divisible by 20."""
    out = lemmas.hint_bench(_lemma_graph(spark, sf_dir), every=20)
    return rounded(out, *(c for c in out.columns if c not in ("strategy", "rows")))


# --- kernels -----------------------------------------------------------------------------------------------------


@query("chokepoint")
def chokepoint(spark, sf_dir):
    return rounded(flow.chokepoints(_graph(spark, sf_dir, derive.CYCLIC)), "score")


@query("polyglot")
def polyglot(spark, sf_dir):
    p = community.polyglot(_graph(spark, sf_dir, derive.CYCLIC), threshold=0.0)
    return rounded(p, "diversity", "modularity").withColumn("top", F.to_json("top"))


@query("motif")
def motifs(spark, sf_dir):
    m = motif.motifs(_graph(spark, sf_dir))
    return m.select("size", "support", "score", F.array_join("labels", ",").alias("labels"), F.array_join("example", ",").alias("example"), "modules")


@query("fiedler")
def fiedler(spark, sf_dir):
    """Bridges by the second eigenvector of the whole graph's largest component."""
    g = _graph(spark, sf_dir, derive.SUCCESSION)
    _, values = spectral.spectrum(g)
    return rounded(spectral.bridges(g, values), "gap")


@query("module_connectivity")
def module_connectivity(spark, sf_dir):
    return rounded(spectral.module_connectivity(_graph(spark, sf_dir, derive.SUCCESSION)), "lambda2")


@query("gravity")
def gravity(spark, sf_dir):
    from quern.operators import rank
    from quern.operators.geometry import exported_seeds

    g = _graph(spark, sf_dir, derive.CYCLIC)
    out = rank.gravity(g.nodes.select(F.col("def_id").alias("node")), g.edges, exported_seeds(g).withColumnRenamed("node", "seed"))
    return out.select("node", *(F.round(c, 6).alias(c) for c in ("mass", "entropy", "gravity", "hub", "authority")), "nz", "role")


@query("horizon_histogram", f"""{CTE}, f(node, d) AS (SELECT def_id, 0 FROM nodes WHERE state = 'P' UNION SELECT src, d + 1 FROM f JOIN edges ON node = dst WHERE src NOT IN (SELECT def_id FROM nodes WHERE state = 'P')),
m AS (SELECT node, max(d) AS d FROM f GROUP BY node), h AS (SELECT module, d, count(*) AS c FROM m JOIN nodes ON node = def_id GROUP BY module, d), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY c DESC, d) AS rn, max(d) OVER (PARTITION BY module) AS diameter FROM h)
SELECT module, CAST(d AS INTEGER) AS peak, c AS peak_count, CAST(diameter AS INTEGER) AS diameter FROM r WHERE rn = 1""")
def horizon_histogram(spark, sf_dir):
    from quern.operators import geometry

    g = _graph(spark, sf_dir)
    return geometry.horizon_histogram(g, materialise(geometry.horizon(g), "horizon"))


@query("debt_prerequisites", f"""{CTE}, {CLOSURE}, {UP}, h AS (SELECT def_id FROM nodes WHERE state IN ('H', 'P')), cov AS (SELECT seed AS hole, node FROM up JOIN h ON seed = h.def_id JOIN nodes n ON node = n.def_id WHERE access = 'public'),
p AS (SELECT seed AS hole, node AS needs FROM reach WHERE seed IN (SELECT hole FROM cov) AND node IN (SELECT hole FROM cov))
SELECT p.hole, needs, (SELECT count(*) FROM cov a JOIN cov b ON a.node = b.node WHERE a.hole = p.hole AND b.hole = needs) AS shared FROM p""")
def debt_prerequisites(spark, sf_dir):
    from quern.operators import trust

    g = _graph(spark, sf_dir)
    return trust.prerequisites(g, trust.debt_coverage(g))
