"""Point queries: names, neighbours, reach and look-alikes of one definition.

Every query is a small plan over the graph's tables; pushing the subject down keeps closures to its own reach.
Results are DataFrames; an unknown name gives an empty one and an unknown filter value raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quern.functions import names
from quern.operators import similarity, traverse
from quern.operators.pieces import wide_closure
from quern.plans.graph import KINDS, Graph
from quern.session import materialise

#: filter words and the states they mean
STATE_WORDS = {"defined": "D", "postulate": "P", "hole": "H", "failed": "F"}
PROVENANCE_WORDS = ("signature", "body", "module-local", "where", "with", "unknown")
ESCAPES = ("non-terminating", "trustme")


# --- filters ---------------------------------------------------------------------------------------------------


def check_filters(kind: str | None = None, state: str | None = None, unsafe: str | None = None, provenance: str | None = None) -> None:
    """ValueError, naming the value, for a filter that no definition could match."""
    for word, value, known in (("kind", kind, KINDS), ("state", state, tuple(STATE_WORDS)), ("provenance", provenance, PROVENANCE_WORDS)):
        if value is not None and value.lower() not in known:
            raise ValueError(f"unknown {word} filter {value!r}; use one of {', '.join(known)}")
    if unsafe is not None and unsafe not in ("any", "true", "", *ESCAPES) and not unsafe.startswith("--"):
        raise ValueError(f"unknown unsafe filter {unsafe!r}; use any, {', '.join(ESCAPES)} or a module option such as --type-in-type")


def unsafe_matches(unsafe: str) -> Column:
    return F.size("unsafe") > 0 if unsafe in ("any", "true", "") else F.array_contains("unsafe", unsafe)


def filtered(nodes: DataFrame, kind: str | None = None, state: str | None = None, unsafe: str | None = None, module_prefix: str | None = None) -> DataFrame:
    """Nodes of a kind, state, escape and module; the module prefix is one of text, not of segments."""
    check_filters(kind, state, unsafe)
    cond = F.lit(True)
    if kind is not None:
        cond = cond & (F.col("kind") == kind.lower())
    if state is not None:
        cond = cond & (F.col("state") == STATE_WORDS[state.lower()])
    if unsafe is not None:
        cond = cond & unsafe_matches(unsafe)
    if module_prefix is not None:
        cond = cond & F.col("module").startswith(module_prefix)
    return nodes.where(cond)


def without_names(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose last name segment the pattern does not match anywhere; an empty pattern keeps all."""
    return nodes if not pattern else nodes.where(~names.last_segment(F.col("name")).rlike(pattern))


# --- names -----------------------------------------------------------------------------------------------------


def _last(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def ranked_matches(graph: Graph, text: str) -> DataFrame:
    """Real nodes whose name contains ``text``, whatever the case, with ``score``: 0 the last segment is it, 1 starts with it, 2 contains it, 3 else.

    Order: score, length of the name, name.
    """
    q, base = F.lit(text.lower()), _last(F.col("name"))
    score = F.when(base == q, 0).when(base.startswith(q), 1).when(base.contains(q), 2).otherwise(3)
    return graph.nodes.where(F.col("is_real") & F.lower("name").contains(q)).withColumn("score", score)


def search(graph: Graph, text: str, limit: int | None = 30, **filters) -> DataFrame:
    """``def_id, name, module, kind, state, line, score``: the best matches, by the order of :func:`ranked_matches`."""
    found = filtered(ranked_matches(graph, text), **filters).select("def_id", "name", "module", "kind", "state", "line", "score")
    found = found.orderBy("score", F.length("name"), "name")
    return found if limit is None else found.limit(limit)


def resolve(graph: Graph, name: str, aliases: DataFrame | None = None, fuzzy: bool = True) -> Row | None:
    """The node a name means: exactly; else as the only dotted suffix, line tags aside; else as a renaming alias
    ``aliases(alias, name)``; else, if ``fuzzy``, as the only match of a search. ``how`` says which; None if none does."""
    keep = ("def_id", "name", "module", "kind", "state", "access", "line", "sig", "unsafe", "is_real")
    exact = graph.nodes.where(F.col("name") == name).orderBy(F.desc("def_id")).select(*keep, F.lit("exact").alias("how")).first()
    if exact:
        return exact
    bare = names.strip_line_tag(F.col("name"))
    want = names.strip_line_tag(F.lit(name))
    only = lambda df, how: (lambda rows: rows[0] if len(rows) == 1 else None)(df.select(*keep, F.lit(how).alias("how")).take(2))
    suffix = graph.nodes.where(F.col("is_real") & ((bare == want) | bare.endswith(F.concat(F.lit("."), want))))
    found = only(suffix, "suffix")
    if found is None and aliases is not None:
        found = only(graph.nodes.join(aliases.where(F.col("alias") == name).select("name"), "name", "left_semi"), "alias")
    if found is None and fuzzy:
        found = only(ranked_matches(graph, name), "near")
    return found


def aliases_of(graph: Graph) -> DataFrame:
    """``alias, name``: names that a renaming re-export gives; the module that re-exports plus the new name, and what it stands for."""
    rx = graph.extra.get("reexports")
    if rx is None:
        return graph.spark.createDataFrame([], "alias string, name string")
    r = rx.select("from", "to", F.explode("renames").alias("old", "new"))
    return r.select(F.concat_ws(".", "from", "new").alias("alias"), F.concat_ws(".", "to", "old").alias("name"))


def suffix_join(queries: DataFrame, graph: Graph) -> DataFrame:
    """``query, def_id``: each ``queries(query)`` with the only real node of which it is a dotted suffix; by the last segment, then the rest."""
    q = queries.select("query").distinct().select("query", names.strip_line_tag(F.col("query")).alias("want"))
    q = q.withColumn("key", F.substring_index("want", ".", -1))
    n = graph.nodes.where("is_real").select("def_id", names.strip_line_tag(F.col("name")).alias("bare")).withColumn("key", F.substring_index("bare", ".", -1))
    hit = q.join(n, "key").where((F.col("bare") == F.col("want")) | F.col("bare").endswith(F.concat(F.lit("."), F.col("want"))))
    return hit.groupBy("query").agg(F.count("*").alias("n"), F.min("def_id").alias("def_id")).where("n = 1").select("query", "def_id")


def owners(graph: Graph) -> DataFrame:
    """``def_id, owner``: for each local definition with a line, the nearest definition that is not local at or above it, in
    its module or an enclosing one; of equal lines the later one. An as-of join by module prefix: one pass over the
    distinct lines of each module."""
    n = graph.nodes.where(F.col("is_real") & F.col("line").isNotNull())
    local = n.where(names.is_local(F.col("name"))).select("def_id", F.col("line").alias("at"), F.explode(names.module_prefixes(F.col("module"))).alias("module"))
    top = n.where(~names.is_local(F.col("name"))).select("module", "line", F.col("def_id").alias("owner"))
    lines = top.groupBy("module", F.col("line").alias("at")).agg(F.max("owner").alias("owner")).unionByName(local.select("module", "at").distinct(), allowMissingColumns=True)
    lines = lines.groupBy("module", "at").agg(F.max("owner").alias("owner"))
    upto = Window.partitionBy("module").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("owner").isNotNull(), F.struct(F.col("at").alias("line"), "owner"))).over(upto)
    best = local.join(lines.select("module", "at", last.alias("b")), ["module", "at"]).where("b is not null").groupBy("def_id").agg(F.max("b").alias("b"))
    return best.select("def_id", "b.owner")


def option_in_force(graph: Graph, option: str = "--erasure") -> DataFrame:
    """``module``: modules for which the option is effective, in themselves or in an enclosing module."""
    on = graph.extra["options"].where((F.col("kind") == "effective") & F.array_contains("flags", option)).select(F.col("module").alias("prefix")).distinct()
    mods = graph.nodes.select("module").distinct()
    return mods.select("module", F.explode(names.module_prefixes(F.col("module"))).alias("prefix")).join(on, "prefix", "left_semi").select("module").distinct()


# --- neighbours and reach ----------------------------------------------------------------------------------------


def _one(graph: Graph, i: int) -> DataFrame:
    return graph.spark.createDataFrame([(i,)], "seed long")


def locate(graph: Graph, name: str, **how) -> DataFrame:
    """The node with ``uses, used_by`` (direct, itself aside), ``reaches, reached_by`` (closures) and ``recursive``; one row, or none."""
    d = resolve(graph, name, **how)
    if d is None:
        return graph.nodes.limit(0).select("def_id", "name", "module", "kind", "state", "access", "line", *(F.lit(0).cast("long").alias(c) for c in ("uses", "used_by", "reaches", "reached_by")), F.lit(False).alias("recursive"))
    i = d.def_id
    e = graph.edges.where((F.col("src") == i) | (F.col("dst") == i)).select("src", "dst").distinct()
    n = e.agg(F.count_if((F.col("src") == i) & (F.col("dst") != i)).alias("uses"), F.count_if((F.col("dst") == i) & (F.col("src") != i)).alias("used_by"), F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("recursive"))
    count = lambda reverse, c: traverse.closure(graph.edges, _one(graph, i), reverse).agg(F.count("*").alias(c))
    row = graph.nodes.where(F.col("def_id") == i).select("def_id", "name", "module", "kind", "state", "access", "line")
    return row.crossJoin(n).crossJoin(count(False, "reaches")).crossJoin(count(True, "reached_by")).select(*row.columns, "uses", "used_by", "reaches", "reached_by", "recursive")  # one row each


def neighbours(graph: Graph, name: str, reverse: bool, transitive: bool = False, module_prefix: str | None = None, provenance: str | None = None, **how) -> DataFrame:
    """``def_id, name, module, prov``: what the node uses (``reverse``: what uses it), directly or transitively.

    ``provenance`` filters direct edges; of a transitive query it filters the first hop only.
    """
    check_filters(provenance=provenance)
    d = resolve(graph, name, **how)
    here, there = ("dst", "src") if reverse else ("src", "dst")
    i = -1 if d is None else d.def_id
    edges = graph.by_provenance(provenance.lower(), untagged=False) if provenance else graph.edges
    if transitive:
        got = traverse.closure(graph.edges, _one(graph, i), reverse, first=edges if provenance else None).select(F.col("node").alias("def_id"), F.lit(None).cast("string").alias("prov"))
    else:
        got = edges.where((F.col(here) == i) & (F.col(there) != i)).groupBy(F.col(there).alias("def_id")).agg(F.min("prov").alias("prov"))
    return filtered(got.join(graph.nodes, "def_id"), module_prefix=module_prefix).select("def_id", "name", "module", "prov")


def callers(graph: Graph, name: str, **options) -> DataFrame:
    return neighbours(graph, name, True, **options)


def callees(graph: Graph, name: str, **options) -> DataFrame:
    return neighbours(graph, name, False, **options)


def by_module(found: DataFrame, top: int | None = None) -> DataFrame:
    """``module, n``: how many of the found nodes each module has, most first, then by name."""
    n = found.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module")
    return n if top is None else n.limit(top)


def impact(graph: Graph, name: str, top: int = 12, **how) -> DataFrame:
    """``module, n``: the modules with most definitions that depend on the node, directly or not."""
    return by_module(neighbours(graph, name, True, transitive=True, **how), top)


def path(graph: Graph, source: str, target: str, k: int = 1, module_prefix: str | None = None, **how) -> DataFrame:
    """``rank, path``: up to ``k`` shortest chains of ids from one node to another, inner nodes in modules of the prefix."""
    a, b = resolve(graph, source, **how), resolve(graph, target, **how)
    if a is None or b is None:
        return graph.spark.createDataFrame([], "rank int, path array<long>")
    allowed = None if module_prefix is None else filtered(graph.nodes, module_prefix=module_prefix)
    return traverse.shortest_paths(graph.edges, a.def_id, b.def_id, k, allowed)


def chain_tags(graph: Graph, paths: DataFrame) -> DataFrame:
    """``paths`` with ``tags``: the provenance of each hop, ``?`` where it is not known."""
    hops = paths.select("path", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS src, path[i] AS dst))")).alias("at", "h")) if "path" in paths.columns else paths
    tagged = hops.select("path", "at", "h.src", "h.dst").join(graph.edges.groupBy("src", "dst").agg(F.min("prov").alias("prov")), ["src", "dst"], "left")
    tagged = tagged.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("prov", F.lit("?")).alias("p")))).alias("t"))
    return paths.join(tagged.select("path", F.transform("t", lambda x: x["p"]).alias("tags")), "path", "left")


def roots(graph: Graph, name: str, kind: str | None = None, state: str | None = None, unsafe: str | None = None, module_prefix: str | None = None, witness: bool = True, **how) -> DataFrame:
    """``def_id, name, module, depth, path``: the assumptions a node rests on, each with the shortest chain to it, of equal ones the least by ids.

    Assumptions are postulates and primitives, or what the filters say; ``unsafe`` asks for escapes instead.
    """
    check_filters(kind, state, unsafe)
    d = resolve(graph, name, **how)
    i = -1 if d is None else d.def_id
    is_root = graph.nodes.where((F.col("state") == "P") | F.col("kind").isin("postulate", "primitive")) if kind is state is unsafe is None else filtered(graph.nodes, kind, state, unsafe)
    is_root = filtered(is_root, module_prefix=module_prefix).select("def_id", "name", "module")
    if not witness:
        reach = traverse.closure(graph.edges, _one(graph, i)).select(F.col("node").alias("def_id"), "depth", F.lit(None).cast("array<long>").alias("path"))
    else:
        reach = traverse.witness_paths(graph.edges, i).where(F.col("node") != i).select(F.col("node").alias("def_id"), (F.size("path") - 1).alias("depth"), "path")
    return reach.join(is_root, "def_id").select("def_id", "name", "module", "depth", "path")


def taint(graph: Graph, name: str, **how) -> DataFrame:
    """``unsafe_below, unsafe_first, unsolved_below, unsolved_metas, own_unsafe, own_unsolved``: what a node rests on that is escaped or unsolved; one row, or none.

    A node is not below itself, even on a cycle.
    """
    d = resolve(graph, name, **how)
    i = -1 if d is None else d.def_id
    below = traverse.closure(graph.edges, _one(graph, i)).select(F.col("node").alias("def_id")).join(graph.nodes, "def_id")
    sums = below.agg(
        F.count_if(F.size("unsafe") > 0).alias("unsafe_below"), F.min(F.when(F.size("unsafe") > 0, F.col("def_id"))).alias("unsafe_first"),
        F.count_if(F.col("unsolved") > 0).alias("unsolved_below"), F.coalesce(F.sum("unsolved"), F.lit(0)).cast("long").alias("unsolved_metas"),
    )
    own = graph.nodes.where(F.col("def_id") == i).select("def_id", (F.size("unsafe") > 0).alias("own_unsafe"), F.col("unsolved").cast("long").alias("own_unsolved"))
    return own.crossJoin(sums)  # one row each


def transitive_escapes(graph: Graph) -> DataFrame:
    """``def_id, unsafe_below, unsolved_below``: for every node, how many escaped and how many unsolved definitions it rests on.

    The ancestors of the few escaped nodes are walked, not every node's closure.
    """
    marked = graph.nodes.where((F.size("unsafe") > 0) | (F.col("unsolved") > 0)).select(F.col("def_id").alias("seed"), (F.size("unsafe") > 0).alias("u"), (F.col("unsolved") > 0).alias("m"))
    up = wide_closure(graph.edges, marked.select("seed"), reverse=True).join(marked, "seed")
    n = up.groupBy(F.col("node").alias("def_id")).agg(F.count_if("u").alias("unsafe_below"), F.count_if("m").alias("unsolved_below"))
    return graph.nodes.select("def_id").join(n, "def_id", "left").fillna(0)


def type_of(graph: Graph, name: str, sources: DataFrame | None = None, **how) -> DataFrame:
    """``def_id, name, signature, from_source``: the node's signature, or else the line of ``sources(module, line, text)`` it stands in."""
    d = resolve(graph, name, **how)
    own = graph.nodes.where(F.col("def_id") == (-1 if d is None else d.def_id)).select("def_id", "name", "module", "line", "sig")
    if sources is not None:
        own = own.join(sources.select("module", "line", "text"), ["module", "line"], "left")
    else:
        own = own.withColumn("text", F.lit(None).cast("string"))
    return own.select("def_id", "name", F.coalesce("sig", F.trim("text")).alias("signature"), (F.col("sig").isNull() & F.col("text").isNotNull()).alias("from_source"))


# --- look-alikes -------------------------------------------------------------------------------------------------


def signature_bags(graph: Graph, rounds: int = 2) -> DataFrame:
    """Colour histograms over signature edges (all edges without any provenance) of every real node."""
    tagged = not graph.edges.where("prov is not null").isEmpty()
    sig = graph.by_provenance("signature", untagged=False) if tagged else graph.edges
    return similarity.fingerprints(graph.nodes.where("is_real").select(F.col("def_id").alias("seed")), sig, similarity.refine(graph.nodes, sig, rounds))


def similar_types(graph: Graph, name: str, least: float = 0.5, bags: DataFrame | None = None, **how) -> DataFrame:
    """``def_id, name, sim``: definitions whose signature shape is like the node's; 0.99 at most where both texts are known and differ."""
    d = resolve(graph, name, **how)
    if d is None:
        return graph.nodes.limit(0).select("def_id", "name", F.lit(0.0).alias("sim"))
    bags = signature_bags(graph) if bags is None else bags
    text = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    near = similarity.similar_to(bags, d.def_id, 0.0, min_size=1, subject_size=2).select(F.col("owner").alias("def_id"), "sim")
    near = near.join(graph.nodes.where("is_real AND kind <> 'other'").select("def_id", "name", "sig"), "def_id")
    differs = F.coalesce(text(F.col("sig")) != text(F.lit(d.sig)), F.lit(False)) if d.sig is not None else F.lit(False)
    return near.select("def_id", "name", F.when(differs, F.least(F.col("sim"), F.lit(0.99))).otherwise(F.col("sim")).alias("sim")).where(F.col("sim") >= least)


def subterm_bags(graph: Graph) -> DataFrame:
    """``owner, item, w``: how often each subterm hash occurs in each definition."""
    return graph.subterms.groupBy(F.col("def_id").alias("owner"), F.col("hash").alias("item")).agg(F.count("*").alias("w"))


def similar_bodies(graph: Graph, name: str, least: float = 0.3, **how) -> DataFrame:
    """``def_id, name, sim``: real definitions that share subterms with the node, by weighted Jaccard of the multisets; it needs two subterms."""
    d = resolve(graph, name, **how)
    if d is None or graph.subterms is None:
        return graph.nodes.limit(0).select("def_id", "name", F.lit(0.0).alias("sim"))
    near = similarity.similar_to(subterm_bags(graph), d.def_id, least, min_size=1, subject_size=2).select(F.col("owner").alias("def_id"), "sim")
    return near.join(graph.nodes.where("is_real").select("def_id", "name"), "def_id").select("def_id", "name", "sim")


def brief(graph: Graph, name: str, shown: int = 5, **how) -> DataFrame:
    """``part, def_id, name, value``: the node, its direct callers and callees (``shown`` of each by name) and its three nearest bodies of 0.3 or more."""
    d = resolve(graph, name, **how)
    empty = "part string, def_id long, name string, value string"
    if d is None:
        return graph.spark.createDataFrame([], empty)
    own = graph.nodes.where(F.col("def_id") == d.def_id).select(F.lit("self").alias("part"), "def_id", "name", F.col("sig").alias("value"))
    side = lambda part, reverse: neighbours(graph, d.name, reverse).orderBy("name", "def_id").limit(shown).select(F.lit(part).alias("part"), "def_id", "name", F.col("prov").alias("value"))
    out = own.union(side("caller", True)).union(side("callee", False))
    if graph.subterms is not None:
        near = similar_bodies(graph, d.name).orderBy(F.desc("sim"), "def_id").limit(3)
        out = out.union(near.select(F.lit("twin"), "def_id", "name", F.round("sim", 6).cast("string")))
    return materialise(out, "brief")
