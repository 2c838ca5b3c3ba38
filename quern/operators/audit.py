"""Unused-code audit: definitions, fields, arguments, imports and re-exports that nothing needs.

Names are keyed by (module, short name). The graph's edges give the users; the source texts only ever take a
finding back, where a name is mentioned although the graph lost its edge. Findings are rows of one schema.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import goals, names
from quern.operators.traverse import strong_components
from quern.session import materialise, ship
from quern.sources import text as source
from quern.sources.document import Document

KINDS = ("using", "blanket", "dead", "internal-only", "field", "arg-removable", "arg-erasable", "duplicate", "public")
FINDING = ("path", "line", "kind", "module", "symbol", "note", "confidence", "positions", "families")


def short_name(name: Column, module: Column) -> Column:
    """The name without its module; the name itself where it is not under it."""
    under = name.startswith(F.concat(module, F.lit(".")))
    return F.when(under, F.substring(name, F.length(module) + 2, F.length(name))).otherwise(name)


def is_anonymous(module: Column) -> Column:
    return module.contains("._")


@dataclass
class Usage:
    """``defs(module, short, line, access, kind, trivial, arg_usage)``, ``uses(user_module, module, short)`` across modules,
    ``intra(module, short, caller)``, ``recursive(module, short)``, ``reexports(host, module, short)``, ``live_fields(module, short)``."""

    defs: DataFrame
    uses: DataFrame
    intra: DataFrame
    recursive: DataFrame
    reexports: DataFrame
    live_fields: DataFrame


def usage(doc: Document) -> Usage:
    d = doc.definitions
    trivial = F.lit(False)
    if doc.meta.get("has_hashes") and doc.meta.get("has_depths"):
        size = doc.subterms.groupBy("ord").agg(F.count("*").alias("n_hashes"), F.max("depth").alias("deepest"))
        d = d.join(size, "ord", "left").fillna(0, ["n_hashes", "deepest"])
        # a function of one subterm at most and of little depth: the compiler may have put it into its callers
        trivial = (F.col("kind") == "function") & (F.col("n_hashes") <= 1) & (F.col("deepest") <= 3)
    own = d.select("module", short_name(F.col("name"), F.col("module")).alias("short"), "line", "access", "kind", trivial.alias("trivial"), "arg_usage", "ord")
    last = Window.partitionBy("module", "short").orderBy(F.desc("ord"))
    defs = materialise(own.withColumn("at", F.row_number().over(last)).where("at = 1").drop("at", "ord"), "defs")
    sm, dm = names.module_of(F.col("src")), names.module_of(F.col("dst"))
    e = doc.edges.select("src", "dst", sm.alias("user_module"), dm.alias("module"))
    e = e.withColumns({"short": short_name(F.col("dst"), F.col("module")), "caller": short_name(F.col("src"), F.col("user_module"))})
    e = materialise(e, "uses")
    inside = e.where("user_module = module")
    rx = doc.reexports.select(F.col("from").alias("host"), F.col("to").alias("module"), F.explode("names").alias("name"))
    rx = materialise(rx.select("host", "module", short_name(F.col("name"), F.col("module")).alias("short")).distinct(), "reexports")
    fields = defs.where("kind = 'projection'").select("module", "short")
    # the record's own edges to its fields are structure, not use, and so is the re-export by the module around it
    read = e.where("src <> module").select("module", "short").union(rx.where(F.col("host") != names.module_of(F.col("module"))).select("module", "short"))
    return Usage(
        defs, e.where("user_module <> module").select("user_module", "module", "short").distinct(), inside.where("src <> dst").select("module", "short", "caller").distinct(),
        inside.where("src = dst").select("module", "short").distinct(), rx, materialise(fields.join(read.distinct(), ["module", "short"], "left_semi"), "fields"),
    )


def users_closure(u: Usage, keys: DataFrame) -> DataFrame:
    """``module, short, user``: modules that use ``keys(module, short)``, directly, by re-exporting it, or through a re-export of any length."""
    reach = materialise(keys.select("module", "short", F.col("module").alias("at")).distinct(), "hosts")
    found, new = [reach], reach
    host = u.reexports.select(F.col("module").alias("at"), "short", "host")
    while True:
        nxt = new.join(host, ["at", "short"]).select("module", "short", F.col("host").alias("at")).distinct()
        new = materialise(nxt.join(reduce(DataFrame.union, found), ["module", "short", "at"], "left_anti"), "hosts")
        if new.isEmpty():
            break
        found.append(new)
    every = reduce(DataFrame.union, found)
    direct = every.join(u.uses.select(F.col("module").alias("at"), "short", F.col("user_module").alias("user")), ["at", "short"]).select("module", "short", "user")
    return direct.union(every.join(host, ["at", "short"]).select("module", "short", F.col("host").alias("user"))).distinct()


def dead_cycles(u: Usage) -> DataFrame:
    """``module, short, peers``: definitions that only call each other: strong components of two or more within a module
    without a caller outside them, a user elsewhere or a re-export."""
    key = lambda c: F.concat_ws("\x00", "module", c)
    nodes = u.intra.select(key("short").alias("k"), "module", "short").union(u.intra.select(key("caller"), "module", "caller")).distinct()
    from quern.plans.numbering import numbered

    ids = materialise(numbered(nodes, "k", name="id"), "ids")
    e = u.intra.select(key("caller").alias("a"), key("short").alias("b")).join(ids.select(F.col("k").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("k").alias("b"), F.col("id").alias("dst")), "b")
    e = materialise(e.select("src", "dst"), "calls")
    if e.isEmpty():
        return ids.select("module", "short", F.array("short").alias("peers")).limit(0)
    scc = materialise(strong_components(e), "scc")
    member = scc.join(ids.withColumnRenamed("id", "node"), "node").select("node", "scc", "module", "short")
    called = e.join(scc.toDF("src", "cs"), "src").join(scc.toDF("dst", "cd"), "dst").where("cs <> cd").select(F.col("cd").alias("scc"))
    used = member.join(users_closure(u, member), ["module", "short"], "left_semi").select("scc")
    alive = called.union(used).distinct()
    groups = member.groupBy("scc").agg(F.collect_set("short").alias("all")).where(F.size("all") > 1).join(alive, "scc", "left_anti")
    return member.join(groups, "scc").select("module", "short", F.array_sort(F.array_remove("all", F.col("short"))).alias("peers"))


# --- source text -------------------------------------------------------------------------------------------------


def spellings(keys: DataFrame, name: str) -> DataFrame:
    """``keys`` with ``alt, token, need``: how a name is written: whole, without its line tag, or as all its parts between underscores."""
    base = names.strip_line_tag(F.col(name))
    parts = F.array_distinct(F.filter(F.split(base, "_"), lambda p: p != ""))
    alts = F.when((F.size(parts) > 0) & (F.array_join(parts, "_") != base), F.array(F.array(base), parts)).otherwise(F.array(F.array(base)))
    return keys.select("*", F.posexplode(alts).alias("alt", "ts")).select(*keys.columns, "alt", F.size("ts").alias("need"), F.explode("ts").alias("token"))


def mentioned(keys: DataFrame, name: str, tokens: DataFrame, elsewhere: bool = False) -> DataFrame:
    """The distinct ``keys`` whose ``name`` is mentioned, some spelling in full, in the tokens of their ``path`` (``elsewhere``: of one other file)."""
    spelt = spellings(keys.distinct(), name)
    t = tokens.select(F.col("path").alias("in_path"), "token").distinct()
    hit = spelt.join(t, "token")
    hit = hit.where("in_path <> path" if elsewhere else "in_path = path")
    full = hit.groupBy(*keys.columns, "alt", "need", "in_path").agg(F.count("*").alias("n")).where("n = need")
    return full.select(*keys.columns).distinct()


def _finding(df: DataFrame, kind: Column | str, **cols) -> DataFrame:
    """Rows of the findings' schema; what is not given is null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    empty = {"symbol": "string", "note": "string", "positions": "array<int>", "families": "array<string>"}
    given = {"kind": kind, "confidence": F.lit("high")} | cols
    return df.select(*((given[c] if c in given else F.col(c) if c in df.columns else F.lit(None).cast(empty[c])).alias(c) for c in FINDING))


# --- the checks --------------------------------------------------------------------------------------------------


def unused_imports(u: Usage, imports: DataFrame, tokens: DataFrame, home: DataFrame) -> DataFrame:
    """Names of a ``using`` list that the file neither mentions outside imports nor refers to, and blanket imports of which it needs nothing.

    ``home(path, module)``: a file's least module, whose references count.
    """
    body = tokens.where("in_body")
    at = imports.join(home.withColumnRenamed("module", "this"), "path")
    listed = at.where(F.col("using").isNotNull()).select("path", "line", "module", "this", F.explode("using").alias("symbol"))
    refs = u.uses.select(F.col("user_module").alias("this"), "module", F.col("short").alias("symbol"))
    using = listed.join(mentioned(listed.select("path", "symbol"), "symbol", body), ["path", "symbol"], "left_anti").join(refs, ["this", "module", "symbol"], "left_anti")
    whole = at.where(F.col("using").isNull()).select("path", "line", "module", "this")
    surfaced = whole.join(u.reexports.select(F.col("host").alias("module"), F.col("short").alias("symbol")).distinct(), "module")
    named = surfaced.join(mentioned(surfaced.select("path", "symbol"), "symbol", body), ["path", "symbol"], "left_semi")
    used = surfaced.join(refs.select("this", "symbol").distinct(), ["this", "symbol"], "left_semi")
    needed = [x.select("path", "line", "module") for x in (whole.join(refs.select("this", "module").distinct(), ["this", "module"], "left_semi"), named, used)]
    blanket = whole.join(reduce(DataFrame.union, needed).distinct(), ["path", "line", "module"], "left_anti")
    return _finding(using, "using").union(_finding(blanket, "blanket", note=F.lit("nothing of this module is referred to, as far as the graph tells")))


def unused_definitions(u: Usage, located: DataFrame, files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Definitions without users: dead ones, dead cycles, fields never read, and those only their own module uses.

    ``located``: ``u.defs`` with ``path``. A text that mentions a dead name elsewhere, or in its own file beyond signature and left
    side, takes the finding back; recursive ones and cycles mention themselves, so only other files count there.
    """
    key = ["module", "short"]
    closure = users_closure(u, located)
    used = located.where("kind <> 'projection'").join(closure, key, "left_semi").select(*key)
    kept = located.join(used.union(u.live_fields).distinct(), key, "left_anti")
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    kept = kept.join(flag(u.intra, "has_caller"), key, "left").join(flag(u.recursive, "self"), key, "left").join(dead_cycles(u), key, "left")
    kept = materialise(kept.fillna(False, ["has_caller", "self"]).withColumn("cycle", F.col("peers").isNotNull()), "unused")
    dead = F.col("cycle") | ~F.col("has_caller")
    names_of = kept.where(dead).select("path", "short")
    elsewhere = mentioned(names_of, "short", tokens, elsewhere=True)
    spelt = spellings(names_of.distinct(), "short")
    counts = source.count_tokens(files, spelt.select("path", "token").distinct())
    # every part of one spelling more than twice: signature and left side have it already
    in_file = spelt.join(counts, ["path", "token"]).where("n > 2").groupBy("path", "short", "alt", "need").agg(F.count("*").alias("c")).where("c = need").select("path", "short").distinct()
    kept = kept.join(elsewhere.withColumn("crossed", F.lit(True)), ["path", "short"], "left").join(in_file.withColumn("again", F.lit(True)), ["path", "short"], "left").fillna(False, ["crossed", "again"])
    lost = dead & (F.col("crossed") | (F.col("again") & ~F.col("self") & ~F.col("cycle")))
    kept = kept.where(~lost & (dead | (F.col("access") != "private")))
    field = F.col("kind") == "projection"
    weak = ~F.col("has_caller") & F.col("trivial") & ~F.col("self")
    note = (
        F.when(dead & field, "remove the field from its record; matching by position reads it unseen")
        .when(F.col("cycle"), F.concat(F.lit("dead cycle with "), F.array_join("peers", ", ")))
        .when(F.col("has_caller"), "only its own module uses it").when(F.col("self"), "only its own calls use it")
        .when(F.col("trivial"), "trivial body, possibly put into its callers").otherwise("verify: a use in a with scrutinee leaves no edge")
    )
    kind = F.when(dead & field, "field").when(dead, "dead").otherwise("internal-only")
    return _finding(kept.withColumnRenamed("short", "symbol"), kind, note=note, confidence=F.when((dead & field) | weak, "low").otherwise("high"))


def _argument_columns(binders_known: bool) -> dict[str, Column]:
    a = lambda f: F.col(f"arg_usage.{f}")
    has = lambda i: F.array_contains(F.map_keys(a("binders")), i.cast("string"))
    written = lambda i: F.lit(True) if not binders_known else F.coalesce(i < a("syntacticArity"), has(i), F.lit(False))
    explicit = lambda i: F.coalesce(F.element_at(a("binders"), i.cast("string"))["hiding"] == "explicit", F.lit(True))
    none = F.array().cast("array<int>")
    flat = lambda c: F.coalesce(c, none)
    return {
        "removable": flat(a("removable")), "erasable": flat(a("erasable")),
        "removable_written": F.forall(flat(a("removable")), written), "erasable_written": F.forall(flat(a("erasable")), written),
        # used unsaturated, an explicit position pins the order of the others
        "blocked": F.coalesce(a("partiallyApplied"), F.lit(False)) & F.exists(flat(a("removable")), explicit),
        "threaded": F.array_intersect(flat(a("removable")), flat(a("occursInBody"))),
    }


def removal_set(arg_usage: Column, position: Column) -> Column:
    """What must go together with a removable position, itself included; empty if it is not removable."""
    own = F.array_contains(arg_usage["removable"], position)
    rest = F.coalesce(F.element_at(arg_usage["removableRequires"], position.cast("string")), F.array().cast("array<int>"))
    return F.when(own, F.array_sort(F.array_distinct(F.array_append(rest, position)))).otherwise(F.array().cast("array<int>"))


def premise_families(df: DataFrame, positions: str = "positions", binders: str = "binders") -> DataFrame:
    """``df`` with ``families``: the distinct head symbols of the flagged positions' binder types."""
    ship(df.sparkSession)
    # a stored column: ids made on the way would differ between the two sides of the join
    own = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "flagged")
    flat = own.select("_row", F.explode(F.col(positions)).alias("p"), binders).withColumn("type", F.element_at(F.col(binders), F.col("p").cast("string"))["type"])
    head = F.substring_index(goals.head_symbol(F.col("type")), ".", -1)
    flat = flat.withColumn("family", F.when(F.col("type").isNull(), "(no binder type)").otherwise(F.coalesce(head, F.lit("(no head symbol)"))))
    fam = flat.groupBy("_row").agg(F.array_sort(F.collect_set("family")).alias("families"))
    return own.join(fam, "_row", "left").drop("_row")


def unused_arguments(u: Usage, located: DataFrame, options: DataFrame) -> DataFrame:
    """Arguments that can be removed, or erased: one finding a definition and verdict, with the positions.

    Confidence is high where the edit is in reach: private or without outside users, on the signature line, no
    unsaturated use in the way of a removal, and, to erase, with erasure enabled for the module.
    """
    own = located.where(F.col("arg_usage").isNotNull())
    known = not own.where(F.col("arg_usage.syntacticArity").isNotNull() | (F.size(F.coalesce(F.map_keys("arg_usage.binders"), F.array().cast("array<string>"))) > 0)).isEmpty()
    own = own.withColumns(_argument_columns(known)).withColumn("binders", F.col("arg_usage.binders"))
    key = ["module", "short"]
    outside = users_closure(u, own).groupBy(*key).agg(F.count_distinct("user").alias("outside"))
    inside = u.intra.groupBy(*key).agg(F.count_distinct("caller").alias("inside"))
    own = own.join(outside, key, "left").join(inside, key, "left").fillna(0, ["outside", "inside"])
    on = options.where((F.col("kind") == "effective") & F.array_contains("flags", "--erasure")).select(F.col("module").alias("prefix")).distinct()
    enabled = own.select("module").distinct().select("module", F.explode(names.module_prefixes(F.col("module"))).alias("prefix")).join(on, "prefix", "left_semi").select("module").distinct()
    own = materialise(own.join(enabled.withColumn("erasure", F.lit(True)), "module", "left").fillna(False, ["erasure"]), "arguments")
    contained = (F.col("access") == "private") | (F.col("outside") == 0)
    radius = F.when((F.col("inside") == 0) & (F.col("outside") == 0), "no callers").otherwise(F.concat(F.col("inside"), F.lit(" caller(s) here, "), F.col("outside"), F.lit(" other module(s)")))
    base = own.withColumnRenamed("short", "symbol").select("path", "line", "module", "symbol", "binders", "removable", "erasable", "threaded", "blocked", "erasure", contained.alias("contained"), "removable_written", "erasable_written", radius.alias("radius"))
    rem = base.where(F.size("removable") > 0).withColumn("positions", F.col("removable"))
    note = F.concat(F.lit("arguments "), F.array_join("positions", ", "), F.when(F.size("threaded") > 0, F.concat(F.lit(" (passed on: "), F.array_join("threaded", ", "), F.lit(")"))).otherwise(""), F.when(F.col("blocked"), " (used unsaturated)").otherwise(""), F.lit("; "), F.col("radius"))
    rem = rem.select("path", "line", "module", "symbol", "positions", "binders", F.lit("arg-removable").alias("kind"), note.alias("note"), F.when(F.col("contained") & F.col("removable_written") & ~F.col("blocked"), "high").otherwise("low").alias("confidence"))
    era = base.where(F.size("erasable") > 0).withColumn("positions", F.col("erasable"))
    note = F.concat(F.lit("arguments "), F.array_join("positions", ", "), F.when(~F.col("erasure"), " (erasure is not enabled for this module)").otherwise(""), F.lit("; "), F.col("radius"))
    era = era.select("path", "line", "module", "symbol", "positions", "binders", F.lit("arg-erasable").alias("kind"), note.alias("note"), F.when(F.col("contained") & F.col("erasable_written") & F.col("erasure"), "high").otherwise("low").alias("confidence"))
    both = premise_families(materialise(rem.union(era), "arguments"))
    return both.select(*FINDING)


def unused_reexports(u: Usage, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Names that ``open import ... public`` passes on although no other module wants them. ``modules(path, module)``: each file's own."""
    at = imports.where("public").join(modules.withColumnRenamed("module", "this"), "path")
    listed = at.where(F.size(F.coalesce("using", F.array().cast("array<string>"))) > 0).select("path", "line", "module", "this", F.explode("using").alias("symbol"))
    through = users_closure(u, listed.select(F.col("this").alias("module"), F.col("symbol").alias("short"))).toDF("this", "symbol", "user")
    direct = u.uses.select("module", F.col("short").alias("symbol"), F.col("user_module").alias("user"))
    wanted = listed.join(through, ["this", "symbol"]).where("user <> this").select("path", "line", "module", "this", "symbol").union(listed.join(direct, ["module", "symbol"]).where("user <> this").select("path", "line", "module", "this", "symbol"))
    named = listed.join(wanted.distinct(), ["path", "line", "module", "this", "symbol"], "left_anti")
    whole = at.where(F.size(F.coalesce("using", F.array().cast("array<string>"))) == 0).select("path", "line", "module", "this")
    passed = whole.join(u.reexports.select(F.col("host").alias("this"), "module", "short"), ["this", "module"])
    users = users_closure(u, passed.select("module", "short"))
    alive = passed.join(users, ["module", "short"]).where("user <> this").select("path", "line", "module", "this").distinct()
    blanket = passed.select("path", "line", "module", "this").distinct().join(alive, ["path", "line", "module", "this"], "left_anti")
    return _finding(named, "public", note=F.lit("no other module refers to this re-export")).union(_finding(blanket, "public", note=F.lit("nothing of this re-export has a user")))


def duplicate_imports(imports: DataFrame) -> DataFrame:
    """All but the first import of a module in the same block of a file that also agree on being public."""
    w = Window.partitionBy("path", "module", "scope", "public").orderBy("line")
    again = imports.withColumn("at", F.row_number().over(w)).where("at > 1")
    return _finding(again, "duplicate", note=F.lit("an earlier line of this block imports the module"))


def audit(doc: Document, files: DataFrame, kinds: tuple[str, ...] = KINDS, min_confidence: str = "low", exclude: tuple[str, ...] = ()) -> DataFrame:
    """All findings of ``kinds``, by path and line; ``files(path, text)`` are the sources of the document's modules.

    Globs in ``exclude`` drop findings by path or module. Files that no module is in, and anonymous modules, are passed over.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown finding kind {sorted(unknown)}; use some of {', '.join(KINDS)}")
    u = usage(doc)
    at = doc.files.select("path", "module").distinct()
    files = materialise(files.join(at.select("path").distinct(), "path", "left_semi"), "sources")
    imports, tokens = source.scanned(files)
    at = at.join(files.select("path"), "path", "left_semi")
    home = at.groupBy("path").agg(F.min("module").alias("module"))
    facing = materialise(at.where(~is_anonymous(F.col("module"))), "modules")
    located = materialise(u.defs.join(facing, "module"), "located")
    parts = []
    if {"using", "blanket"} & set(kinds):
        parts.append(unused_imports(u, imports, tokens, home))
    if {"dead", "internal-only", "field"} & set(kinds):
        parts.append(unused_definitions(u, located, files, tokens))
    if {"arg-removable", "arg-erasable"} & set(kinds):
        parts.append(unused_arguments(u, located, doc.options))
    if "duplicate" in kinds:
        parts.append(duplicate_imports(imports))
    if "public" in kinds:
        parts.append(unused_reexports(u, imports, facing))
    out = reduce(DataFrame.union, parts).where(F.col("kind").isin(*kinds)).withColumn("line", F.coalesce("line", F.lit(0)))
    if min_confidence == "high":
        out = out.where("confidence = 'high'")
    for g in exclude:
        out = out.where(~names.glob_match(F.col("path"), g) & ~names.glob_match(F.col("module"), g))
    return out.orderBy("path", "line", "kind", "symbol")


def tally(findings: DataFrame, by: str) -> DataFrame:
    """``key, n``: findings by ``kind``, ``file``, ``dir`` or ``premise``, most first, then by key; a finding has a key for each premise family."""
    keys = {
        "kind": F.array("kind"), "file": F.array("path"), "dir": F.array(F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))),
        "premise": F.coalesce("families", F.array(F.lit("(not an argument finding)"))),
    }
    if by not in keys:
        raise ValueError(f"unknown group {by!r}; use one of {', '.join(keys)}")
    return findings.select(F.explode(keys[by]).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def lines(findings: DataFrame, root: str = "") -> DataFrame:
    """``value``: a finding a line, paths relative to ``root``."""
    prefix = root.rstrip("/") + "/"
    path = F.when(F.col("path").startswith(prefix), F.substring("path", F.lit(len(prefix) + 1), F.length("path"))).otherwise(F.col("path")) if root else F.col("path")
    return findings.select(F.concat_ws(" ", F.concat(path, F.lit(":"), F.col("line"), F.lit(":")), F.concat(F.lit("["), F.col("kind"), F.lit("]")), "module", "symbol", F.concat(F.lit("("), F.col("confidence"), F.lit(")")), "note").alias("value"))
