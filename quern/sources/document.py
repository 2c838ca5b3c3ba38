"""The graph document: one JSON object of definitions, edges and what belongs to modules, read into tables and written from them.

A large document is several such objects, one a line: pieces, whose lists are joined in the order of ``part``, from 0;
what is no list stands in the first. No task holds more than a few pieces.

The schema is explicit and versioned. A document that cannot be read raises :class:`DocumentError`, whose
message says what to do; optional parts that are missing stay missing, none is made up.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import names
from quern.plans.graph import KINDS, PROVENANCE, STATES, Graph
from quern.plans.numbering import numbered
from quern.session import materialise

VERSION = 2
_BINDER = "struct<hiding: string, name: string, type: string>"
_ARGS = f"struct<removable: array<int>, removableRequires: map<string, array<int>>, occursInBody: array<int>, erasable: array<int>, arity: int, syntacticArity: int, partiallyApplied: boolean, binders: map<string, {_BINDER}>>"
_DEFINITION = f"struct<id: bigint, name: string, module: string, state: string, kind: string, line: int, access: string, type: string, unsafe: array<string>, unsolvedMetas: int, argUsage: {_ARGS}, x: double, y: double>"
#: Field order is that of the written document. Subterm hashes are unsigned 64-bit numbers.
DDL = (
    f"v int, schemaVersion int, mode string, part int, definitions array<{_DEFINITION}>, definitionEdges array<array<string>>, modules array<string>, entryModule string, externalModules array<string>, "
    "failedModules array<string>, moduleFiles map<string, string>, producer string, nodeKeyVersion int, "
    "reexports array<struct<`from`: string, `to`: string, names: array<string>, renames: map<string, string>>>, "
    "externals_summary struct<modules: array<string>, postulates_by_module: map<string, array<string>>>, "
    "definitionEdgesProvenance array<string>, definitionSubtermHashes array<array<decimal(20,0)>>, definitionSubtermDepths array<array<int>>, "
    "moduleOptionEscapes map<string, array<string>>, moduleEffectiveOptions map<string, array<string>>, unsolvedModules map<string, struct<metas: array<int>, constraints: array<int>>>"
)
REQUIRED = ("definitions", "definitionEdges", "moduleFiles", "modules")
ACCESS = ("public", "private")
#: Entries of a list in one piece.
PIECE = 10_000
ARRAYS = ("definitions", "definitionEdges", "definitionEdgesProvenance", "definitionSubtermHashes", "definitionSubtermDepths", "modules", "externalModules", "failedModules", "reexports")


@cache
def schema() -> T.StructType:
    return T._parse_datatype_string(DDL)


class DocumentError(ValueError):
    """A document that cannot be read."""


@dataclass
class Document:
    """The document's parts as tables; ``ord`` is the place in the document, from 0.

    ``definitions(ord, name, module, state, kind, access, line, type, unsafe, unsolved, arg_usage, x, y)``,
    ``edges(ord, src, dst, prov)`` by name, ``subterms(ord, pos, hash, depth)``, ``modules(ord, module, role)`` with role
    ``own``, ``external`` or ``failed``, ``files(module, path)``, ``reexports(ord, from, to, names, renames)``,
    ``options(module, kind, flags)`` with kind ``escape`` or ``effective``, ``unsolved(module, metas, constraints)``.
    """

    definitions: DataFrame
    edges: DataFrame
    subterms: DataFrame
    modules: DataFrame
    files: DataFrame
    reexports: DataFrame
    options: DataFrame
    unsolved: DataFrame
    #: entry_module, producer, node_key_version, has_provenance, has_hashes, has_depths, externals (module names or None), postulates_by_module
    meta: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.definitions.sparkSession


def explain(error: BaseException) -> DocumentError:
    """The reader's own messages as they are; any other failure with a pointer to what was expected."""
    if isinstance(error, DocumentError):
        return error
    text = str(error).splitlines()[0] if str(error) else type(error).__name__
    if "PATH_NOT_FOUND" in str(error):
        return DocumentError("file does not exist; write one in the expanded form of version 2")
    return DocumentError(f"not an expanded document of version 2 ({text})")


def _check(condition, message: str) -> None:
    if not condition:
        raise DocumentError(message)


def read_document(spark: SparkSession, path: str) -> Document:
    """The document at ``path``; :class:`DocumentError` if it is missing, no JSON object, of another version or form, or inconsistent."""
    try:
        return _read(spark, path)
    except (DocumentError, PySparkException) as e:
        raise explain(e) from e
    except Exception as e:  # the JVM's own exceptions
        if "Exception" in type(e).__name__ or "Py4J" in type(e).__name__:
            raise explain(e) from e
        raise


def _read(spark: SparkSession, path: str) -> Document:
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    _check(first is not None, "empty file; expected the expanded form of version 2")
    _check(first[0] == "{", f"not JSON (starts with {first[0]!r}); expected the expanded form of version 2")
    pieces = not spark.read.text(path).where(F.substring("value", 1, 100).rlike(r'^\{"v":\d+,"schemaVersion":\d+,"mode":"\w+","part":\d+,')).isEmpty()
    parse = lambda kind: spark.read.schema(kind).option("multiLine", not pieces).option("mode", "FAILFAST").json(path)
    heads = parse(T._parse_datatype_string("v int, mode string, part int"))
    head = heads.orderBy("part").first()
    _check(head.v == VERSION, f"expected schema v: {VERSION}, got: {head.v or 0}")
    _check(head["mode"] == "expanded", f"this document is in {head['mode'] or 'packed'} form, which lacks kinds, lines, access, signatures and subterm hashes; write the expanded form")
    # pieces are read as often as their lists are needed, a few lines a task
    one = parse(schema()) if pieces else materialise(parse(schema()), "document")
    one = one.withColumn("part", F.coalesce("part", F.lit(0)))
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    uneven = F.coalesce(F.exists(F.arrays_zip("definitionSubtermHashes", "definitionSubtermDepths"), lambda z: F.size(z["definitionSubtermHashes"]) != F.size(z["definitionSubtermDepths"])), F.lit(False))
    # lists of every piece: one row a piece
    sizes = materialise(one.select("part", *(size(c).alias(c) for c in ARRAYS), uneven.alias("uneven"), *(F.col(c).isNull().alias(f"no_{c}") for c in REQUIRED)), "sizes")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(sizes.select("part", *(F.coalesce(F.sum(F.greatest(c, F.lit(0))).over(upto), F.lit(0)).alias(f"first_{c}") for c in ARRAYS)), "first")
    one = one.join(F.broadcast(first), "part")
    total = [F.when(F.max(c) < 0, -1).otherwise(F.sum(F.greatest(c, F.lit(0)))).alias(c) for c in ARRAYS]
    m = sizes.agg(*total, F.bool_or("uneven").alias("uneven"), F.count("*").alias("pieces"), F.count_distinct("part").alias("parts"), F.max("part").alias("last"), *(F.bool_and(f"no_{c}").alias(f"no_{c}") for c in REQUIRED)).first()
    _check(m.pieces == m.parts == m["last"] + 1, f"{m['last'] + 1} pieces expected, {m.parts} of {m.pieces} found")
    told = one.where("part = 0").select("entryModule", "producer", "nodeKeyVersion", "externals_summary").first()
    for c in REQUIRED:
        _check(not m[f"no_{c}"], f"key {c!r} is missing")
    for c, of in (("definitionEdgesProvenance", "definitionEdges"), ("definitionSubtermHashes", "definitions"), ("definitionSubtermDepths", "definitions")):
        _check(m[c] <= 0 or m[c] == m[of], f"{c} length ({m[c]}) does not match {of} ({m[of]})")
    _check(not (m.definitionSubtermHashes > 0 and m.definitionSubtermDepths > 0 and m.uneven), "definitionSubtermDepths inner-array lengths do not match definitionSubtermHashes")

    placed = lambda c, name, *more: one.select(F.posexplode(c).alias("at", name), f"first_{c}", "part", *more).withColumn("ord", F.col("at") + F.col(f"first_{c}"))
    d = placed("definitions", "d").select(
        "ord", "d.name", "d.module", F.coalesce("d.state", F.lit("D")).alias("state"), F.coalesce("d.kind", F.lit("other")).alias("kind"), F.coalesce("d.access", F.lit("public")).alias("access"),
        "d.line", "d.type", F.coalesce("d.unsafe", F.array().cast("array<string>")).alias("unsafe"), F.coalesce("d.unsolvedMetas", F.lit(0)).alias("unsolved"),
        F.col("d.argUsage").alias("arg_usage"), F.coalesce("d.x", F.lit(0.0)).alias("x"), F.coalesce("d.y", F.lit(0.0)).alias("y"),
    )
    d = materialise(d.withColumn("ord", F.col("ord").cast("long")), "definitions")
    e = placed("definitionEdges", "e", "definitionEdgesProvenance")
    tag = F.get("definitionEdgesProvenance", F.col("at")) if m.definitionEdgesProvenance > 0 else F.lit(None).cast("string")
    e = materialise(e.select(F.col("ord").cast("long").alias("ord"), F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"), F.size("e").alias("n"), tag.alias("prov")), "edges")
    _check(e.where("n <> 2 or src is null or dst is null").isEmpty(), "an edge is not a pair of names")
    _check(d.where("name is null or module is null").isEmpty(), "a definition lacks its name or module")
    for df, c, known in ((d, "state", STATES), (d, "kind", KINDS), (d, "access", ACCESS), (e, "prov", PROVENANCE)):
        bad = df.where(F.col(c).isNotNull() & ~F.col(c).isin(*known)).select(c).first()
        _check(bad is None, f"unknown {c}: {bad and bad[0]}")
    if m.definitionSubtermHashes > 0:
        s = placed("definitionSubtermHashes", "h", "definitionSubtermDepths")
        s = s.select(F.col("ord").cast("long").alias("ord"), F.posexplode("h").alias("pos", "hash"), F.get("definitionSubtermDepths", F.col("at")).alias("ds"))
        s = s.select("ord", F.col("pos").cast("long").alias("pos"), "hash", F.coalesce(F.get("ds", F.col("pos")), F.lit(1)).alias("depth"))
    else:
        s = spark.createDataFrame([], "ord long, pos long, hash decimal(20,0), depth int")
    role = lambda c, r: placed(c, "module").select(F.col("ord").cast("int").alias("ord"), "module", F.lit(r).alias("role"))
    modules = role("modules", "own").union(role("externalModules", "external")).union(role("failedModules", "failed"))
    option = lambda c, k: one.select(F.explode(c).alias("module", "flags")).select("module", F.lit(k).alias("kind"), "flags")
    rx = placed("reexports", "r").select(F.col("ord").cast("int").alias("ord"), "r.from", "r.to", "r.names", "r.renames")
    unsolved = one.select(F.explode("unsolvedModules").alias("module", "u")).select("module", "u.metas", "u.constraints")
    ext = told.externals_summary
    meta = {
        "entry_module": told.entryModule, "producer": told.producer, "node_key_version": told.nodeKeyVersion or 1, "has_provenance": m.definitionEdgesProvenance > 0,
        "has_hashes": m.definitionSubtermHashes > 0, "has_depths": m.definitionSubtermDepths > 0,
        "externals": ext and list(ext.modules or ()), "postulates_by_module": ext and dict(ext.postulates_by_module or {}),
    }
    return Document(
        d, e.drop("n"), materialise(s, "subterms"), materialise(modules, "modules"), materialise(one.select(F.explode("moduleFiles").alias("module", "path")), "files"), materialise(rx, "reexports"),
        materialise(option("moduleOptionEscapes", "escape").union(option("moduleEffectiveOptions", "effective")), "options"), materialise(unsolved, "unsolved"), meta,
    )


def encode_document(doc: Document, piece: int | None = None) -> DataFrame:
    """``value``: the document as one JSON object, without empty optional parts; write it with ``.write.text``.

    Lists of more than ``piece`` entries (:data:`PIECE`) are dealt over several objects, a row each.
    """
    spark, piece = doc.spark, PIECE if piece is None else piece
    by_place = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    whole = lambda item, order: F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))), by_place)
    part = lambda order: F.floor(F.col(order) / piece).cast("int").alias("part")
    listed = lambda df, item, order="ord": df.groupBy(part(order)).agg(F.transform(whole(item, order), lambda z: z["x"]).alias("a"))
    d = doc.definitions
    some = lambda c, cond: F.when(cond, F.col(c))
    item = F.struct(
        F.col("ord").alias("id"), "name", "module", "state", "kind", "line", "access", F.col("type"), some("unsafe", F.size("unsafe") > 0).alias("unsafe"),
        some("unsolved", F.col("unsolved") > 0).alias("unsolvedMetas"), F.col("arg_usage").alias("argUsage"), "x", "y",
    )
    parts = {"definitions": listed(d, item), "definitionEdges": listed(doc.edges, F.array("src", "dst"))}
    if doc.meta.get("has_provenance"):
        parts["definitionEdgesProvenance"] = listed(doc.edges, F.coalesce("prov", F.lit("unknown")))
    if doc.meta.get("has_hashes") or doc.meta.get("has_depths"):
        per = doc.subterms.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "depth"))).alias("s"))
        per = d.select("ord").join(per, "ord", "left").withColumn("s", F.coalesce("s", F.array().cast(per.schema["s"].dataType)))
    if doc.meta.get("has_hashes"):
        parts["definitionSubtermHashes"] = listed(per, F.transform("s", lambda z: z["hash"]))
    if doc.meta.get("has_depths"):
        parts["definitionSubtermDepths"] = listed(per, F.transform("s", lambda z: z["depth"]))
    for c, r in (("modules", "own"), ("externalModules", "external"), ("failedModules", "failed")):
        parts[c] = listed(doc.modules.where(F.col("role") == r), F.col("module"))
    parts["reexports"] = listed(doc.reexports, F.struct("from", "to", "names", "renames"))
    # what belongs to modules is dealt by their names over as many pieces as it needs
    dealt = lambda df: F.pmod(F.xxhash64("module"), F.lit(df.count() // piece + 1)).cast("int").alias("part")
    as_map = lambda df, v: df.groupBy(dealt(df)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", v.alias("v"))))).alias("a"))
    parts["moduleFiles"] = as_map(doc.files, F.col("path"))
    for c, df, v in (
        ("moduleOptionEscapes", doc.options.where("kind = 'escape'"), F.col("flags")), ("moduleEffectiveOptions", doc.options.where("kind = 'effective'"), F.col("flags")),
        ("unsolvedModules", doc.unsolved, F.struct("metas", "constraints")),
    ):
        if not df.isEmpty():
            parts[c] = as_map(df, v)
    ext = doc.meta.get("externals")
    summary = T._parse_datatype_string("modules array<string>, postulates_by_module map<string, array<string>>")
    scalars = spark.createDataFrame(
        [(0, doc.meta.get("entry_module"), doc.meta.get("producer"), doc.meta.get("node_key_version") or 1, None if ext is None else (ext, doc.meta.get("postulates_by_module") or {}))],
        T._parse_datatype_string("part int, entryModule string, producer string, nodeKeyVersion int").add("externals_summary", summary),
    )
    for c, df in parts.items():  # a row a piece
        kind = df.schema["a"].dataType
        none = F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.create_map().cast(kind)
        scalars = scalars.join(df.withColumnRenamed("a", c).hint("merge"), "part", "full").withColumn(c, F.coalesce(c, F.when(F.col("part") == 0, none)))
    last = max(doc.definitions.count(), doc.edges.count(), doc.modules.count(), doc.reexports.count(), doc.files.count(), doc.options.count(), doc.unsolved.count()) // piece
    if last:  # every number has its piece
        scalars = scalars.join(spark.range(last + 1).select(F.col("id").cast("int").alias("part")).hint("merge"), "part", "full")
    else:
        scalars = scalars.withColumn("part", F.when(F.col("part") > 0, F.col("part")))
    scalars = scalars.withColumns({"v": F.lit(VERSION), "schemaVersion": F.lit(VERSION), "mode": F.lit("expanded")})
    return scalars.select(F.to_json(F.struct(*(f.name for f in schema() if f.name in scalars.columns))).alias("value"))


def write_document(doc: Document, path: str) -> None:
    encode_document(doc).write.mode("error").text(path)


def build_index(doc: Document, origin: str | None = None) -> Graph:
    """The graph of a document.

    Ids are places in ``definitions``; of a name defined twice, edges mean the last. Names that only edges have
    become synthetic nodes of kind ``other``, numbered on in order of first appearance. An edge listed twice
    keeps its last tag. A module's option escapes join the ``unsafe`` list of all its nodes. Columns nobody
    reads are never read: that is the lean index.
    """
    d = doc.definitions
    real = d.select(
        F.col("ord").alias("def_id"), "name", "module", "kind", "state", "access", "line", F.col("type").alias("sig"), "unsafe", "unsolved", F.lit(True).alias("is_real"), "arg_usage", "x", "y",
        F.lit(origin).cast("string").alias("origin"),
    )
    ids = real.groupBy("name").agg(F.max("def_id").alias("id"))
    ends = doc.edges.select(F.explode(F.array(F.struct((2 * F.col("ord")).alias("o"), F.col("src").alias("name")), F.struct((2 * F.col("ord") + 1).alias("o"), F.col("dst").alias("name")))).alias("e")).select("e.*")
    missing = ends.groupBy("name").agg(F.min("o").alias("o")).join(ids.select("name"), "name", "left_anti")
    synth = numbered(missing, "o", name="id", start=d.count()).select("name", "id")
    synth = materialise(synth, "synthetic")
    empty = F.array().cast("array<string>")
    made = synth.select(
        F.col("id").alias("def_id"), "name", names.module_of(F.col("name")).alias("module"), F.lit("other").alias("kind"), F.lit("D").alias("state"), F.lit("public").alias("access"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("sig"), empty.alias("unsafe"), F.lit(0).alias("unsolved"), F.lit(False).alias("is_real"),
        F.lit(None).cast(real.schema["arg_usage"].dataType).alias("arg_usage"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(origin).cast("string").alias("origin"),
    )
    nodes = real.union(made)
    escapes = doc.options.where("kind = 'escape'").groupBy("module").agg(F.flatten(F.collect_list("flags")).alias("flags"))
    nodes = nodes.join(escapes, "module", "left").withColumn("unsafe", F.when(F.col("flags").isNull(), F.col("unsafe")).otherwise(F.array_sort(F.array_distinct(F.concat("unsafe", F.coalesce("flags", empty))))))
    nodes = nodes.select(*real.columns)
    every = ids.union(synth)
    e = doc.edges.join(every.toDF("src", "s"), "src").join(every.toDF("dst", "t"), "dst")
    e = e.groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.max_by("prov", "ord").alias("prov"))
    sub = doc.subterms.select(F.col("ord").alias("def_id"), "pos", "hash", "depth") if doc.meta.get("has_hashes") else None
    extra = {"files": doc.files, "modules": doc.modules, "reexports": doc.reexports, "options": doc.options, "unsolved_modules": doc.unsolved}
    out = Graph(nodes, e, sub, extra).stored()
    return replace(out, meta=dict(doc.meta))


def document_of(graph: Graph, **meta) -> Document:
    """A document of a graph's real nodes, in order of id, and of all its edges, by name."""
    spark = graph.spark
    own = graph.nodes.where("is_real")
    blank = lambda name, kind: F.col(name) if name in own.columns else F.lit(None).cast(kind)
    arg = next(f.dataType for f in schema()["definitions"].dataType.elementType if f.name == "argUsage")
    d = numbered(own, "def_id", name="ord").select(
        "ord", "name", "module", "state", "kind", "access", F.col("line").cast("int").alias("line"), F.col("sig").alias("type"), "unsafe", F.col("unsolved").cast("int").alias("unsolved"),
        blank("arg_usage", arg).alias("arg_usage"), F.coalesce(blank("x", "double"), F.lit(0.0)).alias("x"), F.coalesce(blank("y", "double"), F.lit(0.0)).alias("y"), "def_id",
    )
    d = materialise(d, "definitions")
    named = graph.nodes.select("def_id", "name")
    e = graph.edges.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst")
    e = materialise(numbered(e, "src", "dst", name="ord").select("ord", F.col("a").alias("src"), F.col("b").alias("dst"), "prov"), "edges")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    s = empty("ord long, pos long, hash decimal(20,0), depth int") if graph.subterms is None else graph.subterms.join(d.select("def_id", "ord"), "def_id").select("ord", "pos", "hash", "depth")
    mods = d.select("module").distinct()
    extra = graph.extra
    return Document(
        d.drop("def_id"), e, s, extra.get("modules", numbered(mods, "module", name="ord").select("ord", "module", F.lit("own").alias("role"))),
        extra.get("files", mods.select("module", F.concat(F.translate("module", ".", "/"), F.lit(".agda")).alias("path"))), extra.get("reexports", empty("ord int, `from` string, `to` string, names array<string>, renames map<string,string>")),
        extra.get("options", empty("module string, kind string, flags array<string>")), extra.get("unsolved_modules", empty("module string, metas array<int>, constraints array<int>")),
        {"has_provenance": not e.where("prov is not null").isEmpty(), "has_hashes": graph.subterms is not None, "has_depths": graph.subterms is not None} | graph.meta | meta,
    )


def load_overlays(spark: SparkSession, paths: dict[str, str]) -> list[Graph]:
    """Graphs of other documents, each node tagged with its overlay's label as ``origin``."""
    return [build_index(read_document(spark, p), origin=label) for label, p in paths.items()]


def lookup(graph: Graph, key: str | int):
    """The node of a name or id, as a row; None if there is none. Of a name defined twice, the last."""
    col = "def_id" if isinstance(key, int) else "name"
    return graph.nodes.where(F.col(col) == key).orderBy(F.desc("def_id")).first()


def identity(graph: Graph) -> int:
    """A digest that does not depend on the order of rows: the sum of row hashes modulo 2**64."""
    own = F.xxhash64("name", "kind", "state").cast("decimal(38,0)")
    total = graph.nodes.agg(F.sum(own)).first()[0]
    return int(total or 0) % (1 << 64)
