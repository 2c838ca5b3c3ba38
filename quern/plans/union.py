"""Union of graph documents: one graph of what several entries saw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.numbering import numbered
from quern.session import materialise
from quern.sources.document import Document


def _tagged(parts: list[DataFrame]) -> DataFrame:
    """The tables one under the other, ``g`` the place of the document."""
    return reduce(DataFrame.unionByName, (p.withColumn("g", F.lit(i)) for i, p in enumerate(parts)))


def union_documents(docs: list[Document]) -> Document:
    """One document of several, in order of precedence; a single one is itself.

    Definitions: of each name the first record, with the first signature that is not missing, and subterms, hashes
    and depths together, of the first that has any; sorted by name. Edges: each pair once, in order of first
    appearance, with the first tag that is not ``unknown``. Files: the first path. Flags and unsolved lines of a
    module: merged, sorted. Modules: each once, in order. Entry, producer and externals: the first document's.
    """
    if not docs:
        raise ValueError("no documents to unite")
    if len(docs) == 1:
        return docs[0]
    at = F.struct("g", "ord")
    d = _tagged([x.definitions for x in docs])
    own = d.groupBy("name").agg(F.min_by(F.struct(*(c for c in docs[0].definitions.columns if c not in ("ord", "name"))), at).alias("d"), F.min_by("type", F.when(F.col("type").isNotNull(), at)).alias("sig"))
    own = own.select("name", "d.*", "sig").withColumn("type", F.col("sig")).drop("sig")
    own = materialise(numbered(own, "name", name="ord").select(*docs[0].definitions.columns), "definitions")
    s = _tagged([x.subterms.join(x.definitions.select("ord", "name"), "ord") for x in docs])
    first = s.groupBy("name").agg(F.min(at).alias("at"))
    s = s.join(first, "name").where(at == F.col("at")).join(own.select("name", F.col("ord").alias("n")), "name").select(F.col("n").alias("ord"), "pos", "hash", "depth")
    has = {k: any(x.meta.get(k) for x in docs) for k in ("has_provenance", "has_hashes", "has_depths")}
    e = _tagged([x.edges for x in docs])
    known = F.when(F.col("prov") != "unknown", at)
    e = e.groupBy("src", "dst").agg(F.min(at).alias("at"), F.min_by("prov", known).alias("prov"))
    tag = F.coalesce("prov", F.lit("unknown")) if has["has_provenance"] else F.lit(None).cast("string")
    e = materialise(numbered(e.select("src", "dst", tag.alias("prov"), "at.g", "at.ord"), "g", "ord", name="place").select(F.col("place").alias("ord"), "src", "dst", "prov"), "edges")
    m = _tagged([x.modules for x in docs]).groupBy("role", "module").agg(F.min(at).alias("at"))
    m = numbered(m.select("role", "module", "at.g", "at.ord"), "role", "g", "ord", name="place").select(F.col("place").cast("int").alias("ord"), "module", "role")
    files = _tagged([x.files for x in docs]).groupBy("module").agg(F.min_by("path", "g").alias("path"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    options = _tagged([x.options for x in docs]).groupBy("module", "kind").agg(merged("flags"))
    unsolved = _tagged([x.unsolved for x in docs]).groupBy("module").agg(merged("metas"), merged("constraints"))
    rx = _tagged([x.reexports for x in docs])
    rx = numbered(rx, "g", "ord", name="place").select(F.col("place").cast("int").alias("ord"), "from", "to", "names", "renames")
    return Document(own, e, materialise(s, "subterms"), materialise(m, "modules"), files, materialise(rx, "reexports"), options, unsolved, docs[0].meta | has)
