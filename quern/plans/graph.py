"""The property graph: nodes and set-valued edges as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

PROVENANCE = ("signature", "body", "module-local", "where", "with", "unknown")
KINDS = ("function", "projection", "datatype", "record", "constructor", "postulate", "primitive", "other")
STATES = ("D", "P", "H", "F")


@dataclass
class Graph:
    """``nodes(def_id, name, module, kind, state, access, line, sig, unsafe, unsolved, is_real)``, ``edges(src, dst, prov)``
    (distinct pairs; ``src`` uses ``dst``), and where known ``subterms(def_id, pos, hash, depth)``."""

    nodes: DataFrame
    edges: DataFrame
    subterms: DataFrame | None = None
    #: tables that belong to modules: files, modules, reexports, options, unsolved_modules
    extra: dict[str, DataFrame] = field(default_factory=dict)
    #: entry_module, producer, externals, ... of the document
    meta: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.nodes.sparkSession

    def stored(self) -> Graph:
        """The same graph, written once and reread."""
        sub = materialise(self.subterms, "subterms") if self.subterms is not None else None
        return Graph(materialise(self.nodes, "nodes"), materialise(self.edges, "edges"), sub, self.extra, self.meta)

    def loopless(self) -> DataFrame:
        return self.edges.where("src <> dst")

    def by_provenance(self, tag: str, untagged: bool = True) -> DataFrame:
        """Edges of one provenance; ``where`` is an alias of ``module-local``; untagged edges count as ``body`` if ``untagged``."""
        tag = "module-local" if tag == "where" else tag
        own = F.when(F.col("prov") == "where", "module-local").otherwise(F.coalesce("prov", F.lit("body" if untagged else None)))
        return self.edges.where(own == tag)

    def terminals(self) -> DataFrame:
        """Nodes that nothing uses."""
        return self.nodes.join(self.edges.select(F.col("dst").alias("def_id")), "def_id", "left_anti")
