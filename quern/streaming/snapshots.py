"""Live snapshots: file events in, graphs of the entries they touch rebuilt, a new snapshot published whole.

Events are a stream of ``(path, ts, signature)`` rows. A micro-batch is the coalesced burst; its files are joined
with the entries' file closures, and only entries they touch are rebuilt. Each entry's graph stays in its own folder,
so a restart starts from what is there. A snapshot is a folder of tables, and a pointer file names the current one;
readers pin the snapshot they started with.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.graph import Graph
from quern.plans.union import union_documents
from quern.sources import document as D

#: Folders whose files are never sources: version control and build output.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "_build", "dist", "dist-newstyle", "node_modules")
SOURCE_SUFFIXES = (".agda", ".lagda", ".lagda.md", ".lagda.rst", ".lagda.tex", ".lagda.org")
EVENTS = "path string, ts timestamp, signature string"
POINTER = "CURRENT"


def file_events(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of events from JSON lines that a watcher drops into ``folder``; other files than sources are left out."""
    raw = spark.readStream.schema(EVENTS).options(**options).json(folder)
    return source_events(raw)


def source_events(events: DataFrame) -> DataFrame:
    """Events of source files outside version control and build folders."""
    is_source = F.lit(False)
    for s in SOURCE_SUFFIXES:
        is_source = is_source | F.col("path").endswith(s)
    skipped = F.exists(F.split("path", "/"), lambda p: p.isin(*SKIPPED_FOLDERS))
    return events.where(is_source & ~skipped)


def coalesced(batch: DataFrame) -> DataFrame:
    """``path, ts, signature``: the last event of each file."""
    last = batch.groupBy("path").agg(F.max(F.struct("ts", "signature")).alias("x"))
    return last.select("path", "x.ts", "x.signature")


def touched_entries(dirty: DataFrame, closures: DataFrame) -> list[str]:
    """The entries with a dirty file in their closure ``(entry, path)``; all of them if some dirty file is in none."""
    entries = sorted(r.entry for r in closures.select("entry").distinct().collect())  # a handful of entry modules
    if not dirty.join(closures, "path", "left_anti").isEmpty():
        return entries
    return sorted(r.entry for r in closures.join(dirty, "path", "left_semi").select("entry").distinct().collect())


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file with this content, by writing another and renaming it."""
    fs, p = _fs(spark, path)
    _, temporary = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"cannot publish {path}")


@dataclass
class Snapshot:
    """A published graph: ``graph`` of ``version``, made at ``built``; ``stale`` if newer events are waiting."""

    graph: Graph
    version: str
    built: float
    stale: bool = False


@dataclass
class Store:
    """Snapshots and per-entry documents under ``root``."""

    spark: SparkSession
    root: str

    def entry_path(self, entry: str) -> str:
        return f"{self.root}/entries/{entry}"

    def save_entry(self, entry: str, doc: D.Document) -> None:
        """Publish an entry's document: a new folder, then the pointer; readers of the old one are not disturbed."""
        version = uuid.uuid4().hex
        D.encode_document(doc).write.text(f"{self.entry_path(entry)}/{version}")
        _write_text(self.spark, f"{self.entry_path(entry)}/{POINTER}", version)

    def entry(self, entry: str) -> D.Document | None:
        version = _read_text(self.spark, f"{self.entry_path(entry)}/{POINTER}")
        return None if version is None else D.read_document(self.spark, f"{self.entry_path(entry)}/{version}")

    def publish(self, graph: Graph, version: str | None = None) -> str:
        """Write the graph's tables to a new folder, then move the pointer to it."""
        version = version or f"{time.time_ns():020d}"
        at = f"{self.root}/snapshots/{version}"
        graph.nodes.write.parquet(f"{at}/nodes")
        graph.edges.write.parquet(f"{at}/edges")
        if graph.subterms is not None:
            graph.subterms.write.parquet(f"{at}/subterms")
        meta = {"version": version, "built": time.time(), "subterms": graph.subterms is not None, "meta": {k: v for k, v in graph.meta.items() if isinstance(v, (str, int, bool, type(None)))}}
        _write_text(self.spark, f"{at}/META", json.dumps(meta))
        _write_text(self.spark, f"{self.root}/{POINTER}", version)
        return version

    def current(self, pending: bool = False) -> Snapshot | None:
        """The snapshot the pointer names, pinned: later publishing does not change its tables."""
        version = _read_text(self.spark, f"{self.root}/{POINTER}")
        if version is None:
            return None
        at = f"{self.root}/snapshots/{version}"
        meta = json.loads(_read_text(self.spark, f"{at}/META"))
        read = lambda t: self.spark.read.parquet(f"{at}/{t}")
        return Snapshot(Graph(read("nodes"), read("edges"), read("subterms") if meta["subterms"] else None, {}, meta["meta"]), version, meta["built"], pending)


@dataclass
class Daemon:
    """Rebuilds touched entries batch by batch. ``build(entry)`` makes an entry's document; ``closures(entry, path)`` says which files it reads.

    A failed build leaves the old snapshot in place, remembers the sources' signature, and is not tried again until that
    changes; its files stay dirty and join the next batch.
    """

    store: Store
    build: Callable[[str], D.Document]
    closures: DataFrame
    failed: str | None = None
    dirty: dict[str, str] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    @property
    def entries(self) -> list[str]:
        return sorted(r.entry for r in self.closures.select("entry").distinct().collect())

    def warm_start(self) -> Snapshot | None:
        """Publish from the entries' stored documents, if all are there; what is missing is built by the first batch."""
        docs = [self.store.entry(e) for e in self.entries]
        if not docs or any(d is None for d in docs):
            return self.store.current()
        self.store.publish(D.build_index(union_documents(docs)))
        return self.store.current()

    def on_batch(self, batch: DataFrame, batch_id: int = 0) -> list[str]:
        """Rebuild what a batch of events touches and publish; returns the entries rebuilt."""
        began = time.time()
        # the files of one burst
        self.dirty |= {r.path: r.signature or "" for r in coalesced(source_events(batch)).collect()}
        if not self.dirty:
            return []
        signature = json.dumps(sorted(self.dirty.items()))
        if signature == self.failed:
            return []
        taken, self.dirty = self.dirty, {}
        spark = self.store.spark
        todo = touched_entries(spark.createDataFrame([(p,) for p in taken], "path string"), self.closures)
        missing = [e for e in self.entries if e not in todo and _read_text(spark, f"{self.store.entry_path(e)}/{POINTER}") is None]
        todo = sorted({*todo, *missing})
        error = None
        try:
            for e in todo:
                self.store.save_entry(e, self.build(e))
            if todo:
                self.store.publish(D.build_index(union_documents([self.store.entry(e) for e in self.entries])))
            self.failed = None
        except Exception as x:
            # the files stay dirty; events that came meanwhile win
            self.dirty, self.failed, error, todo = taken | self.dirty, signature, f"{type(x).__name__}: {x}", []
        self.log.append({"ts": began, "batch": batch_id, "entries": todo, "dur_ms": int(1000 * (time.time() - began)), "ok": error is None, "error": error})
        return todo

    def snapshot(self) -> Snapshot | None:
        """The last good snapshot, marked stale while dirty files wait."""
        return self.store.current(pending=bool(self.dirty))

    def start(self, events: DataFrame, checkpoint: str, debounce: str = "250 milliseconds"):
        """A streaming query over ``events``; everything that arrives within a trigger is one batch."""
        return events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()


def append_log(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Append query log records ``ts, tool, args, dur_ms, ok, stale`` as JSON lines."""
    ddl = "ts timestamp, tool string, args string, dur_ms long, ok boolean, stale boolean"
    from datetime import datetime, timezone

    at = lambda x: x if isinstance(x, datetime) else datetime.fromtimestamp(x, timezone.utc)
    data = [(at(r["ts"]), r["tool"], json.dumps(r.get("args", {}), sort_keys=True), int(r.get("dur_ms", 0)), bool(r.get("ok", True)), bool(r.get("stale", False))) for r in rows]
    spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    ddl = "ts timestamp, tool string, args string, dur_ms long, ok boolean, stale boolean"
    return (spark.readStream if streaming else spark.read).schema(ddl).json(path)


class Budget:
    """A wall-clock budget: stages run while time is left, and what is done by then is the result."""

    def __init__(self, seconds: float):
        self.ends, self.reached = time.monotonic() + seconds, []

    def run(self, stages: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, object]]:
        """The results of the stages begun in time, in order; ``reached`` names them."""
        out = []
        for name, stage in stages:
            if time.monotonic() >= self.ends:
                break
            out.append((name, stage()))
            self.reached.append(name)
        return out
