"""The graph document: reading, refusing, writing, indexing and uniting."""

import json

import pytest

from quern.plans.union import union_documents
from quern.sources import document as D


def base(**more):
    d = {
        "v": 2, "mode": "expanded", "modules": ["A", "B"], "moduleFiles": {"A": "A.agda", "B": "B.agda"},
        "definitions": [{"id": 7, "name": "A.f", "module": "A", "kind": "function", "type": "x → y", "line": 3}, {"name": "A.g", "module": "A", "state": "H"}, {"name": "B.h", "module": "B", "access": "private", "unsafe": ["trustme"]}, {"name": "A.f", "module": "A", "state": "P"}],
        "definitionEdges": [["A.f", "B.h"], ["B.h", "X.y"], ["W.z", "A.f"], ["A.f", "B.h"]], "definitionEdgesProvenance": ["signature", "body", "with", "body"],
        "definitionSubtermHashes": [[18446744073709551615, 5], [], [5], []], "definitionSubtermDepths": [[2, 1], [], [4], []],
        "moduleOptionEscapes": {"B": ["--type-in-type", "trustme"]}, "reexports": [{"from": "B", "to": "A", "names": ["A.f"], "renames": {"f": "f2"}}], "entryModule": "B",
        "unsolvedModules": {"A": {"metas": [4], "constraints": []}}, "sourceFiles": ["ignored"],
    }
    d.update(more)
    return {k: v for k, v in d.items() if v is not ...}


def put(tmp_path, d, name="g.json"):
    p = tmp_path / name
    p.write_text(d if isinstance(d, str) else json.dumps(d, ensure_ascii=False, indent=1))
    return str(p)


def test_index(spark, tmp_path):
    g = D.build_index(D.read_document(spark, put(tmp_path, base())))
    n = {r.def_id: r for r in g.nodes.collect()}
    assert [n[i].name for i in range(6)] == ["A.f", "A.g", "B.h", "A.f", "X.y", "W.z"]
    assert (n[4].kind, n[4].module, n[4].is_real, n[5].module) == ("other", "X", False, "W") and n[0].sig == "x → y" and n[1].kind == "other" and n[1].state == "H"
    assert n[2].unsafe == ["--type-in-type", "trustme"] and n[0].unsafe == []
    # edges mean the last of a name defined twice, and keep the last tag
    assert {(r.src, r.dst): r.prov for r in g.edges.collect()} == {(3, 2): "body", (2, 4): "body", (5, 3): "with"}
    assert sorted((r.def_id, r.pos, int(r.hash), r.depth) for r in g.subterms.collect()) == [(0, 0, 2**64 - 1, 2), (0, 1, 5, 1), (2, 0, 5, 4)]
    assert D.lookup(g, "A.f").def_id == 3 and D.lookup(g, 4).name == "X.y" and D.lookup(g, "nope") is None and g.meta["entry_module"] == "B"


@pytest.mark.parametrize("change,message", [
    ({"v": 1}, "expected schema v: 2, got: 1"), ({"mode": ...}, "packed"), ({"modules": ...}, "'modules' is missing"), ({"definitionEdgesProvenance": ["body"]}, "length"),
    ({"definitionSubtermDepths": [[2], [], [4], []]}, "inner-array lengths"), ({"definitionEdgesProvenance": ["no"] * 4}, "unknown prov"), ({"definitions": [{"name": "x"}] * 4}, "lacks"),
    ({"definitionEdges": [["a"]] * 4}, "not a pair"),
])
def test_refusals(spark, tmp_path, change, message):
    with pytest.raises(D.DocumentError, match=message):
        D.read_document(spark, put(tmp_path, base(**change)))


@pytest.mark.parametrize("text,message", [("module A where", "starts with 'm'"), ("{ broken", "not an expanded document"), ("", "empty")])
def test_no_document(spark, tmp_path, text, message):
    with pytest.raises(D.DocumentError, match=message):
        D.read_document(spark, put(tmp_path, text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(D.DocumentError, match="does not exist"):
        D.read_document(spark, str(tmp_path / "none.json"))


def test_round_trip(spark, tmp_path):
    doc = D.read_document(spark, put(tmp_path, base()))
    D.write_document(doc, str(tmp_path / "out"))
    raw = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert raw["definitionSubtermHashes"][0][0] == 2**64 - 1 and "moduleEffectiveOptions" not in raw and "unsafe" not in raw["definitions"][0]
    back = D.read_document(spark, str(tmp_path / "out"))
    for part in ("definitions", "edges", "subterms", "modules", "files", "reexports", "options", "unsolved"):
        assert sorted(map(repr, getattr(back, part).collect())) == sorted(map(repr, getattr(doc, part).collect())), part
    assert back.meta == doc.meta
    assert D.identity(D.build_index(back)) == D.identity(D.build_index(doc))


def test_empty_graph(spark, tmp_path):
    doc = D.read_document(spark, put(tmp_path, base(definitions=[], definitionEdges=[], definitionEdgesProvenance=..., definitionSubtermHashes=..., definitionSubtermDepths=...)))
    g = D.build_index(doc, origin="lib")
    assert g.nodes.count() == 0 and g.edges.count() == 0 and g.subterms is None


def test_union(spark, tmp_path):
    a = D.read_document(spark, put(tmp_path, base(definitionEdgesProvenance=["signature", "unknown", "with", "body"])))
    other = base(
        definitions=[{"name": "A.g", "module": "Z", "type": "late"}, {"name": "C.new", "module": "C"}], definitionEdges=[["B.h", "X.y"], ["C.new", "A.g"]], definitionEdgesProvenance=["where", "body"],
        definitionSubtermHashes=[[9], [8, 7]], definitionSubtermDepths=[[1], [1, 1]], modules=["B", "C"], moduleFiles={"A": "other", "C": "C.agda"}, moduleOptionEscapes={"B": ["--cubical"]},
        unsolvedModules={"A": {"metas": [2, 4], "constraints": [1]}}, entryModule="C",
    )
    b = D.read_document(spark, put(tmp_path, other, "h.json"))
    assert union_documents([a]) is a
    u = union_documents([a, b])
    d = {r.name: r for r in u.definitions.collect()}
    assert [r.name for r in u.definitions.orderBy("ord").collect()] == ["A.f", "A.g", "B.h", "C.new"]
    assert (d["A.g"].module, d["A.g"].type, d["A.g"].state, d["A.f"].type) == ("A", "late", "H", "x → y")
    hashes = {n: sorted(int(x.hash) for x in u.subterms.where(f"ord = {d[n].ord}").collect()) for n in d}
    assert hashes == {"A.f": [5, 2**64 - 1], "A.g": [9], "B.h": [5], "C.new": [7, 8]}
    assert [(r.src, r.dst, r.prov) for r in u.edges.orderBy("ord").collect()] == [("A.f", "B.h", "signature"), ("B.h", "X.y", "where"), ("W.z", "A.f", "with"), ("C.new", "A.g", "body")]
    assert {r.module: r.path for r in u.files.collect()} == {"A": "A.agda", "B": "B.agda", "C": "C.agda"}
    assert [r.module for r in u.modules.where("role = 'own'").orderBy("ord").collect()] == ["A", "B", "C"]
    assert {r.module: r.flags for r in u.options.collect()} == {"B": ["--cubical", "--type-in-type", "trustme"]}
    assert u.unsolved.first().metas == [2, 4] and u.meta["entry_module"] == "B"
    D.write_document(u, str(tmp_path / "u"))
    assert D.build_index(D.read_document(spark, str(tmp_path / "u"))).nodes.count() == 6


def test_pieces(spark, tmp_path, monkeypatch):
    """Lists longer than a piece are written as several objects and read back in their order."""
    many = {f"M{i}": f"M{i}.agda" for i in range(5)}
    doc = D.read_document(spark, put(tmp_path, base(modules=["A", "B", "C"], moduleFiles={"A": "A.agda", "B": "B.agda"} | many)))
    monkeypatch.setattr(D, "PIECE", 2)
    D.write_document(doc, str(tmp_path / "pieces"))
    raw = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "pieces")).collect()]
    assert len(raw) > 1 and sorted(x["part"] for x in raw) == list(range(len(raw))) and all(len(v) <= 2 for x in raw for v in x.values() if isinstance(v, list))
    back = D.read_document(spark, str(tmp_path / "pieces"))
    for part in ("definitions", "edges", "subterms", "modules", "files", "reexports", "options", "unsolved"):
        assert sorted(map(repr, getattr(back, part).collect())) == sorted(map(repr, getattr(doc, part).collect())), part
    assert back.meta == doc.meta
    lost = sorted((tmp_path / "pieces").glob("part-*"), key=lambda p: p.stat().st_size)[-1]
    lost.write_text("")
    with pytest.raises(D.DocumentError):
        D.read_document(spark, str(tmp_path / "pieces"))
