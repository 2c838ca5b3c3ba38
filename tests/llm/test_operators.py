"""The training-data operators against brute force, exact round trips and edge cases."""

import gc
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern import session
from quern.llm import common, decontaminate, licenses, neardup, packing, passages, progressive, quality, queries, shingle, tokenbin, tokens, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLES = "doc_id long, text string, key int, rep string, body int, word string, root int, h double"


def az(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "r", 2, "w", 3, 0.5) for i, t in rows], TABLES)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, ""), (4, "short item")], "item_id long, text string")


ODD = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "a null id"), (4, "a b c d e f g " * 3000), (5, "Ünï ©ode 　 \x00 <|endoftext|> ’s 12"), (6, " \n\t")]


def run_all(spark, d, labels, bench):
    tok = queries.word_tokenizer()
    return {
        "op1": licenses.scan_licenses(d), "op2": progressive.media_digests(d), "op3": quality.score_quality(d, labels), "op4": toxicity.score_toxicity(d, labels),
        "op6": decontaminate.benchmark_hits(d, bench), "op7": passages.repeated_passages(d), "op8": neardup.near_duplicates(d), "op9": packing.pack_documents(d, tok),
        "op10": tokenbin.read_tokens(tokenbin.write_tokens(d, tok, end_id=2)),
        "toxic": toxicity.drop_toxic(d, labels), "near": neardup.drop_near_duplicates(d), "cut": passages.cut_passages(d), "clean": decontaminate.drop_contaminated(d, bench),
    }


def test_odd_rows(spark, labels, bench):
    got = {k: f.collect() for k, f in run_all(spark, docs(spark, ODD), labels, bench).items()}
    for k in ("op1", "op2", "op3", "op4", "op6", "op8", "op10", "cut", "clean"):
        assert sorted(str(r.doc_id) for r in got[k]) == sorted(str(i) for i, _ in ODD), k
    by = {r.doc_id: r for r in got["op1"]}
    assert (by[1].n_words, by[1].first_word, by[1].base_labels, by[1].score) == (0, None, "", 0.0) and by[4].n_words == 21000
    assert {r.n_bytes for r in got["op2"] if r.doc_id in (1, 2)} == {0} and {r.payload_bytes for r in got["op2"] if r.doc_id in (1, 2)} == {64}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got["op3"])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got["op4"])
    assert all(r.kept for r in got["op8"] if r.doc_id in (1, 2, 6)) and {r.n_shingles for r in got["op8"] if r.doc_id == 3} == {1}
    assert {r.n_tokens for r in got["op10"] if r.doc_id in (1, 2, 6)} == {1}
    starts = sorted((r.start, r.n_tokens) for r in got["op10"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert sum(r.length for r in got["op9"]) == starts[-1][0] + starts[-1][1]
    assert got["cut"][0].asDict().keys() == set(re.findall(r"(\w+) \w+", TABLES))


def test_empty_tables(spark, labels, bench):
    for k, f in run_all(spark, docs(spark, []), labels.limit(0), bench.limit(0)).items():
        assert f.collect() == [], k
    assert [r.doc_id for r in toxicity.score_toxicity(docs(spark, [(1, "x")]), labels.limit(0)).collect()] == [1]
    assert [r.n_hit for r in decontaminate.benchmark_hits(docs(spark, [(1, "x")]), bench.limit(0)).collect()] == [0]


def test_op1_base_phrases(spark, sf):
    own = texts(spark, sf)
    got = {r.doc_id: r for r in queries.QUERIES["op1_license_scan"](spark, sf).collect()}
    assert got.keys() == own.keys()
    for k, t in own.items():
        w, found = az(t), []
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(found), ",".join(sorted({x for _, x in found})))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_op1_wordings():
    index = licenses.RareIndex(licenses.templates(), {}, 10)
    text = b"x y Licensed under the Apache License, Version 2.0 (the License)"
    starts, base, all_labels, score = index.scan(common.az_words(text))
    assert (starts, base, score) == ([5], {"apache"}, 1.0) and "apache-2.0" in all_labels
    assert index.scan(common.az_words(b"permission was granted to leave"))[2] == set()


def test_op2_round_trip(spark, sf):
    own = texts(spark, sf)
    for r in queries.QUERIES["op2_progressive_media"](spark, sf).collect():
        raw = (own[r.doc_id] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_op2_decodes_general_progressive_scans(sampling):
    rng, (h, w) = np.random.default_rng(5), (21, 35)
    hm, vm = sampling[0]
    cols, rows = -(-w // (8 * hm)), -(-h // (8 * vm))
    coefs = [np.where(rng.random((rows * v, cols * k, 64)) < 0.3, rng.integers(-40, 41, (rows * v, cols * k, 64)), 0).astype(np.int32) for k, v in sampling]
    n = len(sampling)
    script = [(list(range(n)), 0, 0, 0, 1)]
    for i in range(n):
        script += [([i], 1, 5, 0, 2), ([i], 6, 63, 0, 2), ([i], 1, 63, 2, 1), ([i], 1, 63, 1, 0)]
    script.append((list(range(n)), 0, 0, 1, 0))
    data = progressive.write_jpeg(w, h, sampling, coefs, [np.full(64, 2)] * n, script)
    frame = progressive.read_frame(data)
    for c, x in zip(frame.components, coefs):
        assert (c.coef[: c.rows, : c.cols] == x[: c.rows, : c.cols]).all()
    assert progressive.rgb(frame).shape == (h, w, 3)
    with pytest.raises(ValueError):
        progressive.read_frame(b"no image")


def test_op3_sum_of_squares_identity():
    fm, rng = quality.FactorisationMachine(30), np.random.default_rng(1)
    idx, val = np.sort(rng.choice(30, 9, replace=False)), rng.random(9).astype(np.float32)
    raw, _ = fm.raw(idx, val, np.array([0]))
    pairs = sum(float(fm.v[a] @ fm.v[b]) * x * y for i, (a, x) in enumerate(zip(idx, val)) for b, y in list(zip(idx, val))[i + 1 :])
    assert raw[0] == pytest.approx(fm.w0 + float(fm.w[idx] @ val) + pairs, abs=1e-5)


@pytest.mark.parametrize("name,label,folds,fold,least", [("op3_quality_fm", "quality", 3, 1, 0.93), ("op4_toxicity_neighbours", "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, name, label, folds, fold, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % folds == fold) for k, r in got.items())
    rows = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] is not None and r.doc_id in got and got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r[label] for r in rows) >= least * len(rows)


def test_op4_nearest_are_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        v = {int(t): float(rng.random() + 0.1) for t in rng.choice(50, 6, replace=False)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 50)
    for q in vectors[:40]:
        sims = [(round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)]
        want = sorted(((s, i) for s, i in sims if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        assert [i for _, i in index.nearest(q, 10)] == [i for _, i in want]


def test_op4_uses_all_words(spark):
    # no word depends on the label by much, and the telling one is in two examples
    rows = [(i, f"common filler number{i} text") for i in range(40)] + [(100, "quibblewort alpha"), (101, "quibblewort beta"), (200, "quibblewort gamma")]
    own = spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 1), (101, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, rows), own, folds=1, fold=1).collect()}
    w = {k: az(t) for k, t in rows}
    idf = {x: math.log((1 + len(rows)) / (1 + sum(x in v for v in w.values()))) + 1 for v in w.values() for x in v}
    seen = {x for k, v in w.items() if k != 200 for x in v}
    for k, v in w.items():
        length = lambda u: math.sqrt(sum(idf[x] ** 2 for x in u if x in seen))
        sims = [(round(sum(idf[x] ** 2 for x in v if x in w[e]) / length(v) / length(w[e]), 9), -e) for e in w if e != 200]
        want = sorted((s for s in sims if s[0] > 0), reverse=True)[:3]
        assert [round(c, 9) for c in got[k].nearest_cosines] == [s for s, _ in want], k
    assert set(got[200].nearest_ids) == {100, 101} and got[200].score > got[0].score


def test_op4_finds_a_label_that_one_word_of_many_marks(spark):
    rng = np.random.default_rng(8)
    text = lambda marked: " ".join([f"w{x}" for x in rng.integers(0, 3000, 80)] + ["zorgle"] * marked)
    rows = [(i, text(i % 8 == 0)) for i in range(640)]
    own = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(480)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs(spark, rows), own, folds=1, fold=1).collect()}
    assert {i for i in range(480, 640) if got[i]} == {i for i in range(480, 640) if i % 8 == 0}


def test_each_pipeline_stage_begins_with_shrunk_heaps(spark, monkeypatch):
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())

    shrink, called = common.shrink_executors, []
    monkeypatch.setattr(common, "shrink_executors", lambda s: called.append(s))
    for _, stage in corpus_pipeline.STAGES:
        before = len(called)
        stage(spark, docs(spark, ODD), "/root/testdata/sf0.001")
        assert len(called) > before
    before = collections()
    shrink(spark)
    assert collections() >= before + spark.sparkContext.defaultParallelism


def test_toxicity_leaves_no_model_in_the_driver(spark, labels, monkeypatch):
    left, real = [], common.give_back

    def seen():
        left.append(sum(isinstance(x, toxicity.ToxicityModel) for x in gc.get_objects()))
        real()

    monkeypatch.setattr(common, "give_back", seen)
    toxicity.drop_toxic(docs(spark, ODD), labels)
    toxicity.score_toxicity(docs(spark, ODD), labels)
    assert left == [0, 0]


def test_op5_records(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert sorted((r.key, r.type) for r in made) == sorted((k, t) for k in pages for t in ("conversion", "metadata"))
    for r in made:
        f, block = warc.parse_record(bytes(r.record))
        source, _ = warc.parse_record(warc.response(r.key, pages[r.key].url, pages[r.key].html))
        assert f["warc-refers-to"] == r.refers_to == source["warc-record-id"] and f["warc-block-digest"] == warc.sha1(block)
        if r.type == "metadata":
            assert b"http-header: Content-Type: text/html" in block and source["warc-payload-digest"].encode() in block
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "key long, record binary")
    assert all(r.error and r.record is None for r in warc.derivatives(odd).collect())
    null_page = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert warc.derivative_digests(null_page).count() == 2
    assert warc.plain_text("<p>a &amp; b</p><script>x</script><p>c</p>") == "a & b\nc"


def test_op5_text_and_links_against_a_parser(spark, sf):
    from html.parser import HTMLParser

    class Page(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.links, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            if tag == "a" and not self.hidden:
                self.links += [" ".join((v or "").split()) for k, v in attrs if k == "href"]

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.hidden:
                self.words.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r.key, r.type): warc.parse_record(bytes(r.record))[1].decode() for r in warc.derivatives(warc.responses(pages)).collect()}
    digests = {(r.page_id, r.type): r.n_outlinks for r in warc.derivative_digests(pages).collect()}
    letters = lambda t: re.sub(r"\s+", "", t)
    alike = 0
    for r in pages.collect():
        p = Page()
        p.feed(r.html or "")
        p.close()
        alike += letters("".join(p.words)) == letters(got[r.page_id, "conversion"])
        links = [x[9:] for x in got[r.page_id, "metadata"].split("\r\n") if x.startswith("outlink: ")]
        assert links == p.links and digests[r.page_id, "metadata"] == len(links)
    assert alike >= 0.98 * pages.count()


def test_op5_codings_and_odd_pages(spark):
    import gzip

    page = "<html lang=en><title>T</title><a href='x'>é</a><p>two</p></html>".encode()
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(page[i : i + 9]), page[i : i + 9]) for i in range(0, len(page), 9)) + b"0\r\n\r\n"
    html = ["Content-Type: text/html; charset=utf-8"]
    for headers, body in ((["Transfer-Encoding: chunked"], chunked), (["Content-Encoding: gzip"], gzip.compress(page)), (["Content-Encoding: deflate"], zlib.compress(page)), (["Content-Encoding: deflate"], zlib.compress(page)[2:-4]), ([], page)):
        assert warc.payload_text(headers + html, body) == page.decode()
    for headers, body in ((["Content-Encoding: br"], page), (["Content-Encoding: gzip"], page), (["Transfer-Encoding: chunked"], b"zz"), (["Content-Type: image/png"], b"x")):
        with pytest.raises(ValueError):
            warc.payload_text(headers, body)
    long = "<script>" * 20_000 + "<p>shown</p>" + "<!-- " * 20_000
    rows = [(1, "u", long), (2, None, ""), (3, "u", None), (3, "u", None), (None, "u", "<b>x</b>")]
    pages = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, record string, key int")
    got = warc.derivative_digests(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(k) for k, _, _ in rows for _ in range(2))
    assert len({r.record_id for r in got if r.page_id == 3}) == 2
    assert warc.derivative_digests(pages.limit(0)).collect() == []


def test_op8_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(31)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    a, b = new(80), new(80)
    rows = [(1, a), (1, b), (5, a + " more"), (7, b + " more"), (9, new(80)), (9, ""), (1, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert {k for k, v in got.items() if v == 1} == {(1, 77), (1, 0), (5, 78), (7, 78)} and got[9, 77] == got[9, 0] == 9
    assert [r.doc_id for r in neardup.drop_near_duplicates(docs(spark, rows)).collect()].count(1) == 3


def test_op6_one_occurrence_drops_a_long_document(spark):
    words = [f"w{i}" for i in range(5000)]
    item = " ".join(f"b{i}" for i in range(18))
    rows = [(1, " ".join(words[:2500]) + " " + item + " " + " ".join(words[2500:])), (2, " ".join(words)), (3, None), (None, "")]
    items = spark.createDataFrame([(1, item, 5)], "item_id long, text string, tkey int")
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs(spark, rows), items).collect()) == ["2", "3", "None"]
    assert not next(r for r in decontaminate.benchmark_hits(docs(spark, rows), items).collect() if r.doc_id == 1).contaminated


def test_op9_plan_joined_instead_of_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))], "doc_id long, piece int, length long")
    items = common.materialise(items, "items")
    want = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(items, 128).collect()}
    monkeypatch.setattr(packing, "RUNS", 0)
    assert {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(items, 128).collect()} == want


def test_op6_against_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(queries.ORACLES["op6_benchmark_decontamination"])
    names = [x[0] for x in want.description]
    got = queries.QUERIES["op6_benchmark_decontamination"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op6_short_items_and_overlaps(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (10, "ALPHA, beta!"), (2, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    rows = [(1, "x alpha beta alpha beta y"), (2, " ".join(f"w{i}" for i in range(5, 20)) + " tail" * 400), (3, "alpha gamma beta")]
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs(spark, rows), items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (4, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert (got[2].n_hit, got[2].contaminated) == (15, False) and got[3].n_hit == 0


def test_op7_finds_repeated_passages(spark):
    sf = "/root/testdata/sf0.01"
    own = {k: az(t) for k, t in texts(spark, sf).items()}
    places, need, have = defaultdict(list), defaultdict(set), defaultdict(set)
    for k in sorted(own):
        for i in range(len(own[k]) - 49):
            places[tuple(own[k][i : i + 50])].append((k, i))
    for found in places.values():
        for k, i in found:
            if k != found[0][0]:
                need[k].update(range(i, i + 50))
    for r in queries.QUERIES["op7_compact_window_passages"](spark, sf).collect():
        assert r.match_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        # words can be inserted or deleted, so the match is of another length: some length has the similarity given
        cut = lambda w, at, n: {tuple(w[i : i + 5]) for i in range(at, at + n - 4)}
        a, w = cut(own[r.doc_id], r.start, r.n_words), own[r.match_doc_id]
        jaccard = lambda n: (lambda b: len(a & b) / len(a | b))(cut(w, r.match_start, n))
        lengths = sorted(range(40, min(2 * r.n_words, len(w) - r.match_start) + 1), key=lambda n: abs(n - r.n_words))
        assert any(jaccard(n) == pytest.approx(r.similarity) for n in lengths), r
        have[r.doc_id].update(range(r.start, r.start + r.n_words))
    assert need and sum(len(need[k] & have[k]) for k in need) >= 0.99 * sum(map(len, need.values()))


def test_op7_cuts_only_the_repeated_passage(spark):
    rng = np.random.default_rng(11)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    shared, a, b, c = new(60), new(80), new(70), new(90)
    rows = [(1, f"{a} {shared}"), (2, f"{b}. {shared}! {c}"), (3, c[:200])]
    got = {r.doc_id: r.text for r in passages.cut_passages(docs(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and az(got[2]) == az(f"{b} {c}")


def test_op7_inserted_and_deleted_words(spark):
    rng = np.random.default_rng(21)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, want = [], {}
    for k in range(24):
        p = new(80 if k % 3 < 2 else 160)
        q = p[:40] + new(1) + p[40:] if k % 3 == 0 else p[:40] + p[41:] if k % 3 == 1 else p[:40] + new(1) + p[40:80] + p[81:120] + new(1) + p[120:]
        rows += [(k, " ".join(new(30) + p + new(30))), (100 + k, " ".join(new(20) + q + new(40)))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (p, q))
        assert len(a & b) >= 0.8 * len(a | b)
        want[100 + k] = (k, 20, len(q), 30, pytest.approx(len(a & b) / len(a | b)))
    got = {r.doc_id: (r.match_doc_id, r.start, r.n_words, r.match_start, r.similarity) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == want


def test_op7_all_places_of_the_first_document(spark):
    rng = np.random.default_rng(22)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, want = [], {}
    for k in range(12):
        p = new(50)
        # every five-gram of the passage leads a window of its own far before it
        before = [w for at in range(0, 46) for w in new(50) + p[at : at + 5] + new(50)]
        rows += [(k, " ".join(before + p)), (100 + k, " ".join(new(30) + p + new(30)))]
        want[100 + k] = (k, 30, 50, len(before), 1.0)
    got = {r.doc_id: (r.match_doc_id, r.start, r.n_words, r.match_start, r.similarity) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == want


def test_op7_members_unlike_the_first_document(spark):
    rng = np.random.default_rng(23)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, want = [], set()
    for k in range(8):
        p = new(50)
        # an earlier document in which every five-gram of the passage leads a window of its own
        rows += [(k, " ".join(w for at in range(0, 46) for w in new(50) + p[at : at + 5] + new(50)))]
        rows += [(100 + k, " ".join(new(30) + p + new(30))), (200 + k, " ".join(new(10) + p + new(60)))]
        want.add((200 + k, 10, 50, 100 + k, 30, 1.0))
    got = {tuple(r) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == want


def test_op7_common_lines_are_not_compared(spark):
    rng = np.random.default_rng(29)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line, p = new(15), new(50)
    # all share a line, which leads a window of each; two share a passage too
    rows = [(k, " ".join(new(60) + line + new(60))) for k in range(40)]
    rows += [(100 + k, " ".join(new(60) + line + p + new(60))) for k in range(2)]
    src = common.documents(docs(spark, rows))
    wins = common.materialise(passages._windows(src, 46, 1), "compact")
    often = wins.groupBy("key").agg(F.countDistinct("doc_id").alias("n")).where("n > 30").select("key")
    assert often.count()
    left = wins.join(often, "key").selectExpr("key", "doc_id", "place", "true AS is_lead")
    for group in (4096, 5):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(passages, "GROUP", group)
            assert {r.doc_id for r in passages._comparable(src, left, 16).collect()} <= {100, 101}
    got = {tuple(r) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(101, 60, 65, 100, 60, 1.0)}


def test_op7_pairs_that_can_give_no_passage_are_not_made(spark, monkeypatch):
    rng = np.random.default_rng(31)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line, p = new(40), new(100)
    # twenty share a line, of 36 of the 46 tokens that a passage has at least; two share a passage
    rows = [(k, " ".join(new(60) + line + new(60))) for k in range(20)]
    rows += [(100 + k, " ".join(p + new(50))) for k in range(2)]
    stored, counts = common.materialise, defaultdict(list)

    def materialise(df, name, *options):
        made = stored(df, name, *options)
        counts[name].append(made.count())
        return made

    monkeypatch.setattr(common, "materialise", materialise)
    got = {tuple(r) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(101, 0, 100, 100, 0, 1.0)}
    assert counts["unlinked"][0] and counts["aligned"][1:] == [0]


def test_op7_best_stretch_allows_every_passage():
    rng = np.random.default_rng(32)
    met = 0
    for k in range(300):
        rep = rng.integers(0, 120 if rng.random() < 0.3 else 2**40, int(rng.integers(46, 160))).astype(np.uint64)
        own = rep[int(rng.integers(0, 40)) :].copy()
        own[rng.random(len(own)) < rng.choice((0.02, 0.08, 0.15, 0.3))] += np.uint64(7)
        own = np.concatenate((rng.integers(0, 2**40, int(rng.integers(0, 30))).astype(np.uint64), own[: len(own) // 2], own[len(own) // 2 + int(rng.integers(0, 3)) :]))
        for percent in (80, 95):
            open_ = rng.random(len(own)) < 0.03
            side = lambda x, y, **o: passages.best_stretch(np.isin(x, y)[None], passages.unlike_costs(x, percent)[None], 46, percent, **o)[0]  # noqa: E731, B023
            for x, y, _, _ in (found := passages.alike(own, rep, 46, percent)):
                assert not open_[x:y].any() or side(own, rep, open_=open_[None]) + side(rep, own) >= 0
            assert not found or side(own, rep) + side(rep, own) >= 0
            met += len(found)
            # against all stretches
            value = np.where(np.isin(own, rep), 100 - percent, passages.unlike_costs(own, percent))
            match = np.isin(own, rep)
            every = [int(value[x:y].sum()) for x in range(len(own)) for y in range(x + 46, len(own) + 1) if match[x] and match[y - 1] and open_[x:y].any()] if k < 10 else None
            none = -(1 << 40)
            assert every is None or max(every, default=none) == max(side(own, rep, open_=open_[None]), none)
    assert met > 100


def test_op7_shared_tokens_against_all_pairs():
    rng = np.random.default_rng(30)
    rows = [(int(rng.integers(0, 12)), bool(rng.integers(0, 2)), np.unique(rng.integers(0, 60, 12).astype(np.uint32))) for _ in range(40)]
    for (i, lead, t), (kept, n, m) in zip(rows, passages.shared_tokens(rows)):
        as_lead = {x for j, _, u in rows if lead and j < i for x in u.tolist()} & set(t.tolist())
        as_member = {x for j, other, u in rows if other and j > i for x in u.tolist()} & set(t.tolist())
        assert (set(kept.tolist()), n, m) == (as_lead | as_member, len(as_lead), len(as_member))


def test_salted_join_deals_only_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session.fits, "__defaults__", (0,))
    monkeypatch.setattr(session, "KEY_ROWS", 100)
    big = spark.range(1000).selectExpr("if(id < 700, 0, id) AS key", "id AS doc_id")
    small = common.materialise(big.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("key % 2 = 0"), "small")
    got = common.salted_join(big, small, "key", ("doc_id",), rows="n")
    assert got.columns == ["key", "doc_id", "least"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, 0 if k == 0 else i) for k, i in map(tuple, big.collect()) if k % 2 == 0)
    assert common.salted_join(big, small, "key", ("doc_id",), "left_semi", rows="n").count() == got.count()


@pytest.mark.parametrize("repeated", [False, True])
def test_op7_windows_hold_every_run(repeated):
    rng = np.random.default_rng(4)
    tok = rng.integers(0, 3 if repeated else 2**60, 400).astype(np.uint64)
    text, c, start, end = passages.compact_windows(tok, np.array([0, 150, 400]), 46, 0)
    held = [set() for _ in range(2)]
    for t, m, a, z in zip(text, c, start, end):
        assert a <= m < z and z - a >= 46
        held[t].update(range(a, z - 45))
    assert held == [set(range(105)), set(range(205))]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def components(sets):
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    return {k: top(k) for k in keys}


def test_op8_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    sets = {k: shingles(t, 4) for k, t in texts(spark, sf).items()}
    want = components(sets)
    for r in queries.QUERIES["op8_minmax_near_duplicates"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op8_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(260):
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(own)))
    want = components({k: shingles(t, 4) for k, t in rows})
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()} == want


def test_op8_exact_rest_of_a_bucket(spark):
    rng = np.random.default_rng(6)
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = [(k, " ".join(new(60))) for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in (7, 77, 149)]
    src = common.documents(docs(spark, rows))
    left = src.selectExpr("1L AS key", "doc_id", "doc_id AS root")
    got = {tuple(sorted(r)) for r in neardup._exact_links(src, left, 4, 80).collect()}
    assert got == {(7, 1007), (77, 1077), (149, 1149)}


def test_op8_min_and_max_agree_as_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)))
    same = np.mean(neardup.band_keys(np.unique(a)) == neardup.band_keys(np.unique(b)))
    assert abs(same - (900 / 1100) ** neardup.ROWS) < 0.25


def test_op9_packs_everything(spark, sf):
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(queries.word_tokenizer()), texts(spark, sf)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op9_best_fit_packing"](spark, sf).collect():
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == own.keys()
    for k, t in own.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for i, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            part = ids[4096 * i : 4096 * (i + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, 4096 * i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert sum(r.length for r in by[k]) == len(ids)
    for placed in seqs.values():
        placed.sort()
        ends = np.cumsum([n for _, n in placed]).tolist()
        assert ends[-1] <= 4096 and [o for o, _ in placed] == [0, *ends[:-1]]
    total = sum(n for p in seqs.values() for _, n in p)
    assert len(seqs) <= math.ceil(total / 4096) * 1.05 + 1


def test_op10_round_trip(spark, sf):
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(queries.word_tokenizer()), texts(spark, sf)
    stored = tokenbin.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), queries.word_tokenizer(), end_id=2, segment_ids=20_000)
    got, at = {r.doc_id: r for r in tokenbin.read_tokens(stored, with_ids=True).collect()}, 0
    for k in sorted(own):
        ids = [*tok.encode(own[k] or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].ids) == (at, ids)
        at += len(ids)


def test_op10_blocks_are_checksummed():
    ids = np.random.default_rng(1).integers(0, 3000, 5000).astype("<u4")
    data = tokenbin.write_segment([1, 2], [3000, 2000], ids.tobytes())
    assert tokenbin.read_segment(data) == ([1, 2], [3000, 2000], ids.tobytes())
    bad = bytearray(data)
    bad[-40] ^= 1
    with pytest.raises(ValueError):
        tokenbin.read_segment(bytes(bad))


def test_op10_ids_that_repeat_and_surprise():
    rng = np.random.default_rng(8)
    ids = np.tile(rng.integers(0, 40000, 7), 6000).astype("<u4")
    ids[rng.choice(len(ids), 900, replace=False)] = rng.integers(0, 49000, 900)
    for own in (ids, np.full(9000, 3, "<u4"), np.arange(5000, dtype="<u4")):
        data = tokenbin.write_segment([1], [len(own)], own.tobytes())
        assert tokenbin.read_segment(data)[2] == own.tobytes()
    assert len(tokenbin.write_segment([1], [len(ids)], ids.tobytes())) < len(ids)


def test_tokens_match_the_library_on_documents(spark):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(queries.word_tokenizer()), tokens.encoder(queries.word_tokenizer())
    rng = np.random.default_rng(12)
    odd = ["".join(chr(c) for c in rng.choice([*range(9, 14), *range(28, 33), *range(33, 1200), 0x2019, 0x3000, 0x4E2D, 0x1F600], 300)) for _ in range(150)]
    own = [t or "" for t in texts(spark, "/root/testdata/sf0.1").values()]
    for t, e in zip([*own, *odd], tok.encode_batch_fast([*own, *odd], add_special_tokens=False)):
        assert enc.encode(t) == np.array(e.ids, "<u4").tobytes(), t[:200]


def test_tokens_match_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(queries.word_tokenizer()), tokens.IdEncoder(queries.word_tokenizer(), chunks=3)
    for t in ("Don't STOP, it's 12.5!", "ÀÉ ß ñ ﬁ \x1c x 　 y", "<|endoftext|> a<|startoftext|>b", "", "😀😀 日本語 text", "a" * 900):
        assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_pipeline_keeps_clean_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        ids = {r.doc_id for r in d.select("doc_id").collect()}
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) >= 0.6 * len(ids), name
        d = common.materialise(out, name)
    left = {r.doc_id for r in d.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left


def test_pipeline_near_duplicates_stage(spark, sf):
    own = texts(spark, sf)
    want = components({k: shingles(t, 5) for k, t in own.items()})
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r.doc_id for r in out.collect()} == {k for k, v in want.items() if k == v}
