"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum(w_i x_i) + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)); the bracket is the
sum-of-squares identity, so a document costs its number of features times the rank.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD_BITS, RANK, BINS = 13, 6, 8
STATS = (
    "bytes", "words", "word_length", "upper", "digits", "blank", "lines", "line_length", "repeated_lines", "non_ascii",
    "distinct", "stops", "commas", "shouts", "pipes", "hashes", "dollars", "percents", "ands", "stars", "braces",
)
N_WORDS = 1 << WORD_BITS
N_FEATURES = N_WORDS + len(STATS) * (BINS + 1)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def describe(body: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their weights, structure statistics) of one whole text."""
    words = common.az_words(body)
    n, size = len(words), len(body)
    hashed = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, n) & (N_WORDS - 1), minlength=1)
    at = np.flatnonzero(hashed)
    weight = np.log1p(hashed[at]).astype(np.float32)
    weight /= np.sqrt((weight**2).sum()) or 1
    lines = [x for x in body.split(b"\n") if x]
    w, b = max(n, 1), max(size, 1)
    share = lambda chars: (size - len(body.translate(None, chars))) / b
    stats = [
        np.log1p(size), np.log1p(n), size / w, share(_UPPER), share(_DIGIT), share(b" \t"), np.log1p(len(lines)), np.log1p(size / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), share(_HIGH), len(set(words)) / w,
        *(body.count(c) / w for c in (b".", b",", b"!", b"|", b"#", b"$", b"%", b"&", b"*", b"{")),
    ]
    return at, weight, stats


class FactorisationMachine:
    """Fitted by AdaGrad on logistic loss; rows are (indices, values) pairs."""

    def __init__(self, n: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.02, (n, rank)).astype(np.float32)

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows laid end to end (every row has features), and the per-row sums of v x."""
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, starts)
        s2 = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - s2).sum(axis=1), s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, batch: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        gw, gv, g0 = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                idx = np.concatenate([rows[i][0] for i in own])
                val = np.concatenate([rows[i][1] for i in own])
                sizes = np.array([len(rows[i][0]) for i in own])
                starts = np.cumsum(sizes) - sizes
                raw, s = self.raw(idx, val, starts)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) / len(own)
                e = np.repeat(err, sizes).astype(np.float32) * val
                dw = np.bincount(idx, e, minlength=len(self.w)).astype(np.float32)
                near = np.flatnonzero(dw)
                dv = np.zeros_like(self.v)
                part = e[:, None] * (np.repeat(s, sizes, axis=0) - self.v[idx] * val[:, None])
                np.add.at(dv, idx, part.astype(np.float32))
                dw[near] += decay * self.w[near]
                dv[near] += decay * self.v[near]
                gw[near] += dw[near] ** 2
                gv[near] += dv[near] ** 2
                self.w[near] -= rate * dw[near] / np.sqrt(gw[near])
                self.v[near] -= rate * 0.3 * dv[near] / np.sqrt(gv[near])
                g0 += float(err.sum()) ** 2
                self.w0 -= rate * float(err.sum()) / g0**0.5
        return self


class QualityModel:
    def __init__(self, cuts: np.ndarray, mean: np.ndarray, std: np.ndarray, fm: FactorisationMachine):
        self.cuts, self.mean, self.std, self.fm = cuts, mean, std, fm

    def row(self, at: np.ndarray, weight: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(stats, np.float32)
        bins = (x[:, None] > self.cuts).sum(axis=1)
        base = N_WORDS + np.arange(len(x)) * (BINS + 1)
        z = np.clip((x - self.mean) / self.std, -4, 4) * 0.25
        idx = np.concatenate((at, base, base + 1 + bins))
        return idx, np.concatenate((weight, z, np.full(len(x), 0.3, np.float32))).astype(np.float32)

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        rows = [self.row(*describe(x)) for x in bodies]
        sizes = np.array([len(r[0]) for r in rows])
        raw, _ = self.fm.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def fit_quality(found: list[tuple[np.ndarray, np.ndarray, list[float], int]]) -> QualityModel:
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.float32), [0.0] * len(STATS), 1)]
    stats = np.array([x[2] for x in found], np.float32)
    cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model = QualityModel(cuts, stats.mean(axis=0), stats.std(axis=0) + 1e-6, FactorisationMachine(N_FEATURES))
    model.fm.fit([model.row(*x[:3]) for x in found], np.array([x[3] for x in found], np.float64))
    return model


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold


def labelled_sample(labels: DataFrame, label: str, folds: int, fold: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, smallest hash of the id first; a repeated id's labels are averaged."""
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    one = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(label).alias("y"))
    one = one.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, train_rows: int = 6000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document's whole text.

    The machine is fitted on at most ``train_rows`` labelled documents outside the held-out fold; only their
    hashed features reach the driver. Null and empty texts get the score of their (empty) features; a null id
    counts as not held out; without labelled rows every score is near 1, the prior. Repeated rows score alike.
    """
    src = common.documents(docs, id_col, text_col)
    sample = labelled_sample(labels, label, folds, fold, train_rows)
    ddl = "at binary, weight binary, stats array<double>, y int"
    schema = common.arrow_schema(ddl)

    def features(batches):
        for b in batches:
            got = [describe(x) for x in b.column("body").to_pylist()]
            yield common.emit({"at": [g[0].astype("<i4").tobytes() for g in got], "weight": [g[1].tobytes() for g in got], "stats": [[float(x) for x in g[2]] for g in got], "y": b.column("y").to_pylist()}, schema)

    # the sample has at most train_rows rows
    rows = src.join(F.broadcast(sample), "doc_id").select("body", "y").mapInArrow(common.tidy(features), ddl).collect()
    found = sorted((bytes(r.at), bytes(r.weight), list(r.stats), r.y) for r in rows)
    model = fit_quality([(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(w, np.float32), s, y) for a, w, s, y in found])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl_out = "doc_id long, held_out boolean, score double, predicted int"
    out_schema = common.arrow_schema(ddl_out)

    def score(batches):
        m = shared.value
        for b in batches:
            for own in common.take_batches(range(b.num_rows), 256):
                part = b.slice(own[0], len(own))
                s = m.scores(part.column("body").to_pylist())
                yield common.emit({"doc_id": part.column("doc_id").to_pylist(), "held_out": part.column("held_out").to_pylist(), "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}, out_schema)

    return src.select("doc_id", F.coalesce(held_out("doc_id", folds, fold), F.lit(False)).alias("held_out"), "body").mapInArrow(common.tidy(score), ddl_out)
