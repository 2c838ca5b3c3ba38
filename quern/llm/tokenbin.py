"""Token-id output: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A *segment* holds the ids of whole documents: a header (document ids, lengths, the id frequencies used as
order-0 prior) and blocks of ``BLOCK`` ids. Every block starts from the same state, carries a CRC-32 of its
ids and is decoded alone or, as here, side by side with the segment's other blocks (one lane each).

Model of one id, given the block's two preceding ids:

* order 2 and order 1 each predict the id that last followed the context, with a confidence 0..7 that rises
  on a hit and falls to 0 on a miss;
* the mixing weight of each of the two is kept per block and confidence, as a 16-bit share that every coded id
  moves towards 1 or 0 by a 32nd, so it learns how far that order's predictions hold in these very ids;
* order 0 shares the remaining mass among all ids: adaptive class frequencies of the block times the
  frequencies within the class, from the segment's prior;
* the weighted three are stacked into one interval of a 30-bit total, coded by a carry-less 64-bit range coder.

Integers only, so any machine decodes what any other encoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"QTB2"
BLOCK = 1024
CLASSES_LOG, WITHIN_LOG, H1, H2 = 12, 12, 10, 11
U = np.uint64
TOP, BOTTOM = U(1 << 48), U(1 << 32)
TOTAL_LOG = U(30)
TOTAL = 1 << 30
#: First weights, of 65536, of an order-2 and of an order-1 prediction by confidence, and the bounds of weights.
WEIGHT2 = np.array([131, 22938, 39322, 49152, 55706, 58982, 61604, 62915], np.int32)
WEIGHT1 = np.array([131, 7864, 19661, 29491, 39322, 45875, 51118, 55706], np.int32)
LEAST_WEIGHT, MOST_WEIGHT, RATE = 48, 64500, 5
RENEW = 64
#: Stands for a null document id in a segment.
NULL_ID = -(1 << 63)


class Order0:
    """Classes of ids of like frequency, from the ids and counts of a segment."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts.astype(np.int64)))
        ids, counts = ids[order], counts[order].astype(np.int64)
        share = np.cumsum(counts) - counts
        by_mass = share * 24 // max(int(counts.sum()), 1)
        cls = np.zeros(len(ids), np.int64)
        at = 0
        starts = []
        while at < len(ids):
            end = int(np.searchsorted(by_mass, by_mass[at], "right"))
            end = min(max(end, at + 1), at + 2048)
            cls[at:end] = len(starts)
            starts.append(at)
            at = end
        self.k = k = max(len(starts), 1)
        bounds = [*starts, len(ids)]
        top = int(ids.max()) + 1 if len(ids) else 1
        self.cls = np.zeros(top, np.int64)
        self.wcum = np.zeros(top, np.uint64)
        self.wfreq = np.zeros(top, np.uint64)
        self.lut = np.zeros((k, 1 << WITHIN_LOG), np.int64)
        prior = np.ones(k, np.int64)
        for c in range(len(starts)):
            a, b = bounds[c], bounds[c + 1]
            n, w = b - a, counts[a:b]
            cum = np.concatenate(([0], np.cumsum(w)))
            cum = cum * ((1 << WITHIN_LOG) - n) // max(int(cum[-1]), 1) + np.arange(n + 1)
            own = ids[a:b]
            self.cls[own], self.wcum[own], self.wfreq[own] = c, cum[:-1].astype(np.uint64), np.diff(cum).astype(np.uint64)
            self.lut[c] = np.repeat(own, np.diff(cum))
            prior[c] = max(int(w.sum()), 1)
        self.flat_lut = self.lut.reshape(-1)
        self.start = np.maximum(prior * (64 * k) // prior.sum(), 4)


class Lanes:
    """The model's state for some blocks, and the interval of the next id of each."""

    def __init__(self, n: int, zero: Order0):
        self.zero, self.k = zero, zero.k
        self.t1 = np.zeros(n << H1, np.uint32)
        self.t2 = np.zeros(n << H2, np.uint32)
        self.base1 = np.arange(n, dtype=np.int64) << H1
        self.base2 = np.arange(n, dtype=np.int64) << H2
        self.w1, self.w2 = np.tile(WEIGHT1, n), np.tile(WEIGHT2, n)
        self.eight = np.arange(n, dtype=np.int64) << 3
        self.a = np.zeros(n, np.int64)
        self.b = np.zeros(n, np.int64)
        self.counts = np.tile(zero.start, (n, 1))
        self.flat = self.counts.reshape(-1)
        self.rows = np.arange(n, dtype=np.int64) * self.k
        self.step = 0

    def narrow(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        for name in ("base1", "base2", "eight", "a", "b", "rows"):
            setattr(self, name, getattr(self, name)[:n])
        self.counts = self.counts[:n]
        self.cum = np.ascontiguousarray(self.cum[:, :n])
        self.flat_cum, self.lane = self.cum.reshape(-1).astype(np.uint64), np.arange(n)

    def predict(self) -> None:
        if self.step % RENEW == 0:
            c = np.cumsum(self.counts.T, axis=0)
            body = c * ((1 << CLASSES_LOG) - self.k) // c[-1] + np.arange(1, self.k + 1)[:, None]
            # by class, then lane: class frequencies are summed down the lanes
            self.cum = np.concatenate((np.zeros((1, c.shape[1]), np.int64), body)).astype(np.uint16)
            self.flat_cum, self.lane = self.cum.reshape(-1).astype(np.uint64), np.arange(c.shape[1])
        self.i1 = self.base1 + ((self.b * 2654435761 >> 7) & ((1 << H1) - 1))
        self.i2 = self.base2 + (((self.a * 40503 + self.b) * 2654435761 >> 9) & ((1 << H2) - 1))
        self.e1, self.e2 = self.t1[self.i1], self.t2[self.i2]
        self.p1, self.p2 = (self.e1 >> 3).astype(np.int64), (self.e2 >> 3).astype(np.int64)
        self.at1, self.at2 = self.eight + (self.e1 & 7), self.eight + (self.e2 & 7)
        self.v1, self.v2 = self.w1[self.at1], self.w2[self.at2]
        self.m2 = self.v2.astype(np.uint64) << U(14)
        # order 0 keeps 2**24 at least, so that no id's interval is empty
        self.m1 = np.minimum(((U(TOTAL) - self.m2) >> U(16)) * self.v1.astype(np.uint64), U(TOTAL - (1 << 24)) - self.m2)
        self.low0 = self.m2 + self.m1
        self.rest = U(TOTAL) - self.low0

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.zero
        n = len(ids)
        at = z.cls[ids] * n + self.lane
        c0 = self.flat_cum[at]
        freq = self.flat_cum[at + n] - c0
        lo0 = (c0 << U(WITHIN_LOG)) + freq * z.wcum[ids]
        lo = self.low0 + (self.rest * lo0 >> U(24))
        hi = self.low0 + (self.rest * (lo0 + freq * z.wfreq[ids]) >> U(24))
        return self._guessed(ids, lo, hi)

    def _guessed(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with those of right guesses in place, the order-2 guess first."""
        hit = np.flatnonzero(ids == self.p1)
        lo[hit], hi[hit] = self.m2[hit], self.low0[hit]
        hit = np.flatnonzero(ids == self.p2)
        lo[hit], hi[hit] = 0, self.m2[hit]
        return lo, hi

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold ``v``, and the intervals."""
        z, n = self.zero, len(v)
        low0 = self.low0
        x = np.maximum(v, low0) - low0
        u = (((x + U(1)) << U(24)) - U(1)) // self.rest
        np.minimum(u, U((1 << 24) - 1), out=u)
        cls = (self.cum[1:] <= (u >> U(WITHIN_LOG)).astype(np.uint16)).sum(axis=0, dtype=np.uint8).astype(np.int64)
        at = cls * n + self.lane
        c0 = self.flat_cum[at]
        freq = self.flat_cum[at + n] - c0
        c0 <<= U(WITHIN_LOG)
        within = ((u - c0).astype(np.float64) / freq.astype(np.float64)).astype(np.int64)  # both below 2**24: exact
        ids = z.flat_lut[(cls << WITHIN_LOG) + within]
        c0 += freq * z.wcum[ids]
        lo = low0 + (self.rest * c0 >> U(24))
        hi = low0 + (self.rest * (c0 + freq * z.wfreq[ids]) >> U(24))
        known = np.flatnonzero(v < low0)
        two = v[known] < self.m2[known]
        ids[known] = np.where(two, self.p2[known], self.p1[known])
        lo[known] = np.where(two, U(0), self.m2[known])
        hi[known] = np.where(two, self.m2[known], low0[known])
        return ids, lo, hi

    def update(self, ids: np.ndarray) -> None:
        new = (ids << 3).astype(np.uint32)
        for table, at, entry, guess, weights, place, was in (
            (self.t1, self.i1, self.e1, self.p1, self.w1, self.at1, self.v1), (self.t2, self.i2, self.e2, self.p2, self.w2, self.at2, self.v2),
        ):
            hit = guess == ids
            table[at] = np.where(hit, np.minimum(entry & 7, 6) + 1 + new, new)
            weights[place] = was + ((np.where(hit, MOST_WEIGHT, LEAST_WEIGHT) - was) >> RATE)
        self.flat[self.rows + self.zero.cls[ids]] += 24
        self.a, self.b = self.b, ids
        self.step += 1


def _shift(low: np.ndarray, rng: np.ndarray, out) -> None:
    """Carry-less normalisation: 16 settled bits leave at a time; ``out(lanes, words)`` takes them."""
    far = (low ^ (low + rng)) >= TOP
    go = np.flatnonzero(~far | (rng < BOTTOM))
    while len(go):  # few lanes go twice
        lo = low[go]
        r = np.where(far[go], (U(0) - lo) & (BOTTOM - U(1)), rng[go])
        out(go, lo >> U(48))
        lo, r = lo << U(16), r << U(16)
        low[go], rng[go] = lo, r
        again = (lo ^ (lo + r)) >= TOP
        far[go] = again
        go = go[~again | (r < BOTTOM)]


def _columns(n: int) -> list[tuple[int, int]]:
    """(steps until, lanes): all blocks but the last have BLOCK ids."""
    blocks = -(-n // BLOCK)
    last = n - (blocks - 1) * BLOCK
    return [(last, blocks)] + ([(BLOCK, blocks - 1)] if blocks > 1 and last < BLOCK else [])


def encode_ids(ids: np.ndarray, zero: Order0) -> list[bytes]:
    """The coded blocks of ``ids``."""
    if not len(ids):
        return []
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    m = Lanes(blocks, zero)
    low, rng = np.zeros(blocks, np.uint64), np.full(blocks, U(2**64 - 1))
    lanes, words = [], []

    def out(go, w):
        lanes.append(go.astype(np.uint32))
        words.append(w.astype(np.uint16))

    step = 0
    for until, n in _columns(len(ids)):
        if step:
            m.narrow(n)
        l, r = low[:n], rng[:n]
        while step < until:
            now = grid[step, :n]
            m.predict()
            lo, hi = m.interval(now)
            unit = r >> TOTAL_LOG
            l += unit * lo
            np.multiply(unit, hi - lo, out=r)
            _shift(l, r, out)
            m.update(now)
            step += 1
    for shift in (48, 32, 16, 0):
        out(np.arange(blocks), low >> U(shift) & U(0xFFFF))
    lane, word = np.concatenate(lanes), np.concatenate(words)
    order = np.argsort(lane, kind="stable")
    data = word[order].astype("<u2").tobytes()
    ends = np.cumsum(np.bincount(lane, minlength=blocks)) * 2
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def decode_ids(n: int, coded: list[bytes], zero: Order0) -> np.ndarray:
    """The ``n`` ids of some blocks; inverse of :func:`encode_ids`."""
    if not n:
        return np.zeros(0, np.int64)
    blocks = len(coded)
    sizes = np.array([len(c) // 2 for c in coded], np.int64)
    data = np.frombuffer(b"".join(coded) + b"\0" * 16, "<u2").astype(np.uint64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    code = (data[at] << U(48)) | (data[at + 1] << U(32)) | (data[at + 2] << U(16)) | data[at + 3]
    at = at + 4
    grid = np.zeros((BLOCK, blocks), np.int64)
    m = Lanes(blocks, zero)
    low, rng = np.zeros(blocks, np.uint64), np.full(blocks, U(2**64 - 1))

    def feed(go, _):
        p = at[go]
        code[go] = (code[go] << U(16)) | np.where(p < ends[go], data[np.minimum(p, len(data) - 1)], U(0))
        at[go] = p + 1

    step = 0
    for until, n_lanes in _columns(n):
        if step:
            m.narrow(n_lanes)
        l, r = low[:n_lanes], rng[:n_lanes]
        while step < until:
            m.predict()
            unit = r >> TOTAL_LOG
            v = np.minimum((code[:n_lanes] - l) // unit, U(TOTAL - 1))
            ids, lo, hi = m.find(v)
            l += unit * lo
            np.multiply(unit, hi - lo, out=r)
            _shift(l, r, feed)
            m.update(ids)
            grid[step, :n_lanes] = ids
            step += 1
    return grid.T.reshape(-1)[:n]


def write_segment(doc_ids: list[int], lengths: list[int], raw: bytes) -> bytes:
    """One segment: the ids of whole documents, ``raw`` being all of them as little-endian uint32."""
    ids = np.frombuffer(raw, "<u4")
    if len(ids) and ids.max() >= 1 << 28:
        raise ValueError("token ids must be below 2**28")
    seen, counts = np.unique(ids, return_counts=True)
    counts = np.minimum(counts, 0xFFFF)
    coded = encode_ids(ids.astype(np.int64), Order0(seen.astype(np.int64), counts))
    sums = [zlib.crc32(raw[4 * i * BLOCK : 4 * (i + 1) * BLOCK]) for i in range(len(coded))]
    head = b"".join((
        np.array([NULL_ID if k is None else k for k in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), np.diff(seen, prepend=0).astype("<u4").tobytes(),
        counts.astype("<u2").tobytes(), np.array([len(c) for c in coded], "<u4").tobytes(), np.array(sums, "<u4").tobytes(),
    ))
    head = zlib.compress(head, 1)
    fixed = struct.pack("<4sIIQII", MAGIC, BLOCK, len(doc_ids), len(ids), len(seen), len(head))
    return fixed + head + struct.pack("<I", zlib.crc32(fixed + head)) + b"".join(coded)


def read_segment(data: bytes) -> tuple[list[int], list[int], bytes]:
    """Inverse of :func:`write_segment`; raises ValueError where any checksum fails."""
    magic, block, n_docs, n, n_seen, size = struct.unpack_from("<4sIIQII", data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token segment of this version")
    at = struct.calcsize("<4sIIQII")
    if zlib.crc32(data[: at + size]) != struct.unpack_from("<I", data, at + size)[0]:
        raise ValueError("segment header: checksum mismatch")
    head, body, blocks, pos = zlib.decompress(data[at : at + size]), at + size + 4, -(-n // BLOCK), 0
    parts = []
    for kind, count in (("<i8", n_docs), ("<u4", n_docs), ("<u4", n_seen), ("<u2", n_seen), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(head, kind, count, pos))
        pos += parts[-1].nbytes
    doc_ids, lengths, deltas, counts, sizes, sums = parts
    seen = np.cumsum(deltas.astype(np.int64))
    ends = np.cumsum(sizes.astype(np.int64)) + body
    coded = [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
    raw = decode_ids(n, coded, Order0(seen, counts)).astype("<u4").tobytes()
    for i, want in enumerate(sums.tolist()):
        if zlib.crc32(raw[4 * i * BLOCK : 4 * (i + 1) * BLOCK]) != want:
            raise ValueError(f"block {i}: checksum mismatch")
    return [None if k == NULL_ID else k for k in doc_ids.tolist()], lengths.tolist(), raw


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = None, text_col: str = "text", id_col: str = "doc_id", segment_ids: int = 2_000_000) -> DataFrame:
    """Encode whole texts and write them in ascending document order as segments.

    Returns the stored table ``(part, seq, n_docs, n_ids, inside, data)``: ``data`` is a segment, ``part`` the
    range of document ids it is in, ``seq`` its place there, ``inside`` the number of ids before it there. Spark's writer commits the files, so lost tasks are
    redone whole. Null and empty texts have ``end_id`` only, or no ids. A document is never split between
    segments; one holds about ``segment_ids`` ids. Repeated document ids stay apart, in any order; null
    ids come first.
    """
    spark = docs.sparkSession
    src = common.documents(docs, id_col, text_col)
    # a third of a batch of texts, its ids and the coder's lanes fit a worker many times over
    src = src.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    ddl = "part int, seq int, n_docs int, n_ids long, inside long, data binary"
    schema = common.arrow_schema(ddl)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, raws, held, inside = [], [], [], 0, 0

        def flush():
            return common.emit({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [held], "inside": [inside], "data": [write_segment(ids, lengths, b"".join(raws))]}, schema)

        for b in batches:
            for k, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                raw = enc.encode(body.decode("utf-8", "replace")) + end
                ids.append(k)
                lengths.append(len(raw) // 4)
                raws.append(raw)
                held += len(raw) // 4
                if held >= segment_ids:
                    yield flush()
                    ids, lengths, raws, held, inside, seq = [], [], [], 0, inside + held, seq + 1
        if ids:
            yield flush()

    return common.materialise(src.mapInArrow(common.tidy(run), ddl), "tokens", "uncompressed")


def read_tokens(stored: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of a stored table: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``), all read from its segments."""
    from pyspark.sql import Window

    # one row a range of documents: as many rows as write_tokens had shuffle partitions, at most
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data").to_pylist()):
                ids, lengths, raw = read_segment(data)
                out = {k: [] for k in schema.names}
                at = 0
                for k, n in zip(ids, lengths):
                    own = raw[4 * at : 4 * (at + n)]
                    out["doc_id"].append(k)
                    out["start"].append(start + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(own))
                    if with_ids:
                        out["ids"].append(np.frombuffer(own, "<u4").astype(np.int64).tolist())
                    at += n
                yield common.emit(out, schema)

    located = stored.select("part", "inside", "data").join(F.broadcast(parts), "part")
    return located.select((F.col("before") + F.col("inside")).alias("start"), "data").mapInArrow(common.tidy(run), ddl)
