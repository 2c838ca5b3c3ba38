"""Progressive JPEG media columns.

The decoder accumulates spectral-selection and successive-approximation scans into one coefficient array a
component, inverse-transforms them in numpy, upsamples chroma and returns full-resolution RGB tensors. The
writer makes such files from coefficient arrays, with any scan script.

Payloads are kept losslessly in the format's own unit, the quantised coefficient: one byte a coefficient, in
a grey image whose blocks have no zero coefficients. Its scans (two DC, four AC) then need one Huffman code
of one bit each, so that a first-pass coefficient is one byte of the file and a refinement one bit; the
decoder reads such scans, by whomever written, as arrays, and all others code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: block of coefficients in zigzag order @ INVERSE = 64 samples in row order
INVERSE = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64)[ZIGZAG]


@dataclass
class Component:
    cid: int
    h: int
    v: int
    tq: int
    rows: int = 0  # blocks in the component itself
    cols: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole MCUs


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes]
    mcu_rows: int = 0
    mcu_cols: int = 0

    def lay_out(self) -> None:
        hm, vm = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcu_cols, self.mcu_rows = -(-self.width // (8 * hm)), -(-self.height // (8 * vm))
        for c in self.components:
            c.cols = -(-(-(-self.width * c.h // hm)) // 8)
            c.rows = -(-(-(-self.height * c.v // vm)) // 8)
            c.coef = np.zeros((self.mcu_rows * c.v, self.mcu_cols * c.h, 64), np.int32)


class Bits:
    """Bits of one restart interval, stuffing removed; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= n
        got = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return got

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            got = table.get((length, code))
            if got is not None:
                return got
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        x = self.take(size)
        return x if x >> (size - 1) else x - (1 << size) + 1


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of the entropy-coded segment at ``at``, and where it ends."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan has no end")
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        elif kind == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]], at


def _one_byte(table: dict) -> int | None:
    """The extra bits of a table's only code, where code and bits make one byte."""
    if len(table) == 1:
        (length, _), symbol = next(iter(table.items()))
        if length == 1 and symbol == 7:
            return 7
    return None


def _extend(x: np.ndarray, size: int) -> np.ndarray:
    x = x.astype(np.int32)
    return np.where(x >> (size - 1), x, x - (1 << size) + 1)


def _dc_first(frame, own, parts, tables, interval, al):
    if len(own) == 1 and interval == 1 and _one_byte(tables[0][0]) and all(len(p) == 1 for p in parts):
        c = own[0]
        diff = _extend(np.frombuffer(b"".join(parts), np.uint8), 7)
        c.coef[: c.rows, : c.cols, 0] = diff.reshape(c.rows, c.cols) << al
        return
    for run, bits, pred in _walk(frame, own, parts, interval):
        for i, c, r, k in run:
            pred[i] += bits.signed(bits.symbol(tables[i][0]))
            c.coef[r, k, 0] = pred[i] << al


def _dc_refine(frame, own, parts, tables, interval, al):
    if len(own) == 1 and not interval:
        c = own[0]
        bits = np.unpackbits(np.frombuffer(parts[0].replace(b"\xff\x00", b"\xff"), np.uint8), count=c.rows * c.cols)
        c.coef[: c.rows, : c.cols, 0] |= bits.reshape(c.rows, c.cols).astype(np.int32) << al
        return
    for run, bits, _ in _walk(frame, own, parts, interval):
        for _, c, r, k in run:
            c.coef[r, k, 0] |= bits.take(1) << al


def _walk(frame, own, parts, interval):
    """Per restart interval: its blocks as (component number, component, row, column), its bits, DC predictions."""
    if len(own) == 1:
        c = own[0]
        units = [[(0, c, r, k)] for r in range(c.rows) for k in range(c.cols)]
    else:
        units = [
            [(i, c, mr * c.v + y, mc * c.h + x) for i, c in enumerate(own) for y in range(c.v) for x in range(c.h)]
            for mr in range(frame.mcu_rows) for mc in range(frame.mcu_cols)
        ]
    step = interval or len(units)
    for n, at in enumerate(range(0, len(units), step)):
        yield [b for u in units[at : at + step] for b in u], Bits(parts[n]), [0] * len(own)


def _ac_first(frame, own, parts, tables, interval, ss, se, al):
    c, band = own[0], se - ss + 1
    size = _one_byte(tables[0][1])
    if size and not interval:
        raw = np.frombuffer(parts[0], np.uint8)
        if len(raw) == c.rows * c.cols * band:
            x = _extend(raw, size).reshape(c.rows, c.cols, band)
            c.coef[: c.rows, : c.cols, ss : se + 1] = np.where(x < 0, -(-x << al), x << al)
            return
    for run, bits, _ in _walk(frame, own, parts, interval):
        skip = 0
        for _, _, r, k in run:
            if skip:
                skip -= 1
                continue
            at = ss
            while at <= se:
                zeros, size = divmod(bits.symbol(tables[0][1]), 16)
                if size:
                    at += zeros
                    x = bits.signed(size)
                    c.coef[r, k, at] = x << al if x >= 0 else -(-x << al)
                    at += 1
                elif zeros == 15:
                    at += 16
                else:
                    skip = (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
                    break


def _ac_refine(frame, own, parts, tables, interval, ss, se, al):
    c = own[0]
    view = c.coef[: c.rows, : c.cols, ss : se + 1]
    if not interval and view.size and view.all():
        # no coefficient can become nonzero: runs of blocks at their end, with a bit a coefficient
        data = np.unpackbits(np.frombuffer(parts[0].replace(b"\xff\x00", b"\xff"), np.uint8))
        n, band, at, got = c.rows * c.cols, se - ss + 1, 0, []
        while n:
            code, length = 0, 0
            while (length, code) not in tables[0][1]:
                code, length, at = code << 1 | int(data[at]), length + 1, at + 1
            r = tables[0][1][length, code] >> 4
            run = (1 << r) + int("".join(map(str, data[at : at + r])) or "0", 2)
            at += r
            got.append(data[at : at + run * band])
            at += run * band
            n -= run
        bit = np.concatenate(got).reshape(view.shape).astype(np.int32) << al
        view += np.where(view > 0, bit, -bit)
        return
    one = 1 << al
    for run, bits, _ in _walk(frame, own, parts, interval):
        skip = 0

        def correct(block, at):
            if bits.take(1) and not abs(int(block[at])) & one:
                block[at] += one if block[at] > 0 else -one

        for _, _, r, k in run:
            block, at = c.coef[r, k], ss
            if not skip:
                while at <= se:
                    zeros, size = divmod(bits.symbol(tables[0][1]), 16)
                    new = 0
                    if size:
                        new = one if bits.take(1) else -one
                    elif zeros < 15:
                        skip = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                        break
                    while at <= se:
                        if block[at]:
                            correct(block, at)
                        elif zeros:
                            zeros -= 1
                        else:
                            if new:
                                block[at] = new
                            at += 1
                            break
                        at += 1
            if skip:
                for z in range(at, se + 1):
                    if block[z]:
                        correct(block, z)
                skip -= 1


def read_frame(data: bytes) -> Frame:
    """Parse a progressive JPEG and accumulate all its scans; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, comments, interval, frame = 2, {}, [], 0, None
    tables: dict[tuple[int, int], dict] = {}
    while True:
        if at + 1 >= len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        seg, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while seg:
                wide, n = divmod(seg[0], 16)
                quant[n] = np.frombuffer(seg, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                seg = seg[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while seg:
                n = sum(seg[1:17])
                tables[seg[0] >> 4, seg[0] & 15] = huffman(seg[1:17], seg[17 : 17 + n])
                seg = seg[17 + n :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", seg)
            frame = Frame(width, height, [Component(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(n)], quant, comments)
            frame.lay_out()
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman frames")
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", seg)
        elif kind == 0xFE:
            comments.append(seg)
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan before the frame")
            ids = {c.cid: c for c in frame.components}
            own = [ids[seg[1 + 2 * i]] for i in range(seg[0])]
            use = [(tables.get((0, seg[2 + 2 * i] >> 4), {}), tables.get((1, seg[2 + 2 * i] & 15), {})) for i in range(seg[0])]
            ss, se, approx = seg[1 + 2 * seg[0] :][:3]
            parts, at = _intervals(data, at)
            if ss == 0:
                (_dc_refine if approx >> 4 else _dc_first)(frame, own, parts, use, interval, approx & 15)
            else:
                (_ac_refine if approx >> 4 else _ac_first)(frame, own, parts, use, interval, ss, se, approx & 15)
    if frame is None:
        raise ValueError("no frame")
    return frame


def rgb(frame: Frame) -> np.ndarray:
    """The full-resolution ``(height, width, 3)`` uint8 tensor; grey images repeat their one channel."""
    planes, hm, vm = [], max(c.h for c in frame.components), max(c.v for c in frame.components)
    for c in frame.components:
        r, k, _ = c.coef.shape
        samples = (c.coef.reshape(-1, 64) * frame.quant[c.tq].astype(np.float64)) @ INVERSE
        plane = np.clip(np.rint(samples + 128), 0, 255).reshape(r, k, 8, 8).transpose(0, 2, 1, 3).reshape(8 * r, 8 * k)
        if (c.v, c.h) != (vm, hm):
            plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


class _Writer:
    """Collects codes as (symbol, extra bits) pairs, then writes them under eight-bit codes."""

    def __init__(self):
        self.out: list[tuple[int | None, int, int]] = []

    def put(self, symbol: int | None, value: int = 0, size: int = 0) -> None:
        self.out.append((symbol, value, size))

    def bits(self, codes: dict[int, tuple[int, int]]) -> bytes:
        acc = "".join((format(codes[s][0], f"0{codes[s][1]}b") if s is not None else "") + (format(v, f"0{n}b") if n else "") for s, v, n in self.out)
        acc += "1" * (-len(acc) % 8)
        return int(acc or "1" * 8, 2).to_bytes(max(len(acc) // 8, 1), "big").replace(b"\xff", b"\xff\x00")


def _magnitude(x: int) -> tuple[int, int]:
    size = abs(x).bit_length()
    return size, x if x >= 0 else x + (1 << size) - 1


def write_jpeg(width: int, height: int, sampling: list[tuple[int, int]], coefs: list[np.ndarray], quant: list[np.ndarray], script: list[tuple[list[int], int, int, int, int]]) -> bytes:
    """A progressive file. ``coefs``: zigzag arrays ``(rows, cols, 64)`` padded to whole MCUs; ``script``: (components, Ss, Se, Ah, Al) scans."""
    frame = Frame(width, height, [Component(i + 1, h, v, i) for i, (h, v) in enumerate(sampling)], {}, [])
    frame.lay_out()
    out = [b"\xff\xd8"]
    for i, q in enumerate(quant):
        out.append(_segment(0xDB, bytes([i]) + bytes(q.astype(np.uint8))))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, height, width, len(coefs)) + b"".join(bytes([c.cid, c.h << 4 | c.v, c.tq]) for c in frame.components)))
    for c, x in zip(frame.components, coefs):
        c.coef = x
    for which, ss, se, ah, al in script:
        own, w = [frame.components[i] for i in which], _Writer()
        for run, _, pred in _walk(frame, own, [b""], 0):
            if ss == 0:
                for i, c, r, k in run:
                    v = int(c.coef[r, k, 0]) >> al
                    if ah:
                        w.put(None, v & 1, 1)
                    else:
                        size, bits = _magnitude(v - pred[i])
                        w.put(size, bits, size)
                        pred[i] = v
                continue
            for _, c, r, k in run:
                block, zeros, held = [int(x) for x in c.coef[r, k, ss : se + 1]], 0, []
                level = [abs(x) >> al for x in block]
                last = max((i for i, x in enumerate(level) if (x == 1 if ah else x)), default=-1)
                for i, x in enumerate(level):
                    if i > last:
                        if ah and x > 1:
                            held.append(x & 1)
                        continue
                    if x == 0:
                        zeros += 1
                        if zeros == 16 and ah:
                            w.put(0xF0)
                            for bit in held:
                                w.put(None, bit, 1)
                            held, zeros = [], 0
                    elif ah and x > 1:
                        held.append(x & 1)
                    else:
                        while zeros > 15:
                            w.put(0xF0)
                            zeros -= 16
                        if ah:
                            w.put(zeros << 4 | 1, int(block[i] > 0), 1)
                            for bit in held:
                                w.put(None, bit, 1)
                            held = []
                        else:
                            size, bits = _magnitude(x if block[i] > 0 else -x)
                            w.put(zeros << 4 | size, bits, size)
                        zeros = 0
                if last < se - ss:
                    w.put(0)
                    for bit in held:
                        w.put(None, bit, 1)
        used = sorted({s for s, _, _ in w.out if s is not None}) or [0]
        codes = {s: (i, 8) for i, s in enumerate(used)}
        kind = 0x10 if ss else 0
        out.append(_segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(used)] + [0] * 8) + bytes(used)))
        out.append(_segment(0xDA, bytes([len(own)]) + b"".join(bytes([c.cid, 0]) for c in own) + bytes([ss, se, ah << 4 | al])) + w.bits(codes))
    return b"".join([*out, b"\xff\xd9"])


#: Spectral bands of a payload's AC scans.
BANDS = ((1, 5), (6, 63))
COLUMNS = 4096


def store_payload(payload: bytes) -> bytes:
    """A grey progressive JPEG whose coefficients hold ``payload`` (a positive multiple of 64 bytes)."""
    n = len(payload) // 64
    if not n or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    rows, cols = (1, n) if n <= COLUMNS else (-(-n // COLUMNS), COLUMNS)
    x = np.zeros((rows * cols, 64), np.uint8)
    x[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    n = rows * cols
    scan = lambda ss, se, approx: _segment(0xDA, bytes([1, 1, 0, ss, se, approx]))
    one = lambda kind: _segment(0xC4, bytes([kind, 1] + [0] * 15 + [7]))
    pack = lambda bits: np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")
    half = x >> 1
    dc = np.empty((n, 3), np.uint8)
    dc[:, 0], dc[:, 1], dc[:, 2] = half[:, 0], 0xFF, 0xD0 + np.arange(n) % 8
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0] + [1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, 8 * rows, 8 * cols, 1) + bytes([1, 0x11, 0])), one(0x00), one(0x10),
        _segment(0xDD, struct.pack(">H", 1)), scan(0, 0, 0x01), dc.tobytes()[:-2], _segment(0xDD, struct.pack(">H", 0)),
    ]
    out += [part for a, b in BANDS for part in (scan(a, b, 0x01), half[:, a : b + 1].tobytes())]
    out += [scan(0, 0, 0x10), pack(x[:, 0] & 1)]
    # codes of four bits: EOB0 to EOB14
    out.append(_segment(0xC4, bytes([0x10] + [0] * 3 + [15] + [0] * 12) + bytes(r << 4 for r in range(15))))
    low = np.where(x >= 128, x & 1, 1 - (x & 1)).astype(np.uint8)
    for a, b in BANDS:
        bits, at = [], 0
        while at < n:
            run = min(n - at, 32767)
            r = run.bit_length() - 1
            head = format(r, "04b") + (format(run - (1 << r), f"0{r}b") if r else "")
            bits += [np.frombuffer(head.encode(), np.uint8) - 48, low[at : at + run, a : b + 1].reshape(-1)]
            at += run
        out += [scan(a, b, 0x10), pack(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def read_payload(frame: Frame) -> bytes:
    """The payload in a frame of :func:`store_payload`."""
    size = next(int(c.split()[1]) for c in frame.comments if c.startswith(b"payload "))
    x = frame.components[0].coef.reshape(-1, 64)
    out = np.where(x > 0, x, x + 255).astype(np.uint8)
    dc = x[:, 0] >> 1
    out[:, 0] = (np.where(dc > 0, dc, dc + 127) << 1) | (x[:, 0] & 1)
    return out.tobytes()[:size]


def decode_images(media: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """``id, height, width, rgb, error`` of progressive files: RGB bytes by row. Null or undecodable media give nulls and the reason."""
    common.ship(media.sparkSession)
    src = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    schema = src.schema["id"].dataType.simpleString()
    ddl = f"id {schema}, height int, width int, rgb binary, error string"
    arrow = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for key, data in zip(b.column("id").to_pylist(), b.column("media").to_pylist()):
                try:
                    x, why = rgb(read_frame(data or b"")), None
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    x, why = None, str(e)
                yield common.emit({"id": [key], "height": [None if x is None else x.shape[0]], "width": [None if x is None else x.shape[1]], "rgb": [None if x is None else x.tobytes()], "error": [why]}, arrow)

    return src.mapInArrow(common.tidy(run), ddl)


def media_digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Store every whole text as a progressive JPEG, read it back, and describe what was read.

    Null and empty texts are 64 zero bytes. Repeated rows give repeated, equal results. ``feature`` has the
    tensor's shape and the mean and deviation of its luminance.
    """
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out = {k: [] for k in schema.names}
            for key, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                media = store_payload(body + b"\0" * (-len(body) % 64 or (0 if body else 64)))
                frame = read_frame(media)
                back = read_payload(frame)
                x = rgb(frame)
                grey = x[:, :, 0]
                n, s = grey.size, int(grey.sum(dtype=np.int64))
                sq = int((grey.astype(np.int64) ** 2).sum())
                feature = f"{x.shape[0]}x{x.shape[1]}x{x.shape[2]};mean={s / n:.4f};std={max(sq / n - (s / n) ** 2, 0) ** 0.5:.4f}"
                row = (key, len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for name, v in zip(schema.names, row):
                    out[name].append(v)
            yield common.emit(out, schema)

    return common.documents(docs, id_col, text_col).mapInArrow(common.tidy(run), ddl)
