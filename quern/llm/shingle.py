"""Hashes of words and word shingles for batches of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

from . import common

_rng = np.random.default_rng(20240229)
U = np.uint64
#: A random odd number for every byte, the base of the polynomial over a word, and its inverse modulo 2**64.
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def word_places(body: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of one text's words in bytes."""
    word = ~_BLANK[np.frombuffer(body.translate(table), np.uint8)]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(bodies: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, splits by text): words are what ``table`` leaves between blanks."""
    joined = b"\n".join(bodies).translate(table) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    word = ~_BLANK[raw]
    edge = np.diff(word.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([0] + [len(b) + 1 for b in bodies])
    return h, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, splits: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of ``width``-word shingles in place order, splits by text).

    A text of fewer words, but not none, has one shingle, of all its words, if ``short``.
    """
    n = np.diff(splits)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(splits), np.int64)
    total = np.zeros(len(words), np.uint64)
    for i in range(min(width, len(words))):
        total[: len(words) - i] += words[i:] * _STEP[i]
    count = np.maximum(n - width + 1, 0)
    few = (n > 0) & (n < width) if short else np.zeros(len(n), bool)
    out_n = np.where(few, 1, count)
    out_splits = np.concatenate(([0], np.cumsum(out_n)))
    first = np.repeat(splits[:-1] - out_splits[:-1], out_n)
    place = np.arange(out_splits[-1]) + first
    out = mix(total[place])
    for d in np.flatnonzero(few):
        own = words[splits[d] : splits[d + 1]]
        out[out_splits[d]] = mix(np.array([(own * _STEP[: len(own)]).sum(dtype=np.uint64) + U(len(own))], np.uint64))[0]
    return out, out_splits


def chunks(bodies: list[bytes], size: int = 1 << 20):
    """(from, to) places of runs of texts of about ``size`` bytes; a longer text is alone."""
    start = held = 0
    for i, b in enumerate(bodies):
        if held and held + len(b) > size:
            yield start, i
            start, held = i, 0
        held += len(b) + 1
    if start < len(bodies):
        yield start, len(bodies)


def shingle_sets(bodies: list[bytes], width: int, table: bytes = common.LOWER_TABLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in chunks(bodies):
        h, splits = shingle_hashes(*word_hashes(bodies[a:b], table), width)
        out += [np.unique(h[x:y]) for x, y in zip(splits[:-1], splits[1:])]
    return out
