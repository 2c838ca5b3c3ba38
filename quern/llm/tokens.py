"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

White space never becomes part of a token of these vocabularies, so a text's ids are those of its
white-space-delimited chunks, one after the other. A text of plain characters only is lower-cased and split into
the pieces the tokenizer itself splits it into, and each worker keeps the ids of pieces it has met; in other
texts that is done chunk by chunk, and what is not plain goes through the library.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: White space to the tokenizer's own normaliser, beyond what the fast path treats itself.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters whose normal form, case and class are plain: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_ODD = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[\t-\r ]")
#: Characters of a text that are taken at once, about.
LONG = 1 << 20
_PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids by text, of the newest ``size`` and the ``size`` before them; unknown ones are made on the way."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, text: str) -> bytes:
        got = self.old.get(text)
        if got is None:
            got = self.make(text)
        if len(text) < 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got


class IdEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``chunks``: so many pieces, and so many chunks of texts that are not plain, are remembered twice over at most.
    """

    def __init__(self, path: str, chunks: int = 200_000):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.pieces, self.chunks = _Known(self._piece, chunks), _Known(self._chunk, chunks)
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] and str(spec["pre_tokenizer"])
        self.chunked = spec["normalizer"] is not None and "\\s+" in str(spec["normalizer"]) and "'invert': True" in split
        self.fast = self.chunked and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in split

    def _slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) >= 400:
            return self._slow(piece)
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tok.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.fast and "<|" not in chunk and _PLAIN.fullmatch(chunk):
            return self._pieced(chunk)
        return self._slow(chunk)

    def _pieced(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if not self.chunked:
            return self._slow(text)
        if len(text) > LONG:  # cut at white space, so that a very long text's pieces are never held at once
            out, at = [], 0
            while at < len(text):
                cut = _BLANK.search(text, min(at + LONG, len(text)))
                end = cut.start() if cut else len(text)
                out.append(self._encode(text[at:end]))
                at = end
                while at < len(text) and at == end and text[at] in " \t\n\r\x0b\x0c":
                    at = end = at + 1
            return b"".join(out)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        if self.fast and _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return self._pieced(text)
        parts = _SPACE.split(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]
