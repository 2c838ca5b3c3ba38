"""Licence scan over a positional rare-token index of licence wordings.

Every wording ("template") is a word sequence with mandatory key phrases. The index lists, for each
template's highest-IDF words, where they stand in it; the IDFs come from all scanned documents. A file's
occurrences of such words vote for relative positions (file position minus template position); a template
is accepted at a position where its rare words agree and every key phrase is verified word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: phrase -> label; a phrase alone is enough, wherever its words stand consecutively.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, wording, mandatory key phrases)
WORDINGS = [
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it", ["free software", "redistribute it", "modify it"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted", "free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify", "for any purpose"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ["redistribution and use", "source and binary forms"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty", ["provided as is", "express or implied warranty"]),
]
RARE = 4
SLACK = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool = False


def templates() -> list[Template]:
    cut = lambda s: tuple(s.encode().split())
    base = [Template(label, cut(p), (cut(p),), True) for p, label in BASE.items()]
    return base + [Template(label, cut(t), tuple(map(cut, keys))) for label, t, keys in WORDINGS]


class RareIndex:
    """Postings of each template's ``RARE`` highest-IDF words (a base phrase: its highest); ties by word."""

    def __init__(self, own: list[Template], df: dict[bytes, int], n: int):
        self.own = own
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for t in own for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare = []
        for i, t in enumerate(own):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: 1 if t.base else RARE]
            self.rare.append(len(rare))
            for at, w in enumerate(t.words):
                if w in rare:
                    self.postings[w].append((i, at))
        self.words = frozenset(self.postings)

    def _holds(self, words: list[bytes], phrase: tuple[bytes, ...], at: int, slack: int) -> bool:
        return any(tuple(words[max(p, 0) : p + len(phrase)]) == phrase for p in range(at - slack, at + slack + 1))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """(starts of base phrases, base labels, all labels, best score)."""
        met = self.words.intersection(words)
        starts, base, labels, best = [], set(), set(), 0.0
        if not met:
            return starts, base, labels, best
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for p, w in enumerate(words):
            if w in met:
                for i, at in self.postings[w]:
                    votes[i][p - at].add(at)
        for i, offsets in votes.items():
            t = self.own[i]
            for o in offsets:
                if t.base:
                    if o >= 0 and tuple(words[o : o + len(t.words)]) == t.words:
                        starts.append(o)
                        base.add(t.label)
                        best = 1.0
                    continue
                near = set().union(*(offsets[x] for x in range(o - SLACK, o + SLACK + 1) if x in offsets))
                if len(near) < min(2, self.rare[i]):
                    continue
                if all(self._holds(words, k, o + self._place(t, k), SLACK) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, self._share(t, words, o))
        return starts, base, labels | base, best

    @staticmethod
    def _place(t: Template, key: tuple[bytes, ...]) -> int:
        return next((i for i in range(len(t.words)) if t.words[i : i + len(key)] == key), 0)

    def _share(self, t: Template, words: list[bytes], o: int) -> float:
        """IDF-weighted share of the template's words found near their places."""
        hit = sum(self.idf[w] for i, w in enumerate(t.words) if w in words[max(o + i - SLACK, 0) : max(o + i + SLACK + 1, 0)])
        return hit / sum(self.idf[w] for w in t.words)


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Document frequencies of a bounded vocabulary over all documents, and their number."""
    ddl = "word binary, df long"
    schema = common.arrow_schema(ddl)

    def run(batches):
        df: dict[bytes, int] = defaultdict(int)
        for b in batches:
            df[b""] += b.num_rows
            for body in b.column("body").to_pylist():
                for w in vocabulary.intersection(common.az_words(body)):
                    df[w] += 1
        yield common.emit({"word": list(df), "df": list(df.values())}, schema)

    rows = docs.select("body").mapInArrow(common.tidy(run), ddl).groupBy("word").agg(F.sum("df").alias("df")).collect()
    df = {bytes(r.word): r.df for r in rows}
    return df, df.pop(b"", 0)


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", own: list[Template] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words: counts 0, null places, empty labels, score 0. Repeated rows are
    scanned apart; an empty table gives an empty result. ``score`` is 1 where a base phrase stands, else the
    IDF-weighted share of the best accepted template's words.
    """
    own = own or templates()
    src = common.documents(docs, id_col, text_col)
    df, n = word_counts(src, frozenset(w for t in own for w in t.words))
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema = common.arrow_schema(ddl)

    def run(batches):
        index = RareIndex(own, df, n)
        for b in batches:
            out = {k: [] for k in schema.names}
            for k, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                words = common.az_words(body)
                starts, base, labels, score = index.scan(words)
                row = (k, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                for name, v in zip(schema.names, row):
                    out[name].append(v)
            yield common.emit(out, schema)

    return src.mapInArrow(common.tidy(run), ddl)
