"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The vocabulary is all words of the training examples, as 64-bit hashes; their IDFs come from all documents, and words
that the examples with and without the label differ in weigh more, by :func:`telling`.
Examples and documents are TF-IDF vectors over it. A block's bound is the sum of the query weights times the
largest weight each term has in it; blocks are opened by falling bound, in rounds, and those whose bound is
under the k-th best similarity never. Votes are weighted by similarity and calibrated, by isotonic
regression, on leave-one-out votes of the examples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingle
from .quality import held_out, labelled_sample

BLOCK = 128
#: Blocks opened in the first round; each further round opens twice as many.
ROUND = 4
#: Terms, those of most examples, that are held as a matrix, and queries that are multiplied by it at once.
COMMON, QUERIES = 192, 64
#: Deviations from the label's rate that are left to chance: of half a million words a few tens go beyond.
CHANCE = 4.0


def arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        return np.array(list(vector), np.int64), np.array(list(vector.values()), np.float64)
    return vector


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class BlockMaxIndex:
    """Vectors in blocks of ``BLOCK`` examples: postings by term, a cell for each block that has the term, with its largest weight.

    The lists of the few terms that most examples have are kept as rows of a matrix: a batch of queries is multiplied
    by it, which gives every example its share of these terms at once. The other terms' lists are searched block by
    block, bounded by that share's largest value in the block and the terms' largest weights there.

    An example's weight of a term is its own times ``term_scale`` of the term times ``row_scale`` of the example, so
    postings only keep the number of the own weight among the different ones. Examples are laid out by their
    heaviest terms, so that like ones share blocks and bounds are tight.
    """

    def __init__(self, vectors: list, n_terms: int, term_scale: np.ndarray | None = None, row_scale: np.ndarray | None = None, common: int = COMMON):
        """``vectors``: dictionaries from term to own weight, or (terms, weights) arrays, which take less memory."""
        self.n, self.n_blocks = len(vectors), -(-len(vectors) // BLOCK)
        vectors = [arrays(v) for v in vectors]
        self.term_scale = np.ones(n_terms) if term_scale is None else term_scale
        rows_by = np.ones(self.n) if row_scale is None else row_scale

        def heaviest(v):
            w = v[1] * self.term_scale[v[0]]
            return v[0][np.lexsort((v[0], -w))[:4]].tolist()

        order = sorted(range(self.n), key=lambda i: (heaviest(vectors[i]), i))
        self.example = np.array(order, np.int64)
        self.row_scale = rows_by[self.example] if self.n else rows_by
        # numbers of weights and 32-bit places from the start: the driver builds this
        self.values = np.unique(np.concatenate([np.zeros(0), *(np.unique(w) for _, w in vectors)]))
        number = np.min_scalar_type(max(len(self.values) - 1, 0))
        code = np.concatenate([np.zeros(0, number), *(np.searchsorted(self.values, vectors[i][1]).astype(number) for i in order)])
        terms = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0].astype(np.int32) for i in order)])
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(vectors[i][0]) for i in order])
        del vectors
        by = np.argsort(terms, kind="stable")
        terms, rows, code = terms[by], rows[by], code[by]
        del by
        held = np.bincount(terms, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:common]
        self.slot = np.full(n_terms, -1, np.int16)
        often = often[held[often] * 16 >= self.n]
        self.slot[often] = np.arange(len(often))
        heavy = self.slot[terms] >= 0
        self.dense_rows, self.dense_code, self.dense_slot = _small(rows[heavy]), _small(code[heavy]), self.slot[terms[heavy]]
        self.n_common = len(often)
        terms, rows, code = terms[~heavy], rows[~heavy], code[~heavy]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (rows[1:] // BLOCK != rows[:-1] // BLOCK)
        first = np.flatnonzero(new)
        self.cell = np.append(first, len(terms)).astype(np.int32 if len(terms) < 2**31 else np.int64)
        self.cell_block = _small(rows[first] // BLOCK)
        best = np.maximum.reduceat(self.values[code] * self.row_scale[rows], first) if len(first) else np.zeros(0)
        self.cell_best = np.nextafter(best.astype(np.float32), np.float32(np.inf))  # rounded up: a bound
        self.rows, self.code = _small(rows), _small(code)
        self.splits = np.searchsorted(terms[first], np.arange(n_terms + 1))
        self.start = self.cell[self.splits].astype(np.int64)
        self.queries = self.opened = 0
        self.spared = 1.0
        self._matrix = self._weights = self._post = None

    def __getstate__(self):
        return self.__dict__ | {"_matrix": None, "_weights": None, "_post": None}

    def common_part(self, queries: list) -> np.ndarray:
        """What the common terms add to the product of each query (rows) with each example, in the order of blocks."""
        if self._matrix is None:  # made where it is used: the broadcast is smaller without
            self._weights = self.values[self.code] * self.row_scale[self.rows]
            self._post = self.rows.astype(np.int64)
            self._matrix = np.zeros((self.n_common, self.n))
            self._matrix[self.dense_slot, self.dense_rows] = self.values[self.dense_code] * self.row_scale[self.dense_rows]
        q = np.zeros((len(queries), self.n_common))
        for i, (terms, own) in enumerate(queries):
            at = self.slot[terms]
            q[i, at[at >= 0]] = (own * self.term_scale[terms])[at >= 0]
        return q @ self._matrix

    def nearest(self, query, k: int, skip: int = -1, common: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``k`` examples of largest positive product with ``query``, exactly; ties by example number."""
        terms, own = arrays(query)
        if not len(terms) or not self.n:
            return []
        base = self.common_part([(terms, own)])[0] if common is None else common
        rare = self.slot[terms] < 0
        terms, own = terms[rare], own[rare] * self.term_scale[terms[rare]]
        self.queries += 1
        # where bounds have lately spared next to nothing, lists are read whole; now and then bounds are tried again
        if self.spared < 0.1 and self.queries % 16:
            return self._best(self._whole(terms, own, base), np.arange(self.n), k, skip)
        n = self.splits[terms + 1] - self.splits[terms]
        cells = _ranges(self.splits[terms], n)
        each, block = np.repeat(own, n), self.cell_block[cells]
        bound = np.bincount(block, each * self.cell_best[cells], minlength=self.n_blocks)
        bound = bound + np.maximum.reduceat(base, np.arange(0, self.n, BLOCK))
        order = np.argsort(-bound, kind="stable")
        found, at, step = [], 0, ROUND
        while at < len(order):
            floor = found[k - 1][0] if len(found) >= k else 0.0
            left = order[at:]
            left = left[(bound[left] > 0) & (bound[left] >= floor - 1e-9)]
            if not len(left):
                break
            if at and 4 * len(left) >= self.n_blocks:
                at, opened = len(order), left
                sims = self._whole(terms, own, base)
            else:
                at, step, opened = at + step, step * 2, left[:step]
                mark = np.zeros(self.n_blocks, bool)
                mark[opened] = True
                sel = mark[block]
                picked = cells[sel]
                start = self.cell[picked].astype(np.int64)
                m = self.cell[picked + 1] - start
                post = _ranges(start, m)
                sims = base + np.bincount(self._post[post], np.repeat(each[sel], m) * self._weights[post], minlength=self.n)
            self.opened += len(opened)
            inside = _ranges(opened * BLOCK, np.minimum(BLOCK, self.n - opened * BLOCK))
            found = sorted(found + self._best(sims[inside], inside, k, skip), key=lambda x: (-x[0], x[1]))[:k]
        self.spared += (1 - min(at, self.n_blocks) / self.n_blocks - self.spared) / 8
        return found

    def _whole(self, terms: np.ndarray, own: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The products with all examples: ``base`` and what the lists of these terms add."""
        spans = list(zip(self.start[terms].tolist(), self.start[terms + 1].tolist()))
        post = np.concatenate([self._post[:0], *(self._post[x:y] for x, y in spans)])
        weights = np.concatenate([self._weights[:0], *(self._weights[x:y] for x, y in spans)])
        weights *= np.repeat(own, [y - x for x, y in spans])
        return base + np.bincount(post, weights, minlength=self.n)

    def _best(self, sims: np.ndarray, rows: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """The ``k`` largest positive ones, rounded to 12 places, by example number where equal."""
        least = np.partition(sims, len(sims) - k - 1)[len(sims) - k - 1] - 1e-9 if len(sims) > k + 1 else 0.0
        near = np.flatnonzero((sims >= least) & (sims > 0))
        best, who = np.round(sims[near], 12), self.example[rows[near]]
        ok = (best > 0) & (who != skip)
        best, who = best[ok], who[ok]
        top = np.lexsort((who, -best))[:k]
        return list(zip(best[top].tolist(), who[top].tolist()))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit of y on x, as (upper ends of x, values)."""
    order = np.argsort(x, kind="stable")
    out: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if out and out[-1][0] == a:
            out[-1][1] += b
            out[-1][2] += 1
        else:
            out.append([a, b, 1])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            z = out.pop()
            out[-1] = [z[0], out[-1][1] + z[1], out[-1][2] + z[2]]
    return np.array([o[0] for o in out]), np.array([(o[1] + 0.02) / (o[2] + 0.2) for o in out])


def telling(examples: list[tuple[int, np.ndarray, np.ndarray, int]], n_words: int) -> np.ndarray:
    """The factor of each word's weight: 1, and more by as much as the word's tie to the label exceeds ``CHANCE``.

    The tie is the root of the likelihood ratio statistic of the label among the examples that have the word: about a
    standard normal deviate where the word and the label have nothing to do with each other. The few words that mark a
    label would else count no more than any other rare word of a text.
    """
    held, marked = np.zeros(n_words), np.zeros(n_words)
    for _, at, _, label in examples:
        held[at] += 1
        marked[at] += label
    rate = sum(e[3] for e in examples) / max(len(examples), 1)
    ratio = np.zeros(n_words)
    for part, share in ((marked, rate), (held - marked, 1 - rate)):
        some = part > 0
        ratio[some] += 2 * part[some] * np.log(part[some] / (held[some] * share))
    return 1 + np.maximum(np.sqrt(np.maximum(ratio, 0)) - CHANCE, 0)


class ToxicityModel:
    def __init__(self, examples: list[tuple[int, np.ndarray, np.ndarray, int]], words: np.ndarray, df: np.ndarray, n: int, k: int):
        """``examples``: (doc_id, places in ``words``, their counts, label) rows; ``words``: sorted hashes, in ``df`` of all ``n`` documents."""
        self.k, self.words = k, words
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * telling(examples, len(words))
        examples.sort(key=lambda e: e[0])
        plain = [label for _, own, _, label in examples if not len(own)]
        examples = [e for e in examples if len(e[1])]
        self.ids, self.y = np.array([e[0] for e in examples], np.int64), np.array([e[3] for e in examples], np.float64)
        self.rate = (float(self.y.sum()) + sum(plain) + 0.5) / (len(self.y) + len(plain) + 1)
        self.none = (sum(plain) + 0.2 * self.rate) / (len(plain) + 0.2)
        own = [(at, 1 + np.log(counts)) for _, at, counts, _ in examples]
        del examples
        norm = np.array([1 / math.sqrt(float(((w * self.idf[at]) ** 2).sum())) for at, w in own])
        self.index = BlockMaxIndex(own, len(words), self.idf, norm)

    def own_vote(self, doc_id: int, terms: np.ndarray, counts: np.ndarray) -> float:
        """The vote of an example's neighbours, itself left out."""
        return self.vote(self.index.nearest(self.vector(terms, counts), self.k, skip=int(np.searchsorted(self.ids, doc_id))))

    def calibrate(self, votes: np.ndarray) -> None:
        """Fit the steps from votes to scores on the examples' own votes, in their order."""
        self.ends, self.values = isotonic(votes, self.y) if len(votes) else (np.array([1.0]), np.array([self.rate]))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector of a text, telling words weighted up."""
        raw = (1 + np.log(counts)) * self.idf[terms]
        return terms, raw / math.sqrt(float(raw @ raw))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Label share among the nearest, weighted by 1 / (0.1 + cosine distance), shrunk to the base rate."""
        weight = [1 / (1.1 - min(s, 1.0)) for s, _ in near]
        return (sum(w * self.y[i] for w, (_, i) in zip(weight, near)) + self.rate) / (sum(weight) + 1)

    def scores(self, bodies: list[bytes]) -> list[tuple[float, list[int], list[float]]]:
        """(calibrated score, ids of the nearest examples, their cosines) of each whole text."""
        out = []
        for x, y in shingle.chunks(bodies):
            known = known_words(bodies[x:y], self.words)
            for at in range(0, len(known), QUERIES):
                vectors = [self.vector(*own) if len(own[0]) else own for own in known[at : at + QUERIES]]
                shares = self.index.common_part(vectors) if self.index.n else [None] * len(vectors)
                for vector, share in zip(vectors, shares):
                    if not len(vector[0]):
                        out.append((self.none, [], []))
                        continue
                    near = self.index.nearest(vector, self.k, common=share)
                    step = min(int(np.searchsorted(self.ends, self.vote(near))), len(self.ends) - 1)
                    out.append((float(min(max(self.values[step], 0.0), 1.0)), [int(self.ids[i]) for _, i in near[:3]], [s for s, _ in near[:3]]))
        return out


def known_words(bodies: list[bytes], words: np.ndarray):
    """(places in ``words``, counts) of each text's words that are among them."""
    h, splits = shingle.word_hashes(bodies, common.AZ_TABLE)
    text = np.repeat(np.arange(len(bodies)), np.diff(splits))
    at = np.searchsorted(words, h)
    held = np.flatnonzero(at < len(words))
    held = held[words[at[held]] == h[held]]
    pairs, counts = np.unique(text[held] * len(words) + at[held], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(1, len(bodies) + 1) * len(words))
    pairs %= max(len(words), 1)
    return [(pairs[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def _example_rows(src: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, y, words, counts``: distinct word hashes and their counts, as bytes, of the sampled documents."""
    ddl = "doc_id long, y int, words binary, counts binary"
    schema = common.arrow_schema(ddl)

    def count(batches):
        for b in batches:
            bodies = b.column("body").to_pylist()
            h, splits = shingle.word_hashes(bodies, common.AZ_TABLE)
            own = [np.unique(h[x:y], return_counts=True) for x, y in zip(splits[:-1], splits[1:])]
            yield common.emit({
                "doc_id": b.column("doc_id").to_pylist(), "y": b.column("y").to_pylist(), "words": [w.astype("<u8").tobytes() for w, _ in own], "counts": [c.astype("<i4").tobytes() for _, c in own],
            }, schema)

    one = src.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    return common.materialise(one.select("doc_id", "y", "body").mapInArrow(common.tidy(count), ddl), "examples")


def document_frequencies(src: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the sorted word hashes is, and the number of documents."""
    shared = src.sparkSession.sparkContext.broadcast(words)
    ddl, packed = "at int, df long", "at binary, df binary"
    schema, packed_schema = common.arrow_schema(ddl), common.arrow_schema(packed)

    def count(batches):
        own = shared.value
        df, n = np.zeros(len(own) + 1, np.int64), 0
        for b in batches:
            bodies = b.column("body").to_pylist()
            n += len(bodies)
            for x, y in shingle.chunks(bodies):
                for at, _ in known_words(bodies[x:y], own):
                    df[at] += 1
        df[len(own)] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], schema=schema)

    def pack(batches):
        for b in batches:
            yield common.emit({"at": [b.column("at").to_numpy().astype("<i4").tobytes()], "df": [b.column("df").to_numpy().astype("<i8").tobytes()]}, packed_schema)

    counts = src.select("body").mapInArrow(common.tidy(count), ddl).groupBy("at").agg(F.sum("df").alias("df"))
    df = np.zeros(len(words) + 1, np.int64)
    # 12 bytes for each word of the examples
    for r in counts.mapInArrow(pack, packed).collect():
        df[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.df, "<i8")
    shared.destroy()
    return df[:-1], int(df[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2, train_rows: int = 12000, k: int = 15, text_col: str = "text", id_col: str = "doc_id") -> ToxicityModel:
    """The index of at most ``train_rows`` labelled examples outside the held-out fold, with the IDFs of all documents."""
    src = common.documents(docs, id_col, text_col)
    held = _example_rows(src, labelled_sample(labels, label, folds, fold, train_rows))
    # at most train_rows examples: 12 bytes for each of their distinct words
    found = [(r.doc_id, np.frombuffer(r.words, "<u8"), np.frombuffer(r.counts, "<i4"), r.y) for r in held.toLocalIterator()]
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _, _ in found)]))
    df, n = document_frequencies(src, words)
    for i, (key, w, c, y) in enumerate(found):  # each in place of its hashes
        found[i] = (key, np.searchsorted(words, w).astype(np.int32), c, y)
    model = ToxicityModel(found, words, df, n, k)
    found.clear()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl_votes = "doc_id long, vote double"
    schema_votes = common.arrow_schema(ddl_votes)

    def votes(batches):
        for b in batches:
            out = {"doc_id": [], "vote": []}
            for key, w, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "words", "counts"))):
                if w:
                    out["doc_id"].append(key)
                    out["vote"].append(shared.value.own_vote(key, np.searchsorted(shared.value.words, np.frombuffer(w, "<u8")), np.frombuffer(c, "<i4")))
            yield common.emit(out, schema_votes)

    own = held.select("doc_id", "words", "counts").mapInArrow(common.tidy(votes), ddl_votes).collect()
    shared.destroy()
    model.calibrate(np.array([r.vote for r in sorted(own, key=lambda r: r.doc_id)]))
    common.discard(held)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, nearest_ids, nearest_cosines`` for every document's whole text.

    ``options`` are those of :func:`fit_toxicity`. Texts without a word of the vocabulary, null and empty ones
    too, get the label's rate among such examples (the base rate without examples) and no evidence. Repeated
    rows score alike; a null id counts as not held out.
    """
    model = fit_toxicity(docs, labels, folds=folds, fold=fold, text_col=text_col, id_col=id_col, **options)
    src = common.documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the driver needs it no more
    del model
    common.give_back()
    ddl_out = "doc_id long, held_out boolean, score double, predicted int, nearest_ids array<long>, nearest_cosines array<double>"
    out_schema = common.arrow_schema(ddl_out)

    def run(batches):
        m = shared.value
        for b in batches:
            got = m.scores(b.column("body").to_pylist())
            yield common.emit({
                "doc_id": b.column("doc_id").to_pylist(), "held_out": b.column("held_out").to_pylist(), "score": [g[0] for g in got],
                "predicted": [int(g[0] >= threshold) for g in got], "nearest_ids": [g[1] for g in got], "nearest_cosines": [g[2] for g in got],
            }, out_schema)

    return src.select("doc_id", F.coalesce(held_out("doc_id", folds, fold), F.lit(False)).alias("held_out"), "body").mapInArrow(common.tidy(run), ddl_out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that score under ``threshold``.

    Null and empty texts score as in :func:`score_toxicity`; rows that repeat an id are judged each by its own
    text, equal texts alike; rows without an id stay or go by their text. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, text_col=text_col, **options))
    common.give_back()
    common.shrink_executors(docs.sparkSession)

    def run(batches):
        for b in batches:
            bodies = b.column(text_col).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([s[0] < threshold for s in shared.value.scores([x or b"" for x in bodies])], pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)
