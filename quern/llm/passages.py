"""Near-duplicate passages by compact windows.

The tokens are five-word shingles. For a hash function, the subsequences of at least ``least`` tokens whose
min-hash is the token at place c are the pairs (start, end) in one rectangle around c: c's node in the
Cartesian tree of the token hashes. Only nodes wide enough to hold such a subsequence matter, and these are
the places that are the minimum of some window of ``least`` tokens, so they are found, for whole batches,
by sliding minima. A rectangle's sides are kept as far as windows of ``least`` tokens reach.

Windows are grouped by (function, min-hash); a group's first document is its representative. What no passage
shared with it explains then meets all earlier members of its group, in blocks. The stretches of
text that the shared windows of a member and its representative span, and a margin, are cut from both documents.
Their runs of equal tokens, on whatever diagonals, are chained, and a chain is a passage if its two sets of
shingles are alike enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingle

U = np.uint64
WIDTH, FUNCTIONS = 5, 4
_FACTORS = np.random.default_rng(77).integers(0, 2**63, 32, dtype=np.uint64) * U(2) + U(1)
#: Stretches of one document that one task cuts, about.
SALT_ROWS = 256
#: Tokens on either side of a pair's windows that are compared as well, and between windows that are compared in one stretch.
MARGIN, JOINED = 46, 512
#: Such tokens where only some windows of two documents are compared, as the others can give nothing by themselves.
WIDE = 192
#: Leads of a block, and windows that one task streams past it, among members that did not match the first document, about.
BLOCK, STREAM = 1024, 8192
#: Windows of a group whose tokens one task counts, about.
GROUP = 4096
#: Pairs of equal tokens that are held at once when two stretches are compared, about.
PAIRS = 1 << 21
#: Marks tokens with a word in no passage found so far, beside 15 bits of the hash.
OPEN = 1 << 15
_NEVER = -(1 << 62)


def compact_windows(tokens: np.ndarray, splits: np.ndarray, least: int, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, c, first start, last end) of each compact window, places within the text, ends exclusive.

    The starts of the windows of ``least`` tokens with minimum c are consecutive; the window's interval is
    from the first of them to the end of the last. Among equal minima the one met before stays as long as it
    is inside, then the rightmost follows, so that text repeating itself has no more windows than other text.
    """
    n = len(tokens)
    if n < least:
        return (np.zeros(0, np.int64),) * 4
    bits = U(max(20, n.bit_length()))
    mask = (U(1) << bits) - U(1)
    low = (tokens * _FACTORS[function]) >> bits << bits | (mask - np.arange(n, dtype=np.uint64))
    width = 1
    while width * 2 <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    starts = n - least + 1
    low = np.minimum(low[:starts], low[least - width : least - width + starts])
    text = np.repeat(np.arange(len(splits) - 1), np.diff(splits))[:starts]
    inside = np.arange(starts) + least <= splits[text + 1]
    c, value = (mask - (low & mask)).astype(np.int64), low >> bits
    new = inside.copy()
    new[1:] &= (value[1:] != value[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    for a, b in zip(first[tied := c[first] != c[last]].tolist(), last[tied].tolist()):
        a = int(c[a]) + 1
        while a <= b:
            new[a] = True
            a = int(c[a]) + 1
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    base = splits[text[first]]
    return text[first], c[first] - base, first - base, last + least - base


def _windows(src: DataFrame, least: int, functions: int) -> DataFrame:
    """``key, doc_id, place, at``: place packs (c, c - start, end - c); at holds all places of a key in its document, in one row of them."""
    ddl = "key long, doc_id long, place long, at array<long>"
    schema = common.arrow_schema(ddl)
    import pyarrow as pa

    def run(batches):
        for b in batches:
            bodies, ids = b.column("body").to_pylist(), b.column("doc_id").to_numpy(zero_copy_only=False)
            for x, y in shingle.chunks(bodies):
                tok, splits = shingle.shingle_hashes(*shingle.word_hashes(bodies[x:y], common.AZ_TABLE), WIDTH, short=False)
                for f in range(functions):
                    text, c, start, end = compact_windows(tok, splits, least, f)
                    key = shingle.mix(tok[splits[text] + c] * _FACTORS[-1 - f])
                    order = np.lexsort((c, key, text))
                    first = np.ones(len(key), bool)
                    first[1:] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                    place = (c << 20 | (c - start) << 10 | (end - c))[order]
                    at = np.append(np.flatnonzero(first), len(key))
                    # the first row of a key has all of its places, the others have none
                    ends = np.repeat(at[1:], np.diff(at))
                    at = pa.ListArray.from_arrays(pa.array(np.append([0], ends), pa.int32()), pa.array(place)).cast(schema.field("at").type)
                    yield pa.RecordBatch.from_arrays([pa.array(key[order].view(np.int64)), pa.array(ids[x + text[order]], pa.int64()), pa.array(place), at], schema=schema)

    return src.where("doc_id is not null").mapInArrow(common.tidy(run), ddl)


def _runs(own: np.ndarray, rep: np.ndarray, order: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``(i, j, length)`` of each maximal diagonal run of equal tokens, by i; ``order`` sorts ``rep``, ``lo`` and ``n`` give the equal ones of each of ``own``."""
    i = np.repeat(np.arange(len(own)), n)
    j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    at = np.flatnonzero(new)
    runs = np.stack((i[at], j[at], np.diff(np.append(at, len(i)))), axis=1)
    return runs[np.argsort(runs[:, 0], kind="stable")]


def _chain(runs: np.ndarray, most: int, seed: np.ndarray, percent: int) -> tuple[int, int, int, int]:
    """``(lo, hi, match_lo, match_hi)`` of a run and those before and after it that keep the similarity at ``percent`` %.

    ``most`` is the length of the longest run: what is further off than such a run could make up for is not looked at.
    """
    lo, a, n = seed.tolist()
    hi, b, equal = lo + n, a + n, n
    starts = runs[:, 0]
    while True:
        reach = ((100 + percent) * equal - percent * (hi - lo + b - a) + (100 - percent) * most) // percent
        x, y = np.searchsorted(starts, (lo - reach - most, hi + reach + 1))
        ri, rj, rn = runs[x:y].T
        skip = np.maximum(np.maximum(hi - ri, b - rj), 0)  # what of a later run is before the end
        after = rn - skip
        drop = np.maximum(np.maximum(ri + rn - lo, rj + rn - a), 0)
        before = rn - drop
        best = None
        for more, total in ((after, (ri + rn - lo) + (rj + rn - a)), (before, (hi - ri) + (b - rj))):
            gain = (100 + percent) * more - percent * total
            gain[(more <= 0) | (gain + (100 + percent) * equal < 0)] = _NEVER
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] != _NEVER and (best is None or gain[at] > best[0]):
                best = int(gain[at]), at, int(more[at]), more is after
        if best is None:
            return lo, hi, a, b
        _, at, more, later = best
        equal += more
        if later:
            hi, b = int(ri[at] + rn[at]), int(rj[at] + rn[at])
        else:
            lo, a = int(ri[at]), int(rj[at])


def shortest_seed(least: int, percent: int) -> int:
    """The least length that the longest run of a chain of ``least`` tokens can have.

    Equal tokens are at least ``percent`` % of those of both sides less the equal ones. A word that differs is in
    ``WIDTH`` shingles of one side and in all but one of the other, so the parts between m runs have at least
    (2 WIDTH - 1) (m - 1) tokens on both sides together, and that many more must agree.
    """
    equal = -(-2 * percent * least // (100 + percent))
    parted = lambda m: -(-(2 * WIDTH - 1) * (m - 1) * percent // (100 - percent)) if percent < 100 else 0
    return min(-(-max(equal, parted(m)) // m) for m in (range(1, equal + 1) if percent < 100 else (1,)))


def best_stretch(match: np.ndarray, less: np.ndarray, least: int, percent: int, open_: np.ndarray | None = None) -> np.ndarray:
    """Of each row of ``match``, the most that a stretch of ``least`` tokens or more can add to :func:`alike`'s two sides; one below -2**40 if there is none.

    Sets agree by ``percent`` % if (100 + percent) times the equal tokens reach percent times those of both sides. With the
    equal ones counted on either side, half each, every equal token of a side adds 100 - percent and every other one, by
    ``less``, takes 2 percent away: a passage's two stretches cannot come to less than 0. Stretches begin and end with equal
    tokens; those without a token in ``open_``, if that is given, do not count.
    """
    n, width = match.shape
    none = -(1 << 41)
    if width < least:
        return np.full(n, none, np.int64)
    s = np.zeros((n, width + 1), np.int64)
    np.cumsum(np.where(match, 100 - percent, less), axis=1, out=s[:, 1:])
    # the most by ends from each place on
    end = np.full((n, width + 1), none, np.int64)
    end[:, :-1] = np.where(match, s[:, 1:], none)
    end = np.maximum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
    if open_ is None:
        end = end[:, least - 1 : width]
    else:
        x = np.arange(width)
        nearest = np.minimum.accumulate(np.where(open_, x, width)[:, ::-1], axis=1)[:, ::-1]
        end = np.take_along_axis(end, np.maximum(nearest, np.minimum(x + least - 1, width)), axis=1)[:, : width - least + 1]
    starts = end.shape[1]
    return np.where(match[:, :starts], end - s[:, :starts], none).max(axis=1)


def unlike_costs(own: np.ndarray, percent: int) -> np.ndarray:
    """What each of these tokens takes away in :func:`best_stretch` if it is not an equal one: nothing if it is there repeatedly, as sets count it once."""
    _, at, times = np.unique(own, return_inverse=True, return_counts=True)
    return np.where(times[at] > 1, 0, -2 * percent)


def alike(own: np.ndarray, rep: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, float]]:
    """``(from, to, match_from, similarity)`` stretches of ``least`` tokens or more whose sets agree by ``percent`` % with one of ``rep``.

    Runs of equal tokens on any diagonals are chained from the longest on, so that inserted and deleted words
    only part runs. Runs inside a stretch already found give no further one, nor do runs shorter than any
    chain's longest. Of texts with more than ``PAIRS`` pairs of equal tokens, as one line repeated without end
    has, the runs are made and chained part by part.
    """
    order = np.argsort(rep, kind="stable")
    flat = rep[order]
    lo = np.searchsorted(flat, own, "left")
    n = np.searchsorted(flat, own, "right") - lo
    if np.count_nonzero(n) * (100 + percent) < 2 * percent * least:
        return []
    longest = shortest_seed(least, percent)
    total, done, out, start = np.cumsum(n), np.zeros(len(own) + 1, np.int64), [], 0
    while start < len(own):
        base = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        if not done[start:end].all() and total[end - 1] > base:
            runs = _runs(own[start:end], rep, order, lo[start:end], n[start:end])
            runs[:, 0] += start
            # a part's runs go on outside it, so any of them can be a chain's longest
            part = end - start < len(own)
            enough = np.full(len(runs), True) if part else runs[:, 2] >= longest
            _passages(own, rep, runs, enough, part, done, out, least, percent)
            if not part and out and not enough.all():
                # shorter ones can still lead to stretches that reach into one already found
                edge = np.flatnonzero(np.diff(done, prepend=0))
                first, last = edge[::2], edge[1::2]
                lo_, hi_ = runs[:, 0], runs[:, 0] + runs[:, 2]
                near = np.zeros(len(runs), bool)
                for x, y in zip(first.tolist(), last.tolist()):
                    gap = np.maximum(np.maximum(x - hi_, lo_ - y), 0)
                    near |= percent * gap <= (100 - percent) * (runs[:, 2] + y - x)
                _passages(own, rep, runs, near & ~enough, part, done, out, least, percent)
        start = end
    return out


def _passages(own, rep, runs, seeds, part, done, out, least, percent) -> None:
    """Adds to ``out`` the stretches chained from ``runs[seeds]``, the longest first, and marks their places as ``done``.

    Runs that overlap no stretch found come before those that do.
    In texts that repeat themselves many runs have the same surroundings on both sides, as far as any chain of
    theirs could look; where one of them gave too short a chain, the others are passed over.
    """
    todo = np.flatnonzero(seeds)
    todo = todo[np.argsort(-runs[todo, 2], kind="stable")]
    known = np.append(0, np.cumsum(done[:-1]))
    left = lambda at: at[known[runs[at, 0] + runs[at, 2]] - known[runs[at, 0]] < runs[at, 2]]
    todo = left(todo)
    most = int(runs[:, 2].max())
    around = 2 * least + most + ((100 - percent) * (2 * least + most)) // percent
    context = lambda x, i, m: (min(i, around), x[max(i - around, 0) : i + m + around].tobytes())
    short, at, later, apart = set(), 0, [], True
    while at < len(todo) or later:
        if at == len(todo):
            # now those that overlap a stretch found, which the others may have covered
            todo, at, later, apart = left(np.array(later)), 0, [], False
            continue
        seed = runs[todo[at]]
        at += 1
        i, j, m = seed.tolist()
        over = known[i + m] - known[i]
        if over:
            if over < m:
                later.append(todo[at - 1]) if apart else None
            if over == m or apart:
                continue
        if part:
            grow = min(len(own) - i, len(rep) - j)
            off = np.flatnonzero(own[i : i + grow] != rep[j : j + grow])
            seed = np.array((i, j, int(off[0]) if len(off) else grow))
        key = hash((m, context(own, i, m), context(rep, j, m)))
        if key in short:
            continue
        chained = _chain(runs, max(most, int(seed[2])), seed, percent)
        for x, y, a, b in (chained, (int(seed[0]), int(seed[0] + seed[2]), int(seed[1]), int(seed[1] + seed[2]))):
            if min(y - x, b - a) >= least:
                u, v = np.unique(own[x:y]), np.unique(rep[a:b])
                same = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * same >= percent * (len(u) + len(v) - same):
                    out.append((x, y, a, same / (len(u) + len(v) - same)))
                    done[x:y] = 1
                    known = np.append(0, np.cumsum(done[:-1]))
                    break
        else:
            x, y, a, b = chained
            if max(y - x, b - a) < 2 * least:
                short.add(key)
            if y - x > m:
                # shorter runs inside it would be chained alike; longer ones are passages by themselves
                rest = runs[todo[at:]]
                inside = (rest[:, 0] >= x) & (rest[:, 0] + rest[:, 2] <= y) & (rest[:, 1] >= a) & (rest[:, 1] + rest[:, 2] <= b) & (rest[:, 2] < least)
                todo = todo[at:][~inside]
                at = 0


def _leads(wins: DataFrame) -> DataFrame:
    """The first document, all its places and the number of windows of each key that several documents have."""
    lead = wins.where("size(at) > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.min_by("at", "doc_id").alias("at"), F.sum(F.size("at")).alias("n"))
    return common.materialise(lead.where("rep <> other").select("key", "rep", "at", "n"), "leads")


def _pairs(both: DataFrame, enough: int) -> DataFrame:
    """``doc_id, rep, mine, theirs``: the windows of a document and of an earlier one that have keys ``(key, doc_id, place, rep, at)`` in common."""
    found = [F.count_distinct("key").alias("hashes")] if enough > 1 else []
    pairs = both.groupBy("doc_id", "rep").agg(F.collect_set("place").alias("mine"), F.array_distinct(F.flatten(F.collect_set("at"))).alias("theirs"), *found)
    return pairs.where(F.col("hashes") >= enough).drop("hashes") if found else pairs


def stretches(places: list[int], margin: int = MARGIN) -> list[tuple[int, int]]:
    """The places that windows and their margins cover, those near each other as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(((p >> 20) - (p >> 10 & 1023) - margin, (p >> 20) + (p & 1023) + margin) for p in places):
        if out and lo <= out[-1][1] + JOINED:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([max(lo, 0), hi])
    return [(a, z) for a, z in out]


def _slices(src: DataFrame, pairs: DataFrame, margin: int) -> tuple[DataFrame, DataFrame]:
    """``rep, doc_id, is_member, at, body``: the stretches of text, from word ``at``, of both documents of each pair; and the stored table it reads.

    A document's stretches are cut in tasks of about ``SALT_ROWS`` of them, so none is held for all its partners.
    """
    side = lambda owner, member, places: F.struct(F.col(owner).alias("owner"), F.lit(member).alias("is_member"), F.col(places).alias("places"))
    asked = pairs.select("rep", "doc_id", F.explode(F.array(side("doc_id", True, "mine"), side("rep", False, "theirs"))).alias("s")).select("rep", "doc_id", "s.*")
    salts = asked.groupBy("owner").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salts = common.materialise(salts.where("salts > 1"), "salts")
    salted = common.salted_join(asked, salts, "owner", ("rep", "doc_id", "is_member"), "left").withColumn("salt", F.pmod(F.xxhash64("rep", "doc_id"), F.coalesce("salts", F.lit(1))))
    # dealt by the salt too: a document that is many others' representative would else meet in one task
    need = salted.repartition("owner", "salt").groupBy("owner", "salt").agg(F.collect_list(F.struct("rep", "doc_id", "is_member", "places")).alias("asked"))
    need = common.materialise(need.select("owner", "asked"), "needed")
    common.discard(salts)
    ddl = "rep long, doc_id long, is_member boolean, at long, body binary"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out = {k: [] for k in schema.names}
            for body, asked in zip(b.column("body").to_pylist(), b.column("asked").to_pylist()):
                starts, ends = shingle.word_places(body, common.AZ_TABLE)
                for q in asked:
                    for a, z in stretches(q["places"], margin):
                        z = min(z + WIDTH - 1, len(starts))
                        if a < z:
                            for name in ("rep", "doc_id", "is_member"):
                                out[name].append(q[name])
                            out["at"].append(a)
                            out["body"].append(body[starts[a] : ends[z - 1]])
            yield common.emit(out, schema)

    held = src.withColumnRenamed("doc_id", "owner").join(common.bounded(need), "owner").select("body", "asked")
    return held.mapInArrow(common.tidy(run), ddl), need


def _verified(src: DataFrame, pairs: DataFrame, least: int, percent: int, margin: int = MARGIN) -> DataFrame:
    """The passages that the documents of ``pairs`` share, stored, as rows of :func:`repeated_passages`."""
    held, need = _slices(src, pairs, margin)
    common.free_shuffles(src.sparkSession)
    key = ("rep", "doc_id")
    held = held.repartition(*key).sortWithinPartitions(*key, "is_member")
    ddl = "doc_id long, start long, n_words long, match_doc_id long, match_start long, similarity double"
    schema = common.arrow_schema(ddl)

    def run(batches):
        met, reps, mine = None, {}, set()
        for b in batches:
            bodies = b.column("body").to_pylist()
            rows = list(zip(*(b.column(c).to_pylist() for c in (*key, "is_member", "at"))))
            for x, y in shingle.chunks(bodies):
                tok, splits = shingle.shingle_hashes(*shingle.word_hashes(bodies[x:y], common.AZ_TABLE), WIDTH, short=False)
                out = {k: [] for k in schema.names}
                for i, (r, k, is_member, at) in enumerate(rows[x:y]):
                    own = tok[splits[i] : splits[i + 1]]
                    if met != (r, k):
                        met, reps, mine = (r, k), {}, set()
                    if not is_member:
                        reps[at] = own.copy()
                        continue
                    if at in mine:  # the other row of a repeated id
                        continue
                    mine.add(at)
                    for first, rep in reps.items():
                        for lo, hi, a, similarity in alike(own, rep, least, percent):
                            row = (k, at + lo, hi - lo + WIDTH - 1, r, first + a, similarity)
                            for name, v in zip(schema.names, row):
                                out[name].append(v)
                yield common.emit(out, schema)

    found = common.materialise(held.mapInArrow(common.tidy(run), ddl).distinct(), "found")
    common.discard(need)
    return found


def _unlinked(wins: DataFrame, lead: DataFrame, found: DataFrame) -> DataFrame:
    """``key, doc_id, place, is_lead``: members, without the first document, of the groups with a window that ``found`` does not explain.

    These windows, whose own token is in no passage found so far, are the leads.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words") - WIDTH + 1).alias("end"))).alias("spans"))
    members = common.salted_join(wins.select("key", "doc_id", "place"), lead.select("key", "rep", "n"), "key", ("doc_id", "place"), rows="n").where("doc_id <> rep").drop("rep")
    c = F.shiftright("place", 20)
    inside = F.exists("spans", lambda s: (s["start"] <= c) & (c < s["end"]))
    members = common.materialise(members.join(spans, "doc_id", "left").select("key", "doc_id", "place", (~F.coalesce(inside, F.lit(False))).alias("is_lead")), "members", "lz4")
    # the one of smallest id has no earlier document left to meet
    several = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.max(F.when(F.col("is_lead"), F.col("doc_id"))).alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n")
    several = common.materialise(several, "several")
    left = common.materialise(common.salted_join(members, several, "key", ("doc_id", "place"), "left_semi", rows="n"), "unlinked")
    common.discard(members, several)
    return left


def shared_tokens(rows: list[tuple[int, bool, np.ndarray]]) -> list[tuple[np.ndarray, int, int]]:
    """Of each window ``(doc_id, is_lead, tokens)`` of a group: the tokens that it can have in common with a pair's other window, and their numbers as a lead and as a member.

    A pair is a lead and a window of an earlier document, so a lead's tokens count if an earlier document has them, a member's if a later lead has.
    """
    sizes = [len(t) for _, _, t in rows]
    own = np.repeat(np.arange(len(rows)), sizes)
    ids, leads = np.array([k for k, _, _ in rows], np.int64), np.array([x for _, x, _ in rows], bool)
    flat = np.concatenate([t for _, _, t in rows])
    if not len(flat):
        return [(t, 0, 0) for _, _, t in rows]
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = np.diff(flat[order]) != 0
    first = np.flatnonzero(new)
    least, most = np.iinfo(np.int64).min, np.diff(np.append(first, len(flat)))
    holder = own[order]
    earliest = np.minimum.reduceat(ids[holder], first)
    latest = np.maximum.reduceat(np.where(leads[holder], ids[holder], least), first)
    as_lead, as_member = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    as_lead[order] = leads[holder] & (np.repeat(earliest, most) < ids[holder])
    as_member[order] = np.repeat(latest, most) > ids[holder]
    a, b = (np.bincount(own[x], minlength=len(rows)).tolist() for x in (as_lead, as_member))
    ends = np.cumsum([0, *sizes])
    keep = as_lead | as_member
    return [(flat[x:y][keep[x:y]], m, n) for x, y, m, n in zip(ends[:-1], ends[1:], a, b)]


def _comparable(src: DataFrame, left: DataFrame, few: int, found: DataFrame | None = None) -> DataFrame:
    """``key, doc_id, place, is_lead, is_member, whole, around, tokens``, stored: the windows of ``left`` that can have ``few`` tokens in common with another.

    ``tokens`` are those of :func:`shared_tokens`, as 32 bits of their hashes, which can only make more of them seem
    common; ``whole`` is a hash of all that the window and its margins hold, in order, and ``around`` are these tokens, as 15 bits of their
    hashes, with ``OPEN`` where a word of one is in no passage of ``found``. The tokens of a large group are counted part by part.
    """
    often = left.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    often = common.materialise(often, "often")
    dealt = left.join(common.bounded(often), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    need = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "is_lead", "parts")).alias("asked"))
    if found is None:
        need = need.withColumn("spans", F.expr("CAST(NULL AS array<struct<start: long, n_words: long>>)"))
    else:
        need = need.join(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("spans")), "doc_id", "left")
    need = need.withColumnRenamed("doc_id", "owner")
    ddl = "key long, part int, parts int, doc_id long, place long, is_lead boolean, whole long, around binary, tokens binary"
    schema = common.arrow_schema(ddl)

    def cut(batches):
        for b in batches:
            bodies, ids, asked, spans = (b.column(c).to_pylist() for c in ("body", "owner", "asked", "spans"))
            for x, y in shingle.chunks(bodies):
                tok, splits = shingle.shingle_hashes(*shingle.word_hashes(bodies[x:y], common.AZ_TABLE), WIDTH, short=False)
                out = {k: [] for k in schema.names}
                for i, key, own in zip(range(x, y), ids[x:y], asked[x:y]):
                    t = (tok[splits[i - x] : splits[i - x + 1]] >> U(32)).astype(np.uint32)
                    brief = (t & (OPEN - 1)).astype("<u2") | OPEN
                    for s in spans[i] or ():  # tokens with all their words in it
                        brief[s["start"] : max(s["start"] + s["n_words"] - WIDTH + 1, 0)] &= OPEN - 1
                    for q in own:
                        c = q["place"] >> 20
                        a, z = c - (q["place"] >> 10 & 1023), c + (q["place"] & 1023)
                        margins = slice(max(a - MARGIN, 0), z + MARGIN)
                        mine, around = np.unique(t[a:z]), brief[margins].tobytes()
                        whole = int.from_bytes(hashlib.blake2b(t[margins].tobytes(), digest_size=8).digest(), "little", signed=True)
                        for part in range(q["parts"]):
                            some = mine[mine % q["parts"] == part] if q["parts"] > 1 else mine
                            row = (q["key"], part, q["parts"], key, q["place"], q["is_lead"], whole, around, some.tobytes())
                            for name, v in zip(schema.names, row):
                                out[name].append(v)
                yield common.emit(out, schema)

    held = src.withColumnRenamed("doc_id", "owner").join(need, "owner").mapInArrow(common.tidy(cut), ddl)
    held = held.repartition("key", "part").sortWithinPartitions("key", "part")
    ddl = "key long, part int, parts int, doc_id long, place long, whole long, around binary, tokens binary, n_lead int, n_member int"
    schema_out = common.arrow_schema(ddl)

    def counted(group, out):
        for (key, part, parts, doc, place, _, whole, around, _), (tokens, n, m) in zip(group, shared_tokens([(r[3], r[5], np.frombuffer(r[8], np.uint32)) for r in group])):
            if n or m if parts > 1 else max(n, m) >= few:
                for name, v in zip(schema_out.names, (key, part, parts, doc, place, whole, around, tokens.tobytes(), n, m)):
                    out[name].append(v)

    def run(batches):
        at, group = None, []
        for b in batches:
            out = {k: [] for k in schema_out.names}
            for row in zip(*(b.column(c).to_pylist() for c in schema.names)):
                if at != row[:2]:
                    if group:
                        counted(group, out)
                    at, group = row[:2], []
                group.append(row)
            yield common.emit(out, schema_out)
        if group:
            out = {k: [] for k in schema_out.names}
            counted(group, out)
            yield common.emit(out, schema_out)

    kept = common.materialise(held.mapInArrow(common.tidy(run), ddl), "counted")
    common.discard(often)
    names = ("key", "doc_id", "place")
    sides = lambda n, m: ((F.col(n) >= few).alias("is_lead"), (F.col(m) >= few).alias("is_member"))
    small = kept.where("parts = 1").select(*names, *sides("n_lead", "n_member"), "whole", "around", "tokens")
    large = kept.where("parts > 1").groupBy(*names, "whole", "around").agg(F.sum("n_lead").alias("n"), F.sum("n_member").alias("m"), F.collect_list("tokens").alias("t"))
    joined = F.aggregate("t", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    large = large.where(F.greatest("n", "m") >= few).select(*names, *sides("n", "m"), "whole", "around", joined.alias("tokens"))
    out = common.materialise(small.union(large), "windows")
    common.discard(kept)
    return out


class Block:
    """Leads ``(doc_id, place, tokens, around)`` of a block, past which the windows of their group stream."""

    def __init__(self, leads: list[tuple[int, int, np.ndarray, np.ndarray]], least: int, percent: int):
        self.few, self.least, self.percent = -(-least // 2), least, percent
        flat = np.concatenate([t for _, _, t, _ in leads])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(leads)), [len(t) for _, _, t, _ in leads])[order]
        self.ids = np.array([k for k, *_ in leads], np.int64)
        shape = len(leads), max(len(a) for *_, a in leads)
        # beyond a window's end is a token that none has
        self.around, self.open, self.less = np.full(shape, OPEN, np.int64), np.zeros(shape, bool), np.zeros(shape, np.int64)
        self.has, self.mark = np.zeros((len(leads), OPEN), bool), np.zeros(OPEN + 1, bool)
        for i, (*_, a) in enumerate(leads):
            own = a & (OPEN - 1)
            self.around[i, : len(a)], self.open[i, : len(a)], self.less[i, : len(a)] = own, a >= OPEN, unlike_costs(own, percent)
            self.has[i, own] = True

    def met(self, key: int, tokens: np.ndarray, around: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the later documents' leads, less those ``known``, that have enough tokens in common with this window; and which of them can have a passage in common with it that is not all found yet."""
        lo = np.searchsorted(self.flat, tokens, "left")
        n = np.searchsorted(self.flat, tokens, "right") - lo
        same = np.bincount(self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], minlength=len(self.ids))
        enough = (same >= self.few) & (self.ids > key)
        at = np.flatnonzero(enough if known is None else enough & ~known)
        if not len(at):
            return at, np.zeros(0, bool)
        own = around & (OPEN - 1)
        self.mark[own] = True
        most = best_stretch(self.mark[self.around[at]], self.less[at], self.least, self.percent, self.open[at])
        self.mark[own] = False
        fit = most + (100 - self.percent) * len(own) >= 0
        some = np.flatnonzero(fit)
        if len(some):
            less = np.broadcast_to(unlike_costs(own, self.percent), (len(some), len(own)))
            fit[some] = most[some] + best_stretch(self.has[at[some][:, None], own], less, self.least, self.percent) >= 0
        return at, fit


def _further(src: DataFrame, left: DataFrame, found: DataFrame, least: int, percent: int, enough: int) -> DataFrame:
    """The pairs, stored, of each lead of ``left`` with the earlier documents of its groups whose windows have tokens in common.

    Leads are dealt out in blocks, and all windows of the group stream past each, so every lead meets all of them.
    A passage agrees with another in seven tenths or more of the tokens of some window; pairs of windows with less
    than half of ``least`` in common are left out, and windows that cannot have as many with another are before they
    are dealt. Of windows whose text is the same, margins and all, a lead takes the first. Pairs of windows in which, margins
    and all, no stretches that are alike enough hold a word that is in no passage yet (:func:`best_stretch`) are left out too.
    """
    own = _comparable(src, left, -(-least // 2), found)
    common.free_shuffles(src.sparkSession)
    per = own.groupBy("key").agg(F.ceil(F.count_if("is_lead") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("is_member") / STREAM).cast("int").alias("salts"))
    per = common.materialise(per.where("blocks > 0 and salts > 0"), "per")
    at = common.salted_join(own, per, "key", ("doc_id", "place"))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("doc_id", "place", "key"), F.col(n)).cast("int")
    names = ("key", "block", "salt")
    lead = at.where("is_lead").withColumn("block", deal("blocks")).withColumn("salt", cells("salts"))
    past = at.where("is_member").withColumn("salt", deal("salts")).withColumn("block", cells("blocks"))
    side = lambda df, member: df.select(*names, F.lit(member).alias("is_member"), "doc_id", "place", "whole", "around", "tokens")
    held = side(lead, False).union(side(past, True)).repartition(*names).sortWithinPartitions(*names, "is_member", "doc_id")
    ddl = "key long, doc_id long, rep long, place long, at array<long>"
    schema_out = common.arrow_schema(ddl)

    def meet(batches):
        where, leads, block, met = None, [], None, {}
        for b in batches:
            out = {k: [] for k in schema_out.names}
            for *cell, is_member, key, place, whole, around, raw in zip(*(b.column(c).to_pylist() for c in (*names, "is_member", "doc_id", "place", "whole", "around", "tokens"))):
                if where != cell:
                    where, leads, block, met = cell, [], None, {}
                around, t = np.frombuffer(around, "<u2"), np.frombuffer(raw, np.uint32)
                if not is_member:
                    leads.append((key, place, t, around))
                    continue
                if not leads or key >= leads[-1][0]:
                    continue
                block = block or Block(leads, least, percent)
                at, fit = block.met(key, t, around, met.get(whole))
                if len(at):
                    met.setdefault(whole, np.zeros(len(leads), bool))[at] = True
                for i in at[fit].tolist():
                    for name, v in zip(schema_out.names, (cell[0], leads[i][0], key, leads[i][1], [place])):
                        out[name].append(v)
            yield common.emit(out, schema_out)

    pairs = common.materialise(_pairs(held.mapInArrow(common.tidy(meet), ddl), enough), "aligned")
    common.discard(own, per)
    return pairs


def _adding(more: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``more`` with a word that is in no passage of ``found``."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))).alias("spans"))
    end = F.col("start") + F.col("n_words")
    # how far the found passages reach without a gap from the row's start on
    reach = F.aggregate("spans", F.col("start"), lambda at, s: F.when(s["start"] <= at, F.greatest(at, s["end"])).otherwise(at))
    return more.join(spans, "doc_id", "left").where(F.coalesce(reach, F.col("start")) < end).select(*more.columns)


def repeated_passages(docs: DataFrame, words: int = 50, percent: int = 80, functions: int = FUNCTIONS, enough: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_words, match_doc_id, match_start, similarity``: passages of ``words`` words or more that an earlier document has.

    ``similarity`` (at least ``percent`` %) is the Jaccard of the two stretches' shingle sets, which words inserted
    or deleted may have made of different length; ``match_doc_id`` is the representative, with the smaller id.
    Every such place is in a row, but not with every earlier document: a document's passages are those that it has in common
    with the first documents of its windows' groups, and those with other earlier ones that hold a word which none of these hold.
    Documents without such passages, null and empty texts and rows without an id give no rows; rows that repeat an
    id are one document.
    """
    if not WIDTH < words <= 500:
        raise ValueError("words must be from 6 to 500")
    src, least = common.documents(docs, id_col, text_col), words - WIDTH + 1
    spark = docs.sparkSession
    every = common.materialise(_windows(src, least, functions), "compact", "lz4")
    lead = _leads(every)
    common.free_shuffles(spark)
    # most windows are of one document only; those of the other keys are all that is needed from here on
    wins = common.materialise(common.salted_join(every.select("key", "doc_id", "place"), lead.select("key", "n"), "key", ("doc_id", "place"), "left_semi", rows="n"), "shared", "lz4")
    common.discard(every)
    common.free_shuffles(spark)
    # no more pairs than the members have windows
    met = common.salted_join(wins, lead, "key", ("doc_id", "place"), rows="n").where("doc_id <> rep")
    pairs = common.materialise(_pairs(met, enough), "aligned")
    found = _verified(src, pairs, least, percent)
    common.discard(pairs)
    common.free_shuffles(spark)
    left = _unlinked(wins, lead, found)
    common.discard(wins, lead)
    common.free_shuffles(spark)
    if left.isEmpty():
        return found
    pairs = _further(src, left, found, least, percent, enough)
    common.discard(left)
    common.free_shuffles(spark)
    if pairs.isEmpty():
        return found
    return found.union(_adding(_verified(src, pairs, least, percent, WIDE), found))


def cut_passages(docs: DataFrame, words: int = 50, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, all of them and with all their columns, less the passages that an earlier document has.

    Null and empty texts, rows without an id and texts without such passages stay as they are; rows that repeat an
    id are cut alike, at the same words. An empty table stays empty.
    """
    found = common.materialise(repeated_passages(docs, words, percent, text_col=text_col, id_col=id_col, **options), "passages")
    key, held = common.unused_name(docs, "_cut"), common.unused_name(docs, "_spans")
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "n_words")).alias(held))
    spans = common.bounded(common.materialise(spans, "spans"))
    joined = docs.join(spans, docs[id_col].cast("long") == F.col(key), "left").drop(key)
    import pyarrow as pa

    schema = joined.schema

    def cut(body: bytes, own) -> bytes:
        raw = np.frombuffer(body, np.uint8)
        starts, ends = shingle.word_places(body, common.AZ_TABLE)
        keep = np.ones(len(raw), bool)
        for s in own:
            a, n = s["start"], s["n_words"]
            if a < len(starts):
                keep[starts[a] : ends[min(a + n, len(ends)) - 1]] = False
        return raw[keep].tobytes()

    def run(batches):
        for b in batches:
            texts, spans_ = b.column(text_col).to_pylist(), b.column(held).to_pylist()
            new = [t if t is None or not s else cut(t.encode(), s).decode() for t, s in zip(texts, spans_)]
            at = b.schema.get_field_index(text_col)
            yield pa.RecordBatch.from_arrays([pa.array(new, c.type) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    clean = joined.where(F.col(held).isNull()).drop(held)
    return clean.unionByName(joined.where(F.col(held).isNotNull()).mapInArrow(common.tidy(run), schema).drop(held).select(*clean.columns))
