"""Best-fit packing by linear grouping.

Only the counts of piece lengths (at most ``capacity`` different ones) reach the driver:

1. large lengths are sorted and split into groups of equal cardinality, each rounded up to its longest;
2. the few rounded sizes are arranged into configurations: again and again the best-filling pattern, by a
   bounded knapsack over what is left, is used as often as the counts allow;
3. the actual lengths take the rounded ones' places, which leaves each sequence its true gap;
4. small pieces, and large ones that no pattern took, go longest first into the smallest gap that fits.

The plan is a table of runs: "the pieces of length L ranked a to b among those of that length go to the
sequences s, s+1, ... at offset o". Ranks are counted per length and bucket, so that no length, however
common, meets in one task.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

SALTS = 64
#: Runs of a plan that are broadcast; of longer plans the runs are joined.
RUNS = 1_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every text's ids and ``end_id``, cut at ``capacity`` only.

    Null and empty texts are one piece of ``end_id`` alone. Repeated document ids give repeated pieces.
    """
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema = common.arrow_schema(ddl)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = tokens.encoder(tokenizer)
        for b in batches:
            out = {k: [] for k in schema.names}
            for k, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                raw = enc.encode(body.decode("utf-8", "replace")) + end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    out["doc_id"].append(k)
                    out["piece"].append(i)
                    out["start"].append(at // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
            yield common.emit(out, schema)

    return common.documents(docs, id_col, text_col).mapInArrow(common.tidy(run), ddl)


def _patterns(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size the best-filling pattern takes: bounded subset sum, as bit sets."""
    layers, reach = [], 1
    mask = (1 << (capacity + 1)) - 1
    for size, n in zip(sizes, left):
        layers.append(reach)
        n, step = min(n, capacity // size), 1
        while n > 0:  # so many copies, as powers of two
            take = min(step, n)
            reach |= reach << (take * size) & mask
            n -= take
            step *= 2
    at, used = reach.bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not layers[i] >> at & 1:
            used[i] += 1
            at -= sizes[i]
    return used


def grouped_plan(counts: dict[int, int], capacity: int, groups: int = 512, large: float = 1 / 8, full: float = 0.98) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(sequences, [(length, offset), ...]), ...]`` for pieces counted by length, all of at most ``capacity``."""
    todo = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in todo):
        raise ValueError("lengths must be from 1 to the capacity")
    bins: list[tuple[int, list[int]]] = []
    if capacity in todo:
        bins.append((todo.pop(capacity), [capacity]))
    big = sorted((n for n in todo if n > large * capacity), reverse=True)
    total = sum(todo[n] for n in big)
    runs: list[list[list[int]]] = []
    if total:
        size, room = -(-total // groups), 0
        for n in big:
            c = todo.pop(n)
            while c:
                if not room:
                    runs.append([])
                    room = size
                take = min(c, room)
                runs[-1].append([n, take])
                c, room = c - take, room - take
    sizes, left = [g[0][0] for g in runs], [sum(c for _, c in g) for g in runs]
    # sizes of neighbouring groups can agree; each group keeps its own place in the pattern
    for top in range(len(sizes)):
        while left[top]:  # the longest that is left leads, with what fills its sequence best
            rest = [0] * top + left[top:]
            rest[top] -= 1
            used = _patterns(sizes, rest, capacity - sizes[top])
            used[top] += 1
            if sum(u * s for u, s in zip(used, sizes)) < full * capacity:
                break
            times = min(n // u for n, u in zip(left, used) if u)
            for i, u in enumerate(used):
                left[i] -= u * times
            while times:
                heads = [(i, runs[i][0]) for i, u in enumerate(used) if u]
                same = min(h[1] // used[i] for i, h in heads)
                own, step = [], min(same, times) or 1
                for i, u in enumerate(used):
                    for _ in range(u):
                        run = runs[i][0]
                        own.append(run[0])
                        run[1] -= step
                        if not run[1]:
                            runs[i].pop(0)
                bins.append((step, own))
                times -= step
    for n, c in (x for g in runs for x in g):
        todo[n] = todo.get(n, 0) + c
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    keys: list[int] = []

    def add(n: int, own: list[int]) -> None:
        gap = capacity - sum(own)
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(keys, gap)
        gaps[gap].append((n, own))

    for n, own in bins:
        add(n, own)
    for n in sorted(todo, reverse=True):
        c = todo[n]
        while c:
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                per = min(capacity // n, c)
                add(c // per, [n] * per)
                c %= per
                continue
            gap = keys[at]
            times, own = gaps[gap].pop()
            per = min(gap // n, c)
            step = min(times, c // per)
            if times > step:
                gaps[gap].append((times - step, own))
            if not gaps[gap]:
                del gaps[gap]
                keys.pop(at)
            add(step, own + [n] * per)
            c -= step * per
    out = []
    for times, own in (x for k in keys for x in gaps[k]):
        ends = np.cumsum(own)
        out.append((times, [(n, int(e) - n) for n, e in zip(own, ends)]))
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan with the fewest sequences among fine, coarse and no grouping of the large lengths."""
    tried = [grouped_plan(counts, capacity), grouped_plan(counts, capacity, 64), grouped_plan(counts, capacity, large=1.0)]
    return min(tried, key=lambda p: sum(times for times, _ in p))


def pack(items: DataFrame, capacity: int, id_cols: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: as few sequences of at most ``capacity`` as the plan finds.

    ``items`` must be a stored table (it is read twice). Ties between equal lengths go by ``id_cols``.
    Lengths over the capacity, null or below 1 raise ValueError.
    """
    spark = items.sparkSession
    name = lambda wanted: common.unused_name(items, wanted)
    salt, rank, low, high = name("_salt"), name("_rank"), name("_low"), name("_high")
    salted = items.withColumn(salt, F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy(F.col(length).alias("n"), F.col(salt).alias("s")).agg(F.count("*").alias("c"))
    # at most capacity x SALTS rows
    rows = sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in cells.collect())
    counts: dict[int, int] = {}
    first = []
    for n, s, c in rows:
        first.append((n, s, counts.get(n, 0)))
        counts[n] = counts.get(n, 0) + c
    runs, seq, taken = [], 0, {}
    for times, own in plan(counts, capacity):
        for n, offset in own:
            at = taken.get(n, 0)
            runs.append((n, at, seq, offset, times))
            taken[n] = at + times
        seq += times
    ranks = spark.createDataFrame(first or [(0, 0, 0)], "n long, s int, b long").toDF(low, salt, high)
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy(length, salt).orderBy(*id_cols)) - 1)
    # at most capacity x SALTS rows
    ranked = ranked.join(F.broadcast(ranks), (F.col(length) == F.col(low)) & (ranked[salt] == ranks[salt]))
    ranked = ranked.select(*items.columns, (F.col(high) + F.col(rank)).alias(rank))
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if len(runs) > RUNS:
        return _placed_by_join(ranked, runs, items.columns, length, rank)
    by_length: dict[int, tuple[list, list, list]] = {}
    for n, at, s, offset, _ in runs:
        a, b, c = by_length.setdefault(n, ([], [], []))
        a.append(at)
        b.append(s - at)
        c.append(offset)
    # RUNS x 24 bytes at most
    lookup = spark.sparkContext.broadcast({n: tuple(np.array(x, np.int64) for x in v) for n, v in by_length.items()})
    import pyarrow as pa

    def run(batches):
        table = lookup.value
        for b in batches:
            own, place = b.column(length).to_numpy(zero_copy_only=False), b.column(rank).to_numpy(zero_copy_only=False)
            seqs, offsets = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[order], prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(order)]):
                at = order[a:z]
                starts, shift, offset = table[int(own[at[0]])]
                k = np.searchsorted(starts, place[at], "right") - 1
                seqs[at], offsets[at] = place[at] + shift[k], offset[k]
            kept = [c for n, c in zip(b.schema.names, b.columns) if n != rank]
            names = [n for n in b.schema.names if n != rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seqs), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(common.tidy(run), schema)


def _placed_by_join(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]], columns: list[str], length: str, rank: str, stride: int = 4096) -> DataFrame:
    """``columns, sequence_id, offset`` of ranked pieces by a join with the plan's runs ``(length, from rank, sequence, offset, times)``.

    Ranks are cut into strides; a run is listed for each stride it reaches into, so the join is one of equal keys
    and each piece meets the runs of its stride only.
    """
    import pandas as pd

    spark = ranked.sparkSession
    plan_of = spark.createDataFrame(pd.DataFrame(runs, columns=["n", "at", "seq", "off", "times"]).astype("int64"))
    plan_of = plan_of.withColumn("stride", F.explode(F.sequence(F.floor(F.col("at") / stride), F.floor((F.col("at") + F.col("times") - 1) / stride))))
    own = ranked.withColumn("stride", F.floor(F.col(rank) / stride))
    inside = (own[length] == plan_of["n"]) & (own["stride"] == plan_of["stride"]) & (own[rank] >= plan_of["at"]) & (own[rank] < plan_of["at"] + plan_of["times"])
    out = own.join(plan_of, inside)
    return out.select(*(own[c] for c in columns), (plan_of["seq"] + own[rank] - plan_of["at"]).alias("sequence_id"), plan_of["off"].alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Whole texts to packed pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Every piece of every document is placed once; sequences are gapless from offset 0 and hold at most
    ``capacity`` ids. Null and empty texts have their ``end_id``; an empty table gives an empty result.
    """
    cut = common.materialise(pieces(docs, tokenizer, capacity, end_id, text_col, id_col), "pieces")
    return pack(cut, capacity)
