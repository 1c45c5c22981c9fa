"""Best-fit packing with swap-based local search, op5.

Texts become pieces of at most ``capacity`` ids. All pieces of the table are packed best-fit decreasing
at once: how many bins of which room there are hangs on the counts of sizes alone, at most ``capacity``
numbers, so the driver packs counts and a piece finds its bin by its rank among pieces of its size.
Bins with room are then dealt by hash to groups of about ``group`` pieces and improved by local search:
moving one piece, exchanging one for one or two for one between underfull bins whenever that raises the
sum of squared fills, until bins empty or nothing helps. Every group hands its ``hand_up`` emptiest bins
to a coarser group, until one group is left; other bins are exchanged inside their group only. The search
is left out when all bins together have less room than one holds, as it can save none then. No step
adds a bin, so there are never more than best-fit decreasing of the whole table needs.

A null text is empty and takes the closing id alone. A very long text is cut into pieces like any longer than
``capacity``. An empty table gives an empty result. Repeated rows are packed as often as they occur.
A null doc_id is a value like any other. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Scratch, read, start_task, text_chunks, tidy
from .tokens import encode

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def _ranks(length: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each piece among pieces of its length, ``seen[length]`` of which came before; and the new ``seen``."""
    order = np.argsort(length, kind="stable")
    count = np.bincount(length, minlength=len(seen))
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count - seen, count)
    return rank, seen + count


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task("tokens")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, cut = encode(path, data, offsets, end_id)
                size = np.diff(cut)
                count = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                begin, raw = cut[row] + start, memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                rank, seen = _ranks(length, seen)
                yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        tidy()

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of indices. A bit mask tells which room is on offer."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        free = mask >> s
        if free:
            r = s + (free & -free).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            r -= s
        else:
            b, r = len(bins), capacity - s
            bins.append([i])
        if r:
            room[r].append(b)
            mask |= 1 << r
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of best-fit decreasing, from how many pieces each size has.

    Pieces of a size fill the tightest bin as often as they fit, then the next one, so that bins of equal
    room are filled in runs: rows (size, first rank, first bin, pieces a bin, offset), by size and rank.
    The second table has ranges of bins with equal room: rows (first bin, room, number of bins), by bin.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    mask, bins, runs = 0, 0, []
    for s in sorted(counts, reverse=True):
        left, rank = counts[s], 0
        while left:
            free = mask >> s
            if free:
                r = s + (free & -free).bit_length() - 1
                first, n = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
            else:
                r, first, n = capacity, bins, -(-left // (capacity // s))
                bins += n
            whole = min(n, left // (r // s))
            rest = left - whole * (r // s) if whole < n else 0
            for m, each in ((whole, r // s), (1, rest)):
                if m and each:
                    runs.append((s, rank, first, each, capacity - r))
                    room[r - each * s].append((first, m))
                    mask |= 1 << r - each * s
                    first, n, rank, left = first + m, n - m, rank + m * each, left - m * each
            if n:
                room[r].append((first, n))
                mask |= 1 << r
    ranges = sorted((first, r, n) for r, x in enumerate(room) for first, n in x)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), np.array(ranges, np.int64).reshape(-1, 3)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        runs, ranges = shared.value
        keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            x = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - x[:, 1]
            k = x[:, 2] + at // x[:, 3]
            full = ranges[np.searchsorted(ranges[:, 0], k, "right") - 1, 1] == 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.zeros(len(k), np.int64)), pa.array(k), pa.array(x[:, 4] + at % x[:, 3] * length), pa.array(~full)], [*batch.schema.names[:5], "g", "sequence_id", "offset", "up"])
        tidy()

    return run


def _choices(pieces: list[int], sizes: list[int]) -> tuple[list, list]:
    """One piece of each size of a bin, and one pair of each two sizes. Equal sizes are as good as each other, so full bins of short texts have few."""
    by_size: dict[int, list[int]] = {}
    for i in pieces:
        by_size.setdefault(sizes[i], []).append(i)
    one = [(s, (x[0],)) for s, x in by_size.items()]
    two = [(s + t, (*i, *j)) for k, (s, i) in enumerate(one) for t, j in one[:k]]
    return one, two + [(2 * s, (x[0], x[1])) for s, x in by_size.items() if len(x) > 1]


def _gain(low: list[int], high: list[int], sizes: list[int], gap: int) -> tuple[int, tuple, tuple]:
    """Most ids that a move or exchange brings from ``low`` into ``high`` within ``gap``."""
    best = (0, (), ())
    into, pairs = _choices(low, sizes)
    out, two = _choices(high, sizes)
    for give, take in ((into, [(0, ()), *out]), (pairs, out), (into, two)):
        if best[0] == gap:
            break
        take = sorted(take)
        for s, x in give:
            # the smallest exchange that still fits brings most
            lo, hi = 0, len(take)
            while lo < hi:
                mid = (lo + hi) // 2
                if s - take[mid][0] <= gap:
                    hi = mid
                else:
                    lo = mid + 1
            if lo < len(take) and (d := s - take[lo][0]) > best[0]:
                best = (d, x, take[lo][1])
    return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search from the emptiest bins up, with every other underfull bin that is at least as full as partner."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    changed = True
    while changed:  # every change raises the sum of squared fills, so this ends
        changed = False
        open_bins = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (fill[k], k))
        for low in open_bins:
            while bins[low] and fill[low] < capacity:
                best = (0, (), (), -1)
                for k in sorted((k for k in open_bins if k != low and fill[low] <= fill[k] < capacity and bins[k]), key=lambda k: (fill[k], k)):
                    if capacity - fill[k] <= best[0]:  # this and all fuller bins have no room for more
                        break
                    found = _gain(bins[low], bins[k], sizes, capacity - fill[k])
                    if found[0] > best[0]:
                        best = (*found, k)
                if not best[0]:
                    break
                d, give, take, k = best
                bins[low] = [i for i in bins[low] if i not in give] + list(take)
                bins[k] = [i for i in bins[k] if i not in take] + list(give)
                fill[low] -= d
                fill[k] += d
                changed = True
    return [b for b in bins if b]


def _pack(level: int, capacity: int, hand_up: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table.column("length").to_pylist()
        _, held = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
        bins: list[list[int]] = [[] for _ in range(held.max() + 1)]
        for i, k in enumerate(held.tolist()):
            bins[k].append(i)
        bins = improve(min(bins, best_fit(sizes, capacity), key=len), sizes, capacity)
        sequence, offset, up = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        fills = [sum(sizes[i] for i in b) for b in bins]
        emptiest = set(sorted((k for k in range(len(bins)) if fills[k] < capacity), key=lambda k: fills[k])[:hand_up])
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i], up[i] = level << 57 | key[0].as_py() << 24 | k, at, k in emptiest
                at += sizes[i]
        for name, column in (("sequence_id", sequence), ("offset", offset), ("up", up)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(column))
        return table

    return run


def pack(docs: DataFrame, scratch: Scratch, *, path: str, capacity: int = 2048, end_id: int = 0, group: int = 2000, fan_in: int = 64, hand_up: int = 2) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their sequence and their place in it."""
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), PIECES), "pieces", batch=TEXT_ROWS)
    count = scratch.save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = count.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    plan = best_fit_counts({r["length"]: r["n"] for r in count.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = pieces.join(earlier.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("earlier")).select(pieces.columns)
    schema = PIECES.removesuffix(", part int, rank bigint") + ", g bigint, sequence_id bigint, offset bigint, up boolean"
    packed = scratch.save(ranked.mapInArrow(_place(docs.sparkSession.sparkContext.broadcast(plan)), schema), "packed")
    scratch.drop_but(packed)
    if (plan[1][:, 1] * plan[1][:, 2]).sum() < capacity:  # less room in all bins than one holds: no search saves one
        return packed.drop("g", "up")
    done, level = [packed.where("not up")], 0
    groups = max(1, -(-packed.where("up").count() // group))
    now = packed.where("up").withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    while True:
        level += 1
        packed = scratch.save(now.repartition(min(groups, 10_000), "g").groupBy("g").applyInArrow(_pack(level, capacity, hand_up if groups > 1 else 0), now.schema), "packed")
        done.append(packed.where("not up"))
        if groups == 1:
            break
        now = packed.where("up").withColumn("g", F.floor(F.col("g") / fan_in))
        groups = -(-groups // fan_in)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("g", "up")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), Scratch(spark, "op5"), path=public_tokenizers.path("word_bpe_49k.json"))
