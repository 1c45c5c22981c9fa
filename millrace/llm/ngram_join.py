"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), op3.

Two texts link when the Jaccard similarity of their sets of distinct word shingles reaches the
threshold. The plan:

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one class, named by a fingerprint.
2. Hashes go, packed in blobs, to buckets by hash; a bucket counts in how many classes each occurs.
   A hash of one class can't help a pair, so only shared ones go back to their classes.
3. A class whose rare prefix (rarest first, the first n - ceil(t n) + 1) holds shared hashes is a
   candidate. Prefix hashes in common make coarse groups, a superset of the wanted components.
   A hash first joins the classes that lie together, so a frequent one is an entry a bucket of classes.
4. Inside a group an inverted index over the shared hashes is searched with DivideSkip: the short
   lists are heap-merged, the long ones binary-probed, and a class is kept when its count reaches
   the overlap that the threshold asks of the two sizes. The count is the exact intersection.
5. A group over ``block`` classes is first split by size: sizes of a linked pair differ by a factor of
   1 / t at most, so they meet in one of the overlapping windows of two such steps. A window that is still
   over ``block`` is searched in blocks, each together with a few pivots of the window; if that doesn't
   join the whole of it, what is outside its largest component is searched against every block.
   No pair that could add a link to the components is skipped.

Buckets follow the number of shingles in the table (``per_bucket``), in two rounds of dealing where they need over
``round_bits`` bits (8 at least), so a task holds about as much whatever the table's size. Sums by a key and look-ups treat hubs apart.

Null and empty texts have an empty set and link with nothing. An empty table gives an empty result. A very
long text is one set like any other, hashed piece by piece. Repeated rows and exact copies share a
class. A null doc_id gets a null component. Other columns of the input are ignored.

Identity: words of up to 15 bytes are told apart exactly, longer ones by 120-bit digests. Shingles have 64
bits: two texts of n shingles are counted wrongly with a chance of n^2 / 2^64. Classes are told apart by 128
bits; the 64 that travel are made unique, by new keys for classes that clash (``fp_bits`` fewer make more of them).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Forest, Scratch, components, hub_join, least_of_hub, look_up, mix, parts, read, start_task, text_chunks, tidy, words


# ---------------------------------------------------------------- sets


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set sizes, concatenated sorted sets) for runs of rows."""
    seeds = [np.uint64(pow(0x9E3779B97F4A7C15, j + 2, 1 << 64)) for j in range(n)]
    for lo, hi, data, offsets in text_chunks(column):
        starts, _, h = words(data, offsets)
        cut = np.searchsorted(starts, offsets)
        grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for j in range(n):
            grams += h[j : j + len(grams)] * seeds[j]
        grams = mix(grams)
        sets = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                if len(s) > 1:
                    s = s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                s = mix((h[a:b] * np.array(seeds[: b - a])).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                s = h[:0]
            sets.append(s)
        yield lo, np.array([len(s) for s in sets]), np.concatenate(sets)


def fingerprints(sizes: np.ndarray, sets: np.ndarray, seed: int) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(mix(sets + np.uint64(seed)), dtype=np.uint64))
    cut = np.append(0, np.cumsum(sizes))
    return mix(total[cut[1:]] - total[cut[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def _short(size: np.ndarray, sets: np.ndarray, bits: int) -> np.ndarray:
    return fingerprints(size, sets, 1) & np.int64((1 << bits) - 1 if bits < 64 else -1)


def _class_rows(n: int, fp_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        for batch in batches:
            sizes, one, two = [], [], []
            for _, size, sets in shingle_sets(batch.column(1), n):
                sizes.append(size)
                one.append(_short(size, sets, fp_bits))
                two.append(fingerprints(size, sets, 2))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two))], ["doc_id", "n", "fp", "fp2"])
        tidy()

    return run


# ---------------------------------------------------------------- document frequency


def _pack(tok: np.ndarray) -> bytes:
    return np.ascontiguousarray(tok.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(blob: bytes, bucket: int, bits: int) -> np.ndarray:
    """Whole hashes of a bucket, which tells their top byte."""
    out = np.zeros((len(blob) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    out[:, 7] = bucket >> (bits - 8)
    return out.view("<u8").reshape(-1)


def _runs(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


DEALT = "bucket int, fps binary, sizes binary, large binary, counts binary, tok binary"


class _Dealer:
    """Gathers (class, its hashes) and gives rows of DEALT: a bucket's classes, how many of its hashes each has, and their low bits, class by class."""

    def __init__(self, bits: int, flush: int = 1 << 20):
        self.bits, self.flush = bits, flush
        self.clear()

    def clear(self) -> None:
        self.fps, self.sizes, self.counts, self.toks, self.held = [], [], [], [], 0

    def add(self, fp: np.ndarray, size: np.ndarray, count: np.ndarray, tok: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``count`` hashes of each class, one class after another; size: of its whole set."""
        for own, x in ((self.fps, fp), (self.sizes, size), (self.counts, count), (self.toks, tok)):
            own.append(x)
        self.held += len(tok)
        if self.held >= self.flush:
            yield self.out()

    def out(self) -> pa.RecordBatch:
        fp, size, count, tok = (np.concatenate(x) for x in (self.fps, self.sizes, self.counts, self.toks))
        self.clear()
        bucket = (tok >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        doc = np.repeat(np.arange(len(fp), dtype=np.int64), count)[order]
        tok, bucket = tok[order], bucket[order]
        cut = _runs(bucket)
        rows = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first = _runs(doc[a:b])
            used = doc[a:b][first[:-1]]
            rows.append((int(bucket[a]), fp[used].tobytes(), _pack_numbers(size[used]), _large(size[used]), _pack_numbers(np.diff(first)) + _large(np.diff(first)), _pack(tok[a:b])))
        names = ["bucket", "fps", "sizes", "large", "counts", "tok"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if not k else pa.binary()) for k in range(6)], names)


def _pack_numbers(n: np.ndarray) -> bytes:
    """Numbers as 16 bits, low bytes first and high bytes after them, which Spark then compresses; larger ones lie in ``_large``."""
    return np.minimum(n, 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _large(n: np.ndarray) -> bytes:
    return n[n >= 0xFFFF].astype("<u4").tobytes()


def _numbers(blob: bytes, large: bytes) -> np.ndarray:
    n = np.frombuffer(blob, np.uint8).reshape(2, -1).astype(np.int64)
    n = n[0] | n[1] << 8
    n[n == 0xFFFF] = np.frombuffer(large, "<u4")
    return n


def _counts(blob: bytes, classes: int) -> np.ndarray:
    return _numbers(blob[: 2 * classes], blob[2 * classes :])


def _by_bucket(n: int, bits: int, fp_bits: int, renamed: dict[tuple[int, int], int]):
    """Texts to rows of DEALT. ``renamed``: new keys of classes whose short keys clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task()
        dealer, clashing = _Dealer(bits), np.array(sorted({a for a, _ in renamed}), np.int64)
        for batch in batches:
            for _, size, sets in shingle_sets(batch.column(0), n):
                fp = _short(size, sets, fp_bits)
                if len(clashing):
                    second = fingerprints(size, sets, 2)
                    for i in np.flatnonzero(np.isin(fp, clashing) & (size > 0)).tolist():
                        fp[i] = renamed[int(fp[i]), int(second[i])]
                some = size > 0
                yield from dealer.add(fp[some], size[some], size[some], sets)
        if dealer.held:
            yield dealer.out()
        tidy()

    return run


def _again(bits: int, more: int):
    """Rows of DEALT by ``bits`` to such by ``more`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(more)
        for batch in batches:
            for bucket, fps, sizes, large, counts, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fp = np.frombuffer(fps, np.int64)
                yield from dealer.add(fp, _numbers(sizes, large), _counts(counts, len(fp)), _unpack(blob, bucket, bits))
        if dealer.held:
            yield dealer.out()

    return run


def _split(key: np.ndarray, bits: int, columns: list[np.ndarray], names: list[str]) -> pd.DataFrame:
    """One row of blobs for each bucket of key."""
    bucket = (mix(key.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    order = np.argsort(bucket, kind="stable")
    cut = _runs(bucket[order])
    rows = [(int(bucket[order[a]]), *(c[order[a:b]].tobytes() for c in columns)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame(rows, columns=["bucket", *names])


def _split_again(bits: int, kinds: dict[str, str], flush: int = 1 << 18):
    """Rows of blobs by the first of ``kinds``, dealt again by more bits of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            columns = [np.concatenate([np.frombuffer(x, k) for f in held for x in f[name]]) for name, k in kinds.items()]
            return _split(columns[0], bits, columns, list(kinds))

        for frame in frames:
            held.append(frame)
            n += frame[next(iter(kinds))].map(len).sum() // 8
            if n >= flush:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


CLASSES = {"fp": "<u8", "n": "<i4", "tok": "<u8", "df": "<u4"}


def _shared(bits: int, class_bits: int):
    """Of a bucket's hashes, those of two classes or more, dealt out by class."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        fps = [np.frombuffer(x, np.uint64) for x in rows["fps"]]
        every, code = np.unique(np.concatenate(fps), return_inverse=True)
        size = np.zeros(len(every), np.int32)
        size[code] = np.concatenate([_numbers(a, b) for a, b in zip(rows["sizes"], rows["large"], strict=True)])
        cls = np.repeat(code, np.concatenate([_counts(x, len(f)) for x, f in zip(rows["counts"], fps, strict=True)]))
        tok = np.concatenate([_unpack(x, int(key[0]), bits) for x in rows["tok"]])
        order = np.argsort(tok)
        tok, cls = tok[order], cls[order]
        count = np.diff(_runs(tok))
        often = np.repeat(count, count) > 1  # most occur once
        tok, cls = tok[often], cls[often]
        order = np.lexsort((cls, tok))
        tok, cls = tok[order], cls[order]
        new = np.append(True, (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1]))[: len(tok)]
        tok, cls = tok[new], cls[new]
        cut = _runs(tok)
        df = np.repeat(np.diff(cut), np.diff(cut))
        keep = df > 1
        tok, cls, df = tok[keep], cls[keep], df[keep].astype("<u4")
        return _split(every[cls], class_bits, [every[cls], size[cls], tok, df], list(CLASSES))

    return run


def need(a, b, percent: int):
    """Least intersection of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges."""
    if not len(a):
        return a, b
    ids, code = np.unique(np.stack([a, b], 1), return_inverse=True)
    pairs, forest = np.unique(code.reshape(-1, 2), axis=0), Forest(len(ids))
    kept = [i for i, (x, y) in enumerate(pairs.tolist()) if forest.join(x, y)]
    return ids[pairs[kept, 0]], ids[pairs[kept, 1]]


def _stars_of(tok: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges that join the classes of a hash, and every hash with the smallest of its classes."""
    order = np.lexsort((cls, tok))
    tok, cls = tok[order], cls[order]
    cut = _runs(tok)
    first = np.repeat(cls[cut[:-1]], np.diff(cut))
    a, b = _forest(first[first != cls], cls[first != cls])
    return a, b, tok[cut[:-1]], cls[cut[:-1]]


def _prefixes(percent: int, bits: int):
    """Candidate classes with their shared hashes (bucket -1), coarse edges (-2), and a class of every prefix hash, dealt out by hash."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        fp, n, tok, df = (np.concatenate([np.frombuffer(x, kind) for x in rows[name]]) for name, kind in CLASSES.items())
        order = np.lexsort((tok, df, fp))
        fp, n, tok, df = fp[order], n[order].astype(np.int64), tok[order], df[order]
        cut = _runs(fp)
        count = np.diff(cut)
        size = n[cut[:-1]]
        take = size - -(-percent * size // 100) + 1 - (size - count)
        place = np.arange(len(fp)) - np.repeat(cut[:-1], count)
        pick = place < np.repeat(take, count)
        a, b, tokens, first = _stars_of(tok[pick], fp[pick].view(np.int64))
        out = _split(tokens, bits, [tokens, first], ["tok", "cls"]).assign(fp=0, n=0)
        edges = pd.DataFrame({"bucket": [-2], "tok": [a.tobytes()], "cls": [b.tobytes()], "fp": [0], "n": [0]})
        found = [(fp[a], size[i], np.sort(tok[a:b]).tobytes()) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if take[i] > 0]
        cand = pd.DataFrame({"fp": np.array([x[0] for x in found], np.uint64).view(np.int64), "n": [int(x[1]) for x in found], "tok": [x[2] for x in found]})
        return pd.concat([out, edges, cand.assign(bucket=-1, cls=b"")])[["bucket", "fp", "n", "tok", "cls"]].astype({"bucket": "int32", "fp": "int64", "n": "int64"})

    return run


def _stars(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Coarse edges between classes of one prefix hash that lay apart."""
    tok, cls = (np.concatenate([np.frombuffer(x, kind) for x in rows[name]]) for name, kind in (("tok", np.uint64), ("cls", np.int64)))
    a, b, _, _ = _stars_of(tok, cls)
    return pd.DataFrame({"a": a, "b": b})


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], ["a", "b"])


# ---------------------------------------------------------------- T-occurrence search


def divide_skip(lists: list[list[int]], t: int, mu: float = 0.03) -> list[tuple[int, int]]:
    """Ids that occur in at least ``t`` of the sorted ``lists``, with their counts.

    DivideSkip: the longest lists are set aside and binary-probed; the short ones are merged on a
    heap that skips ahead (MergeSkip) with the threshold less the number of long lists.
    """
    if t < 1 or len(lists) < t:
        return []
    lists = sorted(lists, key=len)
    from math import log2

    longest = len(lists[-1])
    far = min(t - 1, int(t / (mu * log2(max(2, longest)) + 1)))
    short, long = lists[: len(lists) - far], lists[len(lists) - far :]
    t_short, found = t - far, []
    heap = [(x[0], i) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= t_short:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= t_short:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < t:
                    break
                p = bisect_left(x, top)
                count += p < len(x) and x[p] == top
            if count >= t:
                found.append((top, count))
            for i in popped:
                at[i] += 1
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
        else:
            while heap and len(popped) < t_short - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            ahead = heap[0][0]
            for i in popped:
                at[i] = bisect_left(short[i], ahead, at[i])
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
    return found


def search(sizes: list[int], toks: list[np.ndarray], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Linked pairs that join the components of the classes, as a spanning forest.

    Each query is searched against all classes before it in order of size; what lies in its component
    already is left out, as that link would change nothing.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    rank = {i: r for r, i in enumerate(order)}
    size = [sizes[i] for i in order]
    flat, owner = np.concatenate([toks[i] for i in order]), np.repeat(np.arange(len(order)), [len(toks[i]) for i in order])
    by = np.lexsort((owner, flat))
    flat, owner = flat[by], owner[by]
    cut = _runs(flat)
    inverse = np.empty(len(by), np.int64)
    inverse[by] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    lists = [owner[a:b].tolist() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    place = np.append(0, np.cumsum([len(toks[i]) for i in order])).tolist()
    forest, links = Forest(len(order)), []
    asked = {rank[i] for i in queries}
    for q in sorted(asked):
        least = bisect_left(size, -(-percent * size[q] // 100))
        most = bisect_left(size, 100 * size[q] // percent + 1) if len(asked) < len(order) else q
        mine = [lists[k] for k in inverse[place[q] : place[q + 1]].tolist() if len(lists[k]) > 1]
        cut_lists = [y for y in (x[bisect_left(x, least) : bisect_left(x, most)] for x in mine) if y]
        for other, count in divide_skip(cut_lists, need(size[q], size[least], percent)) if least < most else ():
            if other != q and count >= need(size[q], size[other], percent) and forest.join(q, other):
                links.append((order[q], order[other]))
    return links


def _search_group(percent: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("fp")
        fp = rows["fp"].to_numpy()
        links = search(rows["n"].tolist(), [np.frombuffer(x, np.uint64) for x in rows["tok"]], np.flatnonzero(rows["asked"].to_numpy()).tolist(), percent)
        return pd.DataFrame({"a": [fp[i] for i, _ in links], "b": [fp[j] for _, j in links]}, columns=["a", "b"]).astype("int64")

    return run


# ---------------------------------------------------------------- the operator


def _new_keys(classes: DataFrame) -> dict[tuple[int, int], int]:
    """Unique keys for classes whose short keys clash though their 128 bits differ: about classes^2 / 2^65 of them."""
    clash = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp")
    found = sorted(map(tuple, classes.join(clash, "fp").select("fp", "fp2").collect()))
    salt = 0
    while found:
        salt += 1
        keys = mix(np.array([x[1] for x in found], np.int64).view(np.uint64) + np.uint64(salt)).view(np.int64).tolist()
        if len(set(keys)) == len(keys) and classes.where(F.col("fp").isin(keys)).isEmpty():
            return dict(zip(found, keys, strict=True))
    return {}


def _bits(items: int, each: int, least: int) -> int:
    return max(least, (max(1, items // each) - 1).bit_length())


def _grouped(df: DataFrame, tasks: int, *keys: str):
    """Groups in about ``tasks`` tasks, where that is more than Spark's own number."""
    return (df.repartition(tasks, *keys) if tasks > parts(df.sparkSession) else df).groupBy(*keys)


def _windows(member: DataFrame, scratch: Scratch, percent: int, block: int) -> DataFrame:
    """``member(fp, n, component)`` with ``m``, the size of its group; groups over ``block`` are split in windows of size."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        df = scratch.save(df, name)
        return hub_join(df, "component", df.groupBy("component").agg(F.count(F.lit(1)).alias("m")))

    member = scratch.save(counted(member, "members"), "counted")
    large = member.where(F.col("m") > block)
    if large.isEmpty():
        return member
    step = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))) if percent < 100 else F.col("n")
    both = F.explode(F.array(step, step + 1)) if percent < 100 else F.explode(F.array(step))
    split = large.drop("m").withColumn("w", both).withColumn("component", F.xxhash64("component", "w")).drop("w")
    return member.where(F.col("m") <= block).unionByName(counted(split, "windows"))


def ngram_join(docs: DataFrame, scratch: Scratch, *, n: int = 5, percent: int = 80, block: int = 128, pivots: int = 8, per_bucket: int = 1 << 20, round_bits: int = 13, fp_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_size (rows with the same set) for every row of ``docs(doc_id, text)``."""
    texts = docs.select("doc_id", "text")
    rows = scratch.save(texts.mapInArrow(_class_rows(n, fp_bits), "doc_id bigint, n bigint, fp bigint, fp2 bigint"), "sets", batch=TEXT_ROWS)
    classes = scratch.save(rows.where("n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size")), "classes")
    renamed = _new_keys(classes)
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits, class_bits = _bits(total, per_bucket, 8), _bits(total, 4 * per_bucket, 6)
    tasks, class_tasks = total // per_bucket, total // (2 * per_bucket)

    dealt = docs.select("text").where("text is not null").mapInArrow(_by_bucket(n, min(bits, round_bits), fp_bits, renamed), DEALT)
    if bits > round_bits:
        dealt = dealt.repartition(1 << round_bits, "bucket").mapInArrow(_again(round_bits, bits), DEALT)
    shared = _grouped(dealt, tasks, "bucket").applyInPandas(_shared(bits, min(class_bits, round_bits)), "bucket int, fp binary, n binary, tok binary, df binary")
    if class_bits > round_bits:
        shared = shared.repartition(1 << round_bits, "bucket").mapInPandas(_split_again(class_bits, CLASSES), shared.schema)
    mixed = scratch.save(_grouped(shared, class_tasks, "bucket").applyInPandas(_prefixes(percent, min(class_bits, round_bits)), "bucket int, fp bigint, n bigint, tok binary, cls binary"), "prefixes", batch=TEXT_ROWS)
    cand = mixed.where("bucket = -1").select("fp", "n", "tok")
    prefix = mixed.where("bucket >= 0").select("bucket", "tok", "cls")
    if class_bits > round_bits:
        prefix = prefix.repartition(1 << round_bits, "bucket").mapInPandas(_split_again(class_bits, {"tok": "<u8", "cls": "<i8"}), prefix.schema)
    stars = _grouped(prefix, class_tasks // 8, "bucket").applyInPandas(_stars, "a bigint, b bigint")
    coarse = components(scratch, stars.unionByName(mixed.where("bucket = -2").select("tok", "cls").mapInArrow(_edges, "a bigint, b bigint")))

    member = _windows(cand.select("fp", "n").join(coarse.withColumnRenamed("id", "fp"), "fp"), scratch, percent, block)
    member = scratch.save(member.join(cand.select("fp", "tok"), "fp").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "parts")
    pair = "a bigint, b bigint"
    asked = member.withColumn("asked", F.lit(True))
    leads = member.where("blocks > 1").groupBy("component", "part").agg(F.min("fp").alias("fp")).where(F.col("part") < pivots).select("component", "fp")
    lead = member.join(leads, ["component", "fp"]).withColumn("asked", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["component", "part"]
    use = [*keys, "fp", "n", "tok", "asked"]
    tasks = member.count() // 4 // block
    links = scratch.save(_grouped(asked.select(use).unionByName(lead.select(use)), tasks, *keys).applyInPandas(_search_group(percent), pair), "links")

    large = member.where("blocks > 1")
    if not large.isEmpty():
        joined = components(scratch, links).select(F.col("id").alias("fp"), F.col("component").alias("inner"))
        now = scratch.save(large.join(joined, "fp", "left").withColumn("inner", F.coalesce("inner", "fp")), "inner")
        sizes = now.groupBy("component", "inner").agg(F.count(F.lit(1)).alias("c"))
        main = scratch.save(sizes.groupBy("component").agg(F.max_by("inner", F.struct("c", "inner")).alias("main")), "main")
        rest = scratch.save(hub_join(now, "component", main).where("inner <> main").withColumn("chunk", F.col("part")), "rest")
        ask = rest.withColumn("asked", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        chunks = rest.select("component", "chunk").distinct().groupBy("component").agg(F.collect_set("chunk").alias("chunks"))
        told = hub_join(now, "component", chunks).withColumn("chunk", F.explode("chunks")).withColumn("asked", F.lit(False))
        keys = ["component", "part", "chunk"]
        use = [*keys, "fp", "n", "tok", "asked"]
        both = ask.select(use).unionByName(told.select(use)).groupBy(*keys, "fp").agg(F.max("n").alias("n"), F.first("tok").alias("tok"), F.max("asked").alias("asked"))
        links = links.unionByName(_grouped(both, tasks, *keys).applyInPandas(_search_group(percent), pair))

    key = F.col("fp")
    if renamed:
        new = docs.sparkSession.createDataFrame([(a, b, k) for (a, b), k in renamed.items()], "fp bigint, fp2 bigint, new bigint")
        classes, key = classes.join(new, ["fp", "fp2"], "left"), F.coalesce("new", "fp")
    classes = classes.select("*", key.alias("id"))
    found = components(scratch, scratch.save(links, "all-links"))
    inside = scratch.save(classes.select("id", "rep").join(found, "id"), "inside")
    least = scratch.save(inside.groupBy("component").agg(F.min("rep").alias("smallest")), "smallest")
    named = hub_join(inside, "component", least).select("id", "smallest")
    labelled = scratch.save(classes.join(named, "id", "left").select("fp", "fp2", "class_size", F.coalesce("smallest", "rep").alias("component")), "labelled")
    scratch.drop_but(rows, labelled)
    hot = labelled.where(F.col("class_size") > least_of_hub(rows.count()))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")
    some = look_up(rows.where("n > 0"), ["fp", "fp2"], labelled, hot).select("doc_id", "n", own, "class_size")
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"), F.lit(1).cast("long").alias("class_size"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_size")


def deduplicate(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows of one doc_id stay or go together, and repeated rows become one. Rows of null doc_id stay, one for each text.
    """
    found = ngram_join(docs, scratch, **options)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    own = docs.where("doc_id is not null").join(keep, docs["doc_id"] == keep["_kept"], "left_semi")
    return own.unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"), Scratch(spark, "op3"))


ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
reach AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.c WHERE 100 * pairs.c >= 80 * (pairs.n - pairs.c)),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(g) AS n_shingles, component_id, CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(g)) END AS class_size FROM s JOIN least ON least.id = s.doc_id"""
