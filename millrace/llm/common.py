"""Shared parts of the training-data operators: scratch tables, vectorised word hashing, components."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_SHORT = 15
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A key is a hub when it holds more rows than both of these: this many, and one in _HUBS of all. So there are fewer than _HUBS hubs.
_FEW, _HUBS = 64, 2048
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that a task holds at a time.
TEXT_ROWS = 1000
#: What a worker keeps from task to task, by the kind of task that needs it.
kept: dict[str, dict] = {}


# ---------------------------------------------------------------- scratch tables


class Scratch:
    """Tables in the folder that all executors share (``spark.checkpoint.dir``).

    Writing a table cuts the lineage, so lost executors cost one stage at most. A folder of its own
    is made only where the setting is unset and Spark runs in one process, as in local tests.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n, self._held = 0, []

    def save(self, df: DataFrame, name: str = "t", batch: int | None = None) -> DataFrame:
        """``df``, stored. ``batch``: most rows that Python gets at a time meanwhile, for steps that read whole texts."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        was = self.spark.conf.get(_ARROW_ROWS)
        if batch and not 0 < int(was) <= batch:
            self.spark.conf.set(_ARROW_ROWS, batch)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_ARROW_ROWS, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        return out

    def drop_but(self, *tables: DataFrame) -> None:
        """Remove all tables but these, which what is returned still reads."""
        for t, path in self._held:
            if not any(t is k for k in tables):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._held = [(t, path) for t, path in self._held if any(t is k for k in tables)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in [c.lower() for c in df.columns]:
        name = "_" + name
    return name


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def start_task(*kinds: str) -> None:
    """At a task's start: lets go of what the worker has kept for other kinds of tasks than ``kinds``."""
    others = [k for k in kept if k not in kinds]
    for k in others:
        del kept[k]
    if others:
        tidy()


def tidy() -> None:
    """Gives what a task has freed back to the system; workers live on beside others."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own. Null: empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of concatenated texts."""
    blank = _BLANK[data]
    first = np.ones(len(data) + 1, bool)
    first[1:] = blank
    bounds = offsets[(offsets < len(data))]
    first[bounds] = True
    starts = np.flatnonzero(first[:-1] & ~blank)
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = blank
    stop[bounds] = True
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts.copy()


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Identity of spans as two 64-bit numbers; A-Z count as a-z if ``lower``.

    Up to 15 bytes are their own key, with their number in the top byte, so short words never collide.
    A longer span's key is a 120-bit BLAKE2 digest under a top byte that no length has.
    """
    size = ends - starts
    text = np.concatenate([_LOWER[data] if lower else data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    lo = eight[starts] & _KEEP[np.minimum(size, 8)]
    hi = eight[np.minimum(starts + 8, len(text) - 8)] & _KEEP[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    far = np.flatnonzero(size > _SHORT)
    if len(far):
        raw = memoryview(text)
        digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)])
        two = np.frombuffer(digests, "<u8").reshape(-1, 2)
        lo[far], hi[far] = two[:, 0], two[:, 1] | np.uint64(0xFF << 56)
    return lo, hi


def key_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of two-part keys."""
    return mix(mix(hi + np.uint64(0x9E3779B97F4A7C15)) + lo)


def factorize(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each key, and where each code first stands. Unlike keys of one hash are told apart."""
    code, distinct = pd.factorize(key_hash(lo, hi))
    first = first_places(code, len(distinct))
    if ((lo != lo[first[code]]) | (hi != hi[first[code]])).any():
        order = np.lexsort((hi, lo))
        new = np.append(True, (lo[order[1:]] != lo[order[:-1]]) | (hi[order[1:]] != hi[order[:-1]]))
        code = np.empty(len(lo), np.int64)
        code[order] = np.cumsum(new) - 1
        first = first_places(code, int(new.sum()))
    return code, first


def first_places(code: np.ndarray, n: int) -> np.ndarray:
    at = np.empty(n, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    return at


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of spans, in order of start; A-Z count as a-z if ``lower``."""
    return key_hash(*word_keys(data, starts, ends, lower))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of concatenated texts."""
    starts, ends = spans(data, offsets)
    return starts, ends, hash_spans(data, starts, ends, lower)


# ---------------------------------------------------------------- hubs and components


def least_of_hub(rows: int) -> int:
    return max(_FEW, rows // _HUBS)


def look_up(left: DataFrame, key: str | list[str], table: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left.join(table, key, how)`` for a table with one row a key. ``hot``: its rows for hubs, fewer than _HUBS, which meet by broadcast; no hub is shuffled. None: there are no hubs."""
    if hot is None or hot.isEmpty():
        return left.join(table, key, how)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.where("_hot is null").select(left.columns).join(table, key, how)
    return cold.unionByName(marked.where("_hot").drop("_hot"))


def look_up_all(left: DataFrame, key: str | list[str], table: DataFrame, hot: DataFrame) -> DataFrame:
    """``look_up`` that keeps rows without a match."""
    return look_up(left, key, table, hot, "left")


def hub_join(left: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``look_up`` with the hubs of ``left``, a stored table."""
    hubs = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least_of_hub(left.count())).select(key)
    return look_up(left, key, table, table.join(F.broadcast(hubs), key, "left_semi"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; component is the smallest id it reaches.

    Hash-min with contraction: each round points every node at the smallest of itself and its
    neighbours, follows the pointers once more, renames the edges and drops loops and repeats.
    Minima are partial aggregates; hubs (by degree, which bounds how many nodes point at one) are looked up by broadcast.
    """
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    chain: list[DataFrame] = []
    while n := e.count():
        least = least_of_hub(2 * n)
        both = e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
        m = scratch.save(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("m"), F.count(F.lit(1)).alias("degree")), "min")
        hubs = F.col("degree") > least
        some = not m.where(hubs).isEmpty()
        up = m.select(F.col("id").alias("m"), F.col("m").alias("top"), "degree")
        m = scratch.save(look_up(m, "m", up.drop("degree"), up.where(hubs).drop("degree") if some else None).select("id", F.col("top").alias("m"), "degree"), "jump")
        chain.append(m)
        for own in "ab":
            to = m.select(F.col("id").alias(own), F.col("m").alias("n" + own), "degree")
            e = look_up(e, own, to.drop("degree"), to.where(hubs).drop("degree") if some else None)
        e = scratch.save(e.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
    if not chain:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    out = chain[0].select("id", F.col("m").alias("component"))
    for m in chain[1:]:
        # a component without edges of its own keeps its name
        roots = out.select("component").distinct().join(m.select(F.col("id").alias("component"), "m"), "component", "left")
        step = scratch.save(roots.select("component", F.coalesce("m", "component").alias("next")), "step")
        out = scratch.save(hub_join(out, "component", step).select("id", F.col("next").alias("component")), "renamed")
    return out


class Forest:
    """Union-find over a bounded group; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
