"""Stateful operators over event streams, and the batch replays that check them.

Columns of an event: key, ms (long), event_id, and what an operator names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and window; what comes later than ``late`` is left out and its state dropped."""
    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def dedup_stream(stream: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- folds


def fold_ema(rows: pd.DataFrame, mean: float | None, alpha: float) -> tuple[list[float], float | None]:
    out = []
    for v in rows["value"]:
        mean = v if mean is None else alpha * v + (1 - alpha) * mean
        out.append(mean)
    return out, mean


def fold_bucket(rows: pd.DataFrame, tokens: float, last: int | None, rate: float, burst: float) -> tuple[list[int], float, int | None]:
    """Token bucket: milliseconds to wait before each request; a request that waits takes its token when it is there."""
    out = []
    for ms in rows["ms"]:
        ms = int(ms)
        start = ms if last is None else max(ms, last)
        tokens = burst if last is None else min(burst, tokens + (start - last) / 1000 * rate)
        wait = 0 if tokens >= 1 else math.ceil((1 - tokens) * 1000 / rate)
        if wait:
            tokens = min(burst, tokens + wait / 1000 * rate)
        tokens -= 1
        last = start + wait
        out.append(last - ms)
    return out, tokens, last


def fold_hash(rows: pd.DataFrame, previous: str | None) -> tuple[list[str], str | None]:
    out = []
    for h in rows["hash"]:
        out.append("first-seen" if previous is None else "unchanged" if h == previous else "changed")
        previous = h
    return out, previous


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["ms", "event_id"], kind="stable")


def _replay(df: DataFrame, fold, schema: str) -> DataFrame:
    """A fold along each key in order: rows come sorted, batch after batch, and the state is carried on, so no key has to fit in memory.

    ``fold``: (rows of one key, state or None) to (values, state). Ordered folds don't combine in parts, so a key is read by one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, started = None, None, False
        for frame in frames:
            cut = [0, *(i + 1 for i in range(len(frame) - 1) if frame["key"].iat[i] != frame["key"].iat[i + 1]), len(frame)] if len(frame) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = frame.iloc[a:b]
                own = rows["key"].iat[0]
                if not started or own != key:
                    key, state, started = own, None, True
                out, state = fold(rows, state)
                yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "out": out})

    return df.repartition("key").sortWithinPartitions("key", "ms", "event_id").mapInPandas(run, schema)


def ema(df: DataFrame, alpha: float = 0.2) -> DataFrame:
    return _replay(df, lambda r, mean: fold_ema(r, mean, alpha), "key string, event_id bigint, out double")


def token_bucket(df: DataFrame, rate: float, burst: float) -> DataFrame:
    def fold(rows: pd.DataFrame, state):
        out, *state = fold_bucket(rows, *(state or (burst, None)), rate, burst)
        return out, state

    return _replay(df, fold, "key string, event_id bigint, out bigint")


def change_states(df: DataFrame) -> DataFrame:
    """The state of each event against the one before it of its key; no Python."""
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("ms", "event_id"))
    out = F.when(before.isNull(), "first-seen").when(before == F.col("hash"), "unchanged").otherwise("changed")
    return df.select("key", "event_id", out.alias("out"))


def autoscale(df: DataFrame, window: int = 20, low: int = 1, high: int = 20, step: int = 1, slow_ms: float = 2000, bad: float = 0.2) -> DataFrame:
    """Concurrency after each sample (value: latency, failed: 0, 1 or null): one step down when the last samples are slow or failing, else up.

    Means are plain double sums from the oldest sample to the newest, over their number; Python's ``sum`` compensates and rounds ties with a limit otherwise. NaN is slow; a null in ``failed`` isn't counted.
    """

    def fold(rows: pd.DataFrame, state):
        now, past = state or (low, np.empty((0, 2)))
        seen = np.concatenate([past, rows[["value", "failed"]].to_numpy("float64")])
        known = ~np.isnan(seen) | [True, False]
        total, n = np.zeros_like(seen), np.zeros_like(seen)
        for back in range(min(window, len(seen)) - 1, -1, -1):
            here = slice(0, len(seen) - back)
            total[back:] += np.where(known[here], seen[here], 0.0)
            n[back:] += known[here]
        mean = total[len(past) :] / np.maximum(n[len(past) :], 1)
        out = []
        for worse in ~(mean[:, 0] <= slow_ms) | (mean[:, 1] > bad):
            now = max(low, now - step) if worse else min(high, now + step)
            out.append(now)
        return out, (now, seen[max(0, len(seen) - window + 1) :])

    return _replay(df, fold, "key string, event_id bigint, out int")


def scores(df: DataFrame, start: int = 100, gain: int = 5, loss: int = 20) -> DataFrame:
    """Score of a key after each report (ok: boolean): a success gives ``gain``, a failure takes ``loss``, within 0 and 100."""

    def fold(rows: pd.DataFrame, now):
        now, out = start if now is None else now, []
        for ok in rows["ok"]:
            now = min(100, now + gain) if ok else max(0, now - loss)
            out.append(now)
        return out, now

    return _replay(df, fold, "key string, event_id bigint, out int")


# ---------------------------------------------------------------- the same folds over streams


def _timeout(ttl_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def stream_change_states(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """first-seen, unchanged or changed of each event (key, ms, event_id, hash); with ``ttl_ms`` a key's state goes after so long without one (such a stream never ends by itself)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(pd.concat(list(parts)))
        previous = state.get[0] if state.exists else None
        out, previous = fold_hash(rows, previous)
        state.update((previous,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "out": out})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, event_id bigint, out string", "hash string", "append", _timeout(ttl_ms))


def stream_token_bucket(stream: DataFrame, rate: float, burst: float, ttl_ms: int | None = None) -> DataFrame:
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(pd.concat(list(parts)))
        tokens, last = state.get if state.exists else (burst, None)
        out, tokens, last = fold_bucket(rows, tokens, last, rate, burst)
        state.update((tokens, last))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "out": out})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, event_id bigint, out bigint", "tokens double, last bigint", "append", _timeout(ttl_ms))
