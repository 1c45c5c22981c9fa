"""Reads, sets, joins, queues and windows over stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches_query(df: DataFrame, text: str) -> Column:
    """Case-insensitive substring of the row as JSON, keys included; an empty text matches all."""
    if not text:
        return F.lit(True)
    return F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(text.lower()))


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows of one page in a total order; offset at least 0, limit at least 1."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def tail(df: DataFrame, order: str, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def events_after(df: DataFrame, after: int, kind: str | None = None, text: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    out = df.where(F.col("event_id") > after).where(matches_query(df, text))
    return page(out.where(F.col("event_type") == kind) if kind else out, ["event_id"], offset, limit)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the order given (a total one): a partial-aggregated minimum, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins by key: the row with the greatest version; of equals, the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row")).select(*keys, "_row.*")


def seen(df: DataFrame, seen_keys: DataFrame, keys: list[str], wanted: bool = False) -> DataFrame:
    """Rows whose key has been seen, or with ``wanted`` False those that haven't."""
    return df.join(seen_keys.select(*keys), keys, "left_semi" if wanted else "left_anti")


def record_seen(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """First and last time of every key, and its latest value."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(value, at).alias("latest"))


def prune_seen(state: DataFrame, now: Column, ttl: str, max_entries: int, key: str) -> DataFrame:
    """Drops what is older than the time to live, then the oldest beyond ``max_entries`` (a top-k by time, no full sort)."""
    live = state.where(F.col("last_seen") >= now - F.expr(f"INTERVAL {ttl}"))
    return live.orderBy(F.desc("last_seen"), key).limit(max_entries)


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two runs with the side that has them: both, left or right. One shuffle for the three sets."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.select(key, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, modified, unchanged of every key by its value; a null value equals a null value."""
    o = old.select(F.col(key).alias("k"), F.col(value).alias("vo"), F.lit(True).alias("in_old"))
    n = new.select(F.col(key).alias("k"), F.col(value).alias("vn"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("vo").eqNullSafe(F.col("vn")), "unchanged").otherwise("modified")
    return o.join(n, "k", "full_outer").select(F.col("k").alias(key), state.alias("state"))


def queue_order() -> list[Column]:
    return [F.desc("priority"), F.asc("enqueued_at"), F.asc("unique_key")]


def pending_score(priority: Column, at_ms: Column) -> Column:
    """One sortable number for (priority descending, time ascending)."""
    return at_ms.cast("double") - priority.cast("double") * 1e11


def lane_heads(df: DataFrame, lane: str, k: int = 8) -> DataFrame:
    """First k of every lane in queue order."""
    w = Window.partitionBy(lane).orderBy(*queue_order())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def eligible(df: DataFrame, active: Column, active_cap: int, recent: Column, recent_cap: int, blocked_until: Column, now_ms: Column) -> DataFrame:
    return df.where((F.coalesce(blocked_until, F.lit(0)) <= now_ms) & (F.coalesce(active, F.lit(0)) < active_cap) & (F.coalesce(recent, F.lit(0)) < recent_cap))


def sliding_count(df: DataFrame, key: str, at_ms: str, window_ms: int) -> DataFrame:
    """How many events of the key lie in the window that ends with each event; its start is inclusive."""
    w = Window.partitionBy(key).orderBy(at_ms).rangeBetween(-window_ms, 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w))


def kth_recent_release(df: DataFrame, key: str, at_ms: str, k: int, window_ms: int) -> DataFrame:
    """When a budget of k per window is free again: time of the k-th latest event and the window."""
    w = Window.partitionBy(key).orderBy(F.desc(at_ms), F.desc("event_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select(key, (F.col(at_ms) + window_ms).alias("release_ms"))


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column, base_ms: int = 1000, factor: float = 2.0, cap_ms: int = 60_000) -> DataFrame:
    """Consecutive failures up to each row (a success starts anew), and the back-off they earn."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("failed", failed).withColumn("island", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    streak = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(Window.partitionBy(key, "island").orderBy(*order))
    d = d.withColumn("streak", streak)
    return d.withColumn("backoff_ms", F.when(F.col("streak") > 0, F.least(F.lit(float(cap_ms)), F.lit(float(base_ms)) * F.pow(F.lit(factor), F.col("streak") - 1))).otherwise(F.lit(0.0)).cast("bigint"))


def top_entries(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Most frequent values, count descending and value ascending."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(limit)


def histogram(df: DataFrame, value: str, buckets: tuple[float, ...], keys: list[str]) -> DataFrame:
    """Cumulative counts up to and including each border, with sum and count."""
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{i}") for i, b in enumerate(buckets)]
    wide = df.groupBy(*keys).agg(*counts, F.count(value).alias("le_inf"), F.round(F.sum(value), 4).alias("total"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n"))]
    return wide.select(*keys, "total", F.inline(F.array(*pairs)))


def nearest_rank(value: str, percent: int) -> Column:
    """Nearest-rank percentile: the smallest value that at least ``percent`` of the rows don't exceed."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})").cast("int")
