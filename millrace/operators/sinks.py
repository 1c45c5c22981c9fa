"""Exports: JSON lines, four CSV dialects, keyed upserts, sharded tables, retention and delivery queues."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import hash_shard


def flatten(item: dict, prefix: str = "") -> dict:
    """Dotted keys; arrays as JSON; an empty object vanishes."""
    out: dict = {}
    for k, v in item.items():
        name = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict):
            out |= flatten(v, name)
        else:
            out[name] = json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, list) else v
    return out


def headers(df: DataFrame, column: str = "item") -> list[str]:
    """Sorted union of flattened keys: each task sends its own distinct keys."""

    def keys(batches):
        found: set = set()
        for pdf in batches:
            for x in pdf[column].dropna():
                found |= flatten(json.loads(x)).keys()
        yield pd.DataFrame({"k": sorted(found)}, dtype=object)

    return sorted(r["k"] for r in df.select(column).mapInPandas(keys, "k string").distinct().collect())


def _cell(v) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def csv_lines(df: DataFrame, names: list[str], dialect: str = "minimal", column: str = "item") -> DataFrame:
    """One CSV line a row: ``minimal`` quotes where needed, ``all`` quotes everything, ``json`` writes every cell as JSON."""

    @F.pandas_udf("string")
    def line(items: pd.Series) -> pd.Series:
        def one(x):
            row = flatten(json.loads(x)) if dialect != "json" else json.loads(x)
            cells = [row.get(n) for n in names]
            if dialect == "json":
                return ",".join("" if c is None else json.dumps(c, separators=(",", ":"), ensure_ascii=False) for c in cells)
            return ",".join(quoted(_cell(c)) if dialect == "minimal" else '"' + _cell(c).replace('"', '""') + '"' for c in cells)

        return pd.Series([one(x) for x in items])

    return df.select(line(F.col(column)).alias("value"))


def write_jsonl(df: DataFrame, path: str, column: str | None = None) -> None:
    (df.select(column) if column else df.select(F.to_json(F.struct(*df.columns)))).toDF("value").write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, size: int = 50) -> None:
    """Files of at most ``size`` rows, written side by side."""
    df.write.mode("overwrite").option("maxRecordsPerFile", size).json(path)


def structured(df: DataFrame, **context) -> DataFrame:
    return df.withColumn("_export_meta", F.struct(*[F.lit(v).alias(k) for k, v in sorted(context.items())], F.current_timestamp().alias("exportedAt")))


def shard_column(key: Column, shards: int, created: Column | None = None) -> Column:
    """By day of creation where that is given, else by hash."""
    by_hash = F.concat(F.lit("shard_"), hash_shard(key, shards).cast("string"))
    return by_hash if created is None else F.coalesce(F.concat(F.lit("day_"), F.date_format(created, "yyyyMMdd")), by_hash)


def write_sharded(df: DataFrame, path: str, key: str, shards: int) -> None:
    df.withColumn("shard", shard_column(F.col(key), shards)).write.mode("append").partitionBy("shard").parquet(path)


def retention(jobs: DataFrame, now: Column, days: int = 7, limit: int = 100) -> DataFrame:
    """Oldest finished jobs past the retention, at most ``limit`` in a sweep."""
    return jobs.where(F.col("status").isin("completed", "failed", "interrupted") & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAY"))).orderBy("updated_at", "job_id").limit(limit)


def due_deliveries(outbox: DataFrame, now_ms: Column, base_ms: int = 1000) -> DataFrame:
    """What is due again after a back-off that grows with each attempt, oldest first."""
    at = F.col("last_attempt_ms") + F.col("attempts") * base_ms
    return outbox.withColumn("next_attempt_ms", at).where(F.col("next_attempt_ms") <= now_ms).orderBy("next_attempt_ms", "created_ms")


def truncate_bytes(text: Column, limit: int) -> Column:
    """First ``limit`` bytes as text, with a flag."""
    whole = F.octet_length(text) <= limit
    raw = F.substring(text.cast("binary"), 1, limit)
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(min(4, limit))], F.lit(""))
    return F.struct(F.when(whole, text).otherwise(cut).alias("text"), (~whole).alias("truncated"))


def batches_to(df: DataFrame, send, size: int = 100, attempts: int = 3) -> DataFrame:
    """Sends rows in batches from the tasks through ``send(list of dicts)``; returns a manifest row for each batch.

    Delivery is at least once: a task that is run again sends again.
    """
    columns = df.columns

    def run(parts):
        for pdf in parts:
            for a in range(0, len(pdf), size):
                rows = pdf.iloc[a : a + size].to_dict("records")
                error, tries = None, 0
                while tries < attempts:
                    tries += 1
                    try:
                        send([{k: r[k] for k in columns} for r in rows])
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - reported in the manifest
                        error = str(e)
                yield pd.DataFrame({"rows": [len(rows)], "attempts": [tries], "error": [error]})

    return df.mapInPandas(run, "rows long, attempts long, error string")
