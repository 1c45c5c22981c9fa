"""Payloads for systems outside: message queues, search indexes, webhooks, object stores and databases.

Payloads are made in the tasks; nothing here opens a connection. ``sinks.batches_to`` sends them.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT_TYPES = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv"}
# Columns of the record export.
RECORD = ("sequence", "url", "finalUrl", "mode", "status", "depth", "sessionId", "proxyLabel", "proxyServer", "attemptsUsed", "extracted")


def _json(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) of every row for a message queue: the row as JSON; an empty or null key field gives no key. Write with ``format("kafka")``."""
    k = F.nullif(F.col(key).cast("string"), F.lit("")) if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct("*")).alias("value"))


def index_lines(item: Column, index: str, pipeline: str | None = None) -> Column:
    """Two lines of a bulk request for an item (JSON text): its header, which takes the item's ``_id``, and the item without it."""

    @F.pandas_udf("string")
    def run(items: pd.Series) -> pd.Series:
        out = []
        for x in items:
            doc = json.loads(x)
            head = {"_index": index} | ({"pipeline": pipeline} if pipeline else {})
            if doc.get("_id"):
                head["_id"] = doc.pop("_id")
            out.append(f"{_json({'index': head})}\n{_json(doc)}\n")
        return pd.Series(out, dtype=object)

    return run(item)


def csv_text(items: list[dict], keys: str = "all") -> str:
    """A header and a line an item, every cell as JSON, an absent or null one as an empty text. ``keys``: of all items in order of first sight, or of the ``first`` item only."""
    if not items:
        return ""
    names = list(dict.fromkeys(k for i in (items if keys == "all" else items[:1]) for k in i))
    return "\n".join([",".join(names), *(",".join(_json("" if i.get(n) is None else i[n]) for n in names) for i in items)])


def payload(items: list[dict], form: str, keys: str = "all") -> str:
    if form == "csv":
        return csv_text(items, keys)
    return "\n".join(map(_json, items)) if form == "jsonl" else _json(items)


def signature(body: str, secret: str, algorithm: str = "sha256") -> str:
    return f"{algorithm}={hmac.new(secret.encode(), body.encode(), getattr(hashlib, algorithm)).hexdigest()}"


def payloads(df: DataFrame, column: str = "item", *, form: str = "json", size: int = 100, secret: str | None = None, keys: str = "all", order: str | None = None) -> DataFrame:
    """Batches of at most ``size`` items: (rows, body, content_type, signature). Batches lie inside a partition, in order of ``order``."""
    if order:
        df = df.sortWithinPartitions(order)
    kind = CONTENT_TYPES.get(form, "application/octet-stream")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def out() -> pd.DataFrame:
            body = payload(held, form, keys)
            return pd.DataFrame([(len(held), body, kind, signature(body, secret) if secret else None)], columns=["rows", "body", "content_type", "signature"])

        for frame in frames:
            for x in frame[column]:
                held.append(json.loads(x))
                if len(held) == size:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return df.mapInPandas(run, "rows bigint, body string, content_type string, signature string")


def object_key(template: str, job: Column, day: Column, stamp: Column, form: str) -> Column:
    """Key of an object from {jobId}, {date}, {ts} and {ext}; only the first occurrence of each is filled in."""
    left = {"jobId": F.coalesce(job, F.lit("unknown")), "date": F.date_format(day, "yyyy-MM-dd"), "ts": stamp.cast("string"), "ext": F.lit(form)}
    parts = [left.pop(t[1:-1]) if t[1:-1] in left and t[0] == "{" else F.lit(t) for t in re.findall(r"\{\w+\}|[^{]+|\{", template)]
    return F.concat(*parts)


def record_lines(records: DataFrame) -> DataFrame:
    """Lines of the record export: fixed columns, all quoted, ``extracted`` as JSON ({} where there is none); absent columns are empty."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    value = lambda n: (F.coalesce(F.col(n), F.lit("{}")) if n == "extracted" else F.col(n)) if n in records.columns else F.lit("{}" if n == "extracted" else "")
    return records.select(F.concat_ws(",", *[cell(value(n)) for n in RECORD]).alias("value"))


def table_rows(df: DataFrame, column: str = "payload", **context) -> DataFrame:
    """Rows as one JSON column for a database table, with a metadata column where there is a context. Write with ``write_table``."""
    rows = df.select(F.to_json(F.struct("*")).alias(column))
    return rows.withColumn("metadata", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(context.items())]))) if context else rows


def write_table(rows: DataFrame, url: str, table: str, batch: int = 200, **options) -> None:
    """Appends to a database table over JDBC; the driver's jar is the user's. Names are checked, as they become part of statements."""
    if not all(p.isidentifier() for p in table.split(".")):
        raise ValueError(f"{table} is no table name")
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


class Backends:
    """Sinks by name."""

    def __init__(self):
        self.found: dict[str, Callable] = {}

    def register(self, name: str, handler: Callable) -> Backends:
        if not callable(handler):
            raise ValueError(f"backend {name} needs a callable")
        self.found[name] = handler
        return self

    def write(self, name: str, df: DataFrame, /, **options):
        if name not in self.found:
            raise KeyError(f"no backend {name}; known: {sorted(self.found)}")
        return self.found[name](df, **options)


def upsert_artifacts(stored: DataFrame, written: DataFrame) -> DataFrame:
    """Artifacts (job_id, path, body, content_type, at) after writes: the latest of a path, with its bytes in UTF-8."""
    every = stored.select("job_id", "path", "body", "content_type", "at", F.lit(0).alias("new")).unionByName(written.select("job_id", "path", "body", "content_type", "at", F.lit(1).alias("new")))
    last = every.groupBy("job_id", "path").agg(F.max_by(F.struct("body", "content_type", "at"), F.struct("new", "at")).alias("x"))
    return last.select("job_id", "path", "x.*", F.octet_length("x.body").cast("long").alias("bytes"))


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; the new value of a key wins."""
    old, new = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
