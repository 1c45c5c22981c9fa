"""One run of a plan over stored responses: extract, assess, discover, compare with the last run, export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url
from ..operators import changes, diagnostics, quality, relational, sinks
from . import compiler


@dataclass
class Run:
    """Lazy tables of a run; nothing has been computed until one is read or written."""

    results: DataFrame
    links: DataFrame
    coverage: DataFrame
    snapshot: DataFrame
    alerts: DataFrame
    changes: DataFrame | None = None
    state: DataFrame | None = None
    exports: list[str] = field(default_factory=list)


def run(plan: dict, responses: DataFrame, state: DataFrame | None = None) -> Run:
    """``responses(url, body[, status, headers, fetched_at])``; the first response of a request identity wins. ``state``: (key, body, extracted) of the last run."""
    plan = compiler.validate(plan)
    for name, kind, default in (("status", "int", 200), ("headers", "map<string,string>", None), ("fetched_at", "timestamp", None)):
        if name not in responses.columns:
            responses = responses.withColumn(name, F.lit(default).cast(kind))
    keyed = responses.withColumn("key", url.unique_key(F.col("url")))
    if plan.get("dedup", True):
        keyed = relational.first_wins(keyed.select("key", "url", "fetched_at", "status", "body", "headers"), ["key"], ["fetched_at", "url"])
    rows = compiler.assess(plan, compiler.extract(plan, keyed))
    rows = rows.withColumn("protection", diagnostics.protection(F.col("headers"), F.col("body"), F.col("status")))
    filled = F.size(F.filter(F.split(quality.shape(rows), ","), lambda x: x != ""))
    rows = rows.withColumn("outcome", diagnostics.outcome(F.col("status"), F.col("body"), filled, F.col("protection.challenge"), F.col("valid")))
    snap = quality.snapshot(rows, failures=F.col("status") >= 400, challenged=F.col("protection.challenge"))
    out = Run(rows, compiler.discover(plan, keyed), quality.coverage(rows), snap, quality.alerts(snap))
    if state is not None:
        out.changes, out.state = changes.apply_run(state, rows.select("key", "body", F.to_json("extracted").alias("extracted"), "status"))
    return out


def export(r: Run, outputs: list[dict], **context) -> Run:
    """Writes tables of a run: {table, format: parquet, json or csv, path[, partition_by]}."""
    for o in outputs:
        df = getattr(r, o["table"])
        if o["format"] == "csv":
            items = df.select(F.to_json(F.struct(*df.columns)).alias("item"))
            names = sinks.headers(items)
            lines = sinks.csv_lines(items, names)
            lines.write.mode("overwrite").text(o["path"])
        else:
            df = sinks.structured(df, **context) if context else df
            w = df.write.mode("overwrite")
            (w.partitionBy(*o["partition_by"]) if o.get("partition_by") else w).format(o["format"]).save(o["path"])
        r.exports.append(o["path"])
    return r
