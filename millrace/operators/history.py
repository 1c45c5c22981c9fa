"""Run histories: previous runs, baselines, trends and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent_delta, ratio


def previous_run(runs: DataFrame, workflow: str, order: str, columns: list[str]) -> DataFrame:
    """Each run with the columns of the run before it in the same workflow."""
    w = Window.partitionBy(workflow).orderBy(order)
    return runs.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def baseline_deltas(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Difference and percentage to the previous run, null without one."""
    out = runs
    for c in columns:
        now, before = F.col(c), F.col(f"prev_{c}")
        out = out.withColumn(f"delta_{c}", now - before).withColumn(f"percent_{c}", F.round(percent_delta(now, before), 6))
    return out


def alerts(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in rules]))


def baseline_alerts(pages: Column, prev_pages: Column, results: Column, prev_results: Column, failures: Column, prev_failures: Column, health: Column, prev_health: Column) -> Column:
    """A ratio below 0.7 is a drop, more failures are an increase, and fifteen points of health a drop."""
    return alerts([
        ("result-count-drop", ratio(results, prev_results) < 0.7), ("pages-fetched-drop", ratio(pages, prev_pages) < 0.7),
        ("failure-count-increase", failures > prev_failures), ("health-score-drop", health - prev_health <= -15),
    ])


def trend(runs: DataFrame, workflow: str, order: str, columns: list[str], window: int = 5) -> DataFrame:
    """Mean of each column over the last ``window`` runs before this one, and the percentage from it."""
    w = Window.partitionBy(workflow).orderBy(order).rowsBetween(-window, -1)
    out = runs.withColumn("samples", F.count(F.lit(1)).over(w))
    for c in columns:
        out = out.withColumn(f"avg_{c}", F.avg(c).over(w)).withColumn(f"trend_{c}", F.round(percent_delta(F.col(c), F.col(f"avg_{c}")), 6))
    return out


def trend_alerts(results: str, failures: str) -> Column:
    return alerts([
        ("result-count-below-trend", F.col(f"trend_{results}") <= -30),
        ("failure-count-above-trend", (F.col(f"trend_{failures}") >= 50) | ((F.col(failures) > 0) & (F.col(f"avg_{failures}") == 0))),
    ])


def field_coverage_changes(current: DataFrame, previous: DataFrame, field: str, value: str) -> DataFrame:
    """Full outer by field, missing as 0, by size of the change."""
    c, p = current.select(F.col(field).alias("field"), F.col(value).alias("c")), previous.select(F.col(field).alias("field"), F.col(value).alias("p"))
    j = c.join(p, "field", "full_outer").select("field", F.coalesce("c", F.lit(0.0)).alias("current"), F.coalesce("p", F.lit(0.0)).alias("previous"))
    return j.withColumn("delta", F.col("current") - F.col("previous")).where("delta <> 0").orderBy(F.abs("delta").desc(), "field")
