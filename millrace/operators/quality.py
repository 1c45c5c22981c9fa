"""Quality of extracted records: coverage, value kinds, shapes, health and its alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import is_empty


def _fields(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema["extracted"].dataType.fields]


def shape(df: DataFrame) -> Column:
    """Names of the filled fields, as one text."""
    return F.array_join(F.array_compact(F.array(*[F.when(~is_empty(F.col(f"extracted.{n}"), k), n) for n, k in _fields(df)])), ",")


def coverage(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(field, present, records, coverage) over the rows, in one pass for all fields."""
    keys = keys or []
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(~is_empty(F.col(f"extracted.{n}"), k)).alias(f"_{i}") for i, (n, k) in enumerate(_fields(df))])
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_{i}").alias("present")) for i, (n, _) in enumerate(_fields(df))])
    return wide.select(*keys, "records", F.inline(pairs)).withColumn("coverage", F.col("present") / F.greatest(F.col("records"), F.lit(1)))


def snapshot(df: DataFrame, failures: Column | None = None, challenged: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts and the health score of assessed rows (extracted, valid): 100 less shares of failures, invalid and challenged rows and ten for mixed shapes."""
    keys = keys or []
    zero = F.lit(False)
    s = df.withColumn("_shape", shape(df)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(failures if failures is not None else zero).alias("failures"),
        F.count_if(challenged if challenged is not None else zero).alias("challenged"), F.count_distinct(F.nullif(F.col("_shape"), F.lit(""))).alias("shapes"),
    )
    n = F.greatest(F.col("records"), F.lit(1))
    raw = 100 - 35.0 * F.col("failures") / n - 30.0 * F.col("invalid") / n - 20.0 * F.col("challenged") / n - F.when(F.col("shapes") > 1, 10).otherwise(0)
    return s.withColumn("health", F.greatest(F.lit(0), F.floor(raw + 0.5)).cast("bigint"))


def alerts(s: DataFrame, least_health: int = 60) -> DataFrame:
    rules = [("schema-invalid", F.col("invalid") > 0, "warning"), ("challenge-detected", F.col("challenged") > 0, "warning"), ("low-health", F.col("health") < least_health, "error")]
    return s.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("alert"), F.lit(v).alias("severity"))) for n, c, v in rules]))).alias("_a")).select(*s.columns, "_a.*")


def issue_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def timeline(df: DataFrame, at: str, kinds: list[str], limit: int = 200) -> DataFrame:
    """First ``limit`` moments of several array columns (of structs name, at) in order of time and name: a bounded top-k."""
    parts = [df.select(F.lit(k).alias("kind"), F.explode(k).alias("e")).select("kind", "e.name", F.col(f"e.{at}").alias("at")) for k in kinds]
    return reduce(lambda a, b: a.unionAll(b), parts).orderBy("at", "name", "kind").limit(limit)
