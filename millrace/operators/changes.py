"""Change tracking of keyed rows over runs, and frontier graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udf


def content_state(current_hash: Column, previous_hash: Column, not_modified: Column | None = None) -> Column:
    """first-seen, unchanged or changed; a not-modified answer is unchanged whatever it holds."""
    out = F.when(previous_hash.isNull(), "first-seen").when(previous_hash == current_hash, "unchanged").otherwise("changed")
    return F.when(not_modified & previous_hash.isNotNull(), "unchanged").otherwise(out) if not_modified is not None else out


def apply_run(state: DataFrame, run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and run: (key, body, extracted JSON[, status]). Returns change rows and the new state.

    A 304 keeps the stored body. Both sides are joined once on the key; the new state is the run's
    keys with their content and the untouched rest.
    """
    old = state.select("key", F.col("body").alias("old_body"), F.col("extracted").alias("old_extracted"))
    j = run.join(old, "key", "left")
    same = F.col("status") == 304
    body = F.when(same, F.col("old_body")).otherwise(F.col("body"))
    extracted = F.when(same, F.col("old_extracted")).otherwise(F.col("extracted"))
    states = j.select("key", body.alias("body"), extracted.alias("extracted"), "old_extracted", content_state(F.sha2("body", 256), F.sha2("old_body", 256), same).alias("content_state"))
    changes = states.withColumn("changes", F.when(F.col("old_extracted").isNotNull() & ~F.col("old_extracted").eqNullSafe(F.col("extracted")), udf.json_diff(F.col("old_extracted"), F.col("extracted"))))
    new = states.select("key", "body", "extracted").unionByName(state.join(run.select("key"), "key", "left_anti").select("key", "body", "extracted"))
    return changes.select("key", "content_state", "changes"), new


def breadth_first(spark, edges: DataFrame, seeds: DataFrame, depth: int, save) -> DataFrame:
    """(url, depth) of everything within ``depth`` links of the seeds; ``save`` stores a table between rounds."""
    found = save(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    front = found
    for d in range(1, depth + 1):
        step = front.select(F.col("url").alias("parent")).join(edges, "parent").select("url").distinct()
        front = save(step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        found = save(found.unionByName(front))
    return found


def dag_waves(spark, nodes: DataFrame, save) -> DataFrame:
    """(id, wave) for nodes (id, depends_on); what lies on or behind a cycle has a null wave."""
    edges = nodes.select("id", F.explode("depends_on").alias("needs"))
    left, done, wave = save(nodes.select("id")), None, 0
    while True:
        waiting = edges.join(left.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct()
        ready = save(left.join(waiting, "id", "left_anti").withColumn("wave", F.lit(wave)))
        if ready.isEmpty():
            rest = left.withColumn("wave", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        left, wave = save(left.join(ready, "id", "left_anti")), wave + 1


def evolve_schema(schema: dict[str, list[str]], version: int, observed: dict[str, list[str]]) -> tuple[dict[str, list[str]], int, list[tuple[str, str]]]:
    """Adds unseen fields and widens known ones; the version rises once if anything changed."""
    out, log = {k: list(v) for k, v in schema.items()}, []
    for f, types in sorted(observed.items()):
        new = [t for t in types if t not in out.get(f, [])]
        if new:
            log.append(("add-field" if f not in out else "widen-field", f))
            out[f] = sorted({*out.get(f, []), *new})
    return out, version + bool(log), log
