"""Queries over run histories and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import relational as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RUNS = """runs AS (SELECT o_orderpriority AS workflow, strftime(o_orderdate, '%Y-%m') AS run, count(*) AS results, count(DISTINCT o_custkey) AS pages,
    count(*) FILTER (o_orderstatus = 'F') AS failures, CAST(floor(100.0 * count(*) FILTER (o_orderstatus <> 'F') / count(*) + 0.5) AS BIGINT) AS health FROM orders GROUP BY ALL)"""


def runs(spark, sf_dir):
    """Orders by priority and month as runs of workflows."""
    o = table(spark, sf_dir, "orders")
    failed = F.count_if(F.col("o_orderstatus") == "F")
    n = F.count(F.lit(1))
    return o.groupBy(F.col("o_orderpriority").alias("workflow"), F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(n.alias("results"), F.countDistinct("o_custkey").alias("pages"), failed.alias("failures"), F.floor(100.0 * F.count_if(F.col("o_orderstatus") != "F") / n + 0.5).cast("bigint").alias("health"))


_PREV = f"WITH {_RUNS}, p AS (SELECT *, lag(results) OVER w AS prev_results, lag(pages) OVER w AS prev_pages, lag(failures) OVER w AS prev_failures, lag(health) OVER w AS prev_health FROM runs WINDOW w AS (PARTITION BY workflow ORDER BY run))"


def _previous(spark, sf_dir):
    return H.previous_run(runs(spark, sf_dir), "workflow", "run", ["results", "pages", "failures", "health"])


@query(f"{_PREV} SELECT workflow, run, results, prev_results FROM p")
def previous_run_lookup(spark, sf_dir):
    return _previous(spark, sf_dir).select("workflow", "run", "results", "prev_results")


@query(f"""{_PREV} SELECT workflow, run, results - prev_results AS delta_results, round(CASE WHEN prev_results <> 0 THEN (results - prev_results) * 100.0::DOUBLE / prev_results END, 6) AS percent_results,
    failures - prev_failures AS delta_failures, round(CASE WHEN prev_failures <> 0 THEN (failures - prev_failures) * 100.0::DOUBLE / prev_failures END, 6) AS percent_failures FROM p""")
def baseline_deltas(spark, sf_dir):
    return H.baseline_deltas(_previous(spark, sf_dir), ["results", "failures"]).select("workflow", "run", "delta_results", "percent_results", "delta_failures", "percent_failures")


@query(f"""{_PREV}, a AS (SELECT workflow, run, [CASE WHEN prev_results <> 0 AND results::DOUBLE / prev_results < 0.7 THEN 'result-count-drop' END, CASE WHEN prev_pages <> 0 AND pages::DOUBLE / prev_pages < 0.7 THEN 'pages-fetched-drop' END,
    CASE WHEN failures > prev_failures THEN 'failure-count-increase' END, CASE WHEN health - prev_health <= -15 THEN 'health-score-drop' END] AS x FROM p)
    SELECT workflow, run, array_to_string(list_filter(x, lambda y: y IS NOT NULL), ',') AS alerts FROM a""")
def baseline_alerts(spark, sf_dir):
    c = F.col
    a = H.baseline_alerts(c("pages"), c("prev_pages"), c("results"), c("prev_results"), c("failures"), c("prev_failures"), c("health"), c("prev_health"))
    return _previous(spark, sf_dir).select("workflow", "run", F.array_join(a, ",").alias("alerts"))


_TREND = f"""WITH {_RUNS}, t AS (SELECT *, count(*) OVER w AS samples, avg(results) OVER w AS avg_results, avg(failures) OVER w AS avg_failures FROM runs WINDOW w AS (PARTITION BY workflow ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query(f"{_TREND} SELECT workflow, run, samples, round(avg_results, 6) AS avg_results, round(CASE WHEN avg_results <> 0 THEN (results - avg_results) * 100 / avg_results END, 6) AS trend_results FROM t")
def trend_window_avg(spark, sf_dir):
    return H.trend(runs(spark, sf_dir), "workflow", "run", ["results"]).select("workflow", "run", "samples", F.round("avg_results", 6).alias("avg_results"), "trend_results")


@query(f"""{_TREND}, a AS (SELECT workflow, run, [CASE WHEN avg_results <> 0 AND round((results - avg_results) * 100 / avg_results, 6) <= -30 THEN 'result-count-below-trend' END,
    CASE WHEN (avg_failures <> 0 AND round((failures - avg_failures) * 100 / avg_failures, 6) >= 50) OR (failures > 0 AND avg_failures = 0) THEN 'failure-count-above-trend' END] AS x FROM t)
    SELECT workflow, run, array_to_string(list_filter(x, lambda y: y IS NOT NULL), ',') AS alerts FROM a""")
def trend_alerts(spark, sf_dir):
    t = H.trend(runs(spark, sf_dir), "workflow", "run", ["results", "failures"])
    return t.select("workflow", "run", F.array_join(H.trend_alerts("results", "failures"), ",").alias("alerts"))


@query(f"WITH {_RUNS} SELECT workflow, count(*) AS runs, round(avg(health), 6) AS avg_health, count(*) FILTER (health < 50) AS warning_runs, max(run) AS latest FROM runs GROUP BY 1")
def history_health(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("workflow").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("health"), 6).alias("avg_health"), F.count_if(F.col("health") < 50).alias("warning_runs"), F.max("run").alias("latest"))


_LR = "l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.compare(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey")


@query(f"""WITH {_LR} SELECT 'both' AS side, count(*) AS n FROM l JOIN r USING (o_custkey) HAVING count(*) > 0 UNION ALL SELECT 'left', count(*) FROM l ANTI JOIN r USING (o_custkey) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM r ANTI JOIN l USING (o_custkey) HAVING count(*) > 0""")
def run_compare_overlap(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LR} (SELECT o_custkey FROM l EXCEPT SELECT o_custkey FROM r) UNION ALL (SELECT o_custkey FROM r EXCEPT SELECT o_custkey FROM l)")
def set_ops(spark, sf_dir):
    return _sides(spark, sf_dir).where("side <> 'both'").select("o_custkey")


@query("""WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS v, true AS x FROM labels), n AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS v, true AS y FROM documents)
    SELECT doc_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'modified' ELSE 'unchanged' END AS state FROM o FULL JOIN n USING (doc_id)""")
def keyed_diff(spark, sf_dir):
    """What labels say of each document against what its length says."""
    say = lambda c: F.when(c, "long").otherwise("short").alias("v")
    old, new = table(spark, sf_dir, "labels").select("doc_id", say(F.col("quality") == 1)), table(spark, sf_dir, "documents").select("doc_id", say(F.col("n_chars") > 500))
    return R.keyed_diff(old, new, "doc_id", "v")


@query("SELECT c_custkey, count(o_orderkey) AS records, strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("records"), F.max("o_orderdate").alias("at"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("records", F.lit(0)).alias("records"), F.date_format("at", "yyyy-MM-dd").alias("updated"))


@query("""SELECT o_orderkey, count(l_linenumber) AS hooks, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS line_numbers FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def left_join_collect(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct()
    g = li.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("hooks"), F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("line_numbers"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(g, "o_orderkey", "left").select("o_orderkey", F.coalesce("hooks", F.lit(0)).alias("hooks"), "line_numbers")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY 1")
def join_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS region, s AS segment, p AS priority, row_number() OVER (ORDER BY r_name, s, p) AS id FROM region, (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def cross_matrix(spark, sf_dir):
    """An experiment matrix of three short lists, numbered. The lists are configuration, so their product stays small."""
    from pyspark.sql import Window

    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    s = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return r.crossJoin(s).crossJoin(p).withColumn("id", F.row_number().over(Window.orderBy("region", "segment", "priority")).cast("bigint"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query(f"""{_PREV}, c AS (SELECT workflow, results, failures FROM p WHERE run = (SELECT max(run) FROM runs)), b AS (SELECT workflow, results, failures FROM p WHERE run = (SELECT min(run) FROM runs))
    SELECT workflow AS field, coalesce(c.results, 0)::DOUBLE AS current, coalesce(b.results, 0)::DOUBLE AS previous, coalesce(c.results, 0)::DOUBLE - coalesce(b.results, 0)::DOUBLE AS delta FROM c FULL JOIN b USING (workflow) WHERE coalesce(c.results, 0) <> coalesce(b.results, 0)""")
def field_coverage_changes(spark, sf_dir):
    r = runs(spark, sf_dir)
    ends = r.agg(F.max("run").alias("hi"), F.min("run").alias("lo"))
    r = r.withColumn("results", F.col("results").cast("double"))
    return H.field_coverage_changes(r.join(F.broadcast(ends), F.col("run") == F.col("hi")), r.join(F.broadcast(ends), F.col("run") == F.col("lo")), "workflow", "results")
