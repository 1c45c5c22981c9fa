"""Queries of protection, outcome and network diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D

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


RESPONSES = [
    (1, 200, {"Server": "nginx"}, "<p>fine</p>", 1), (2, 403, {"CF-Ray": "1", "Set-Cookie": "__cf_bm=x"}, "Attention Required! challenge", 0), (3, 401, {}, "Please sign in", 0),
    (4, 400, {}, "Invalid signature", 0), (5, 200, {}, "<p>login to go on</p>", 0), (6, 200, {"server": "AkamaiGHost", "set-cookie": "_abck=1; datadome=2"}, "ok", 2), (7, 200, None, None, 1),
]


def _responses(spark):
    d = spark.createDataFrame(RESPONSES, "id int, status int, headers map<string,string>, body string, filled int")
    return d.withColumn("p", D.protection(F.col("headers"), F.col("body"), F.col("status")))


@query("SELECT * FROM (VALUES (1, false, NULL, 0, false), (2, true, 'cloudflare', 2, true), (3, false, NULL, 0, false), (4, false, NULL, 0, false), (5, false, NULL, 0, false), (6, true, 'akamai', 2, false), (7, false, NULL, 0, false)) t(id, detected, provider, signals, challenge)")
def protection_surface(spark, sf_dir):
    return _responses(spark).select("id", "p.*")


@query("SELECT * FROM (VALUES (1, 'ok'), (2, 'anti-bot'), (3, 'auth'), (4, 'signature'), (5, 'degraded-success'), (6, 'ok'), (7, 'ok')) t(id, outcome)")
def diagnostics_class(spark, sf_dir):
    return _responses(spark).select("id", D.outcome(F.col("status"), F.col("body"), F.col("filled"), F.col("p.challenge"), F.lit(True)).alias("outcome"))


@query("SELECT * FROM (VALUES ('anti-bot', 14.285714::DOUBLE), ('auth-wall', 12.857143), ('signature', 12.142857), ('degraded-success', 10.0), ('shape-drift', 10.0)) t(type, score)")
def suspects(spark, sf_dir):
    c = diagnostics_class(spark, sf_dir)
    n = lambda k: F.count_if(F.col("outcome") == k)
    s = c.agg(F.count(F.lit(1)).alias("total"), n("anti-bot").alias("anti_bot"), n("auth").alias("auth"), n("signature").alias("signature"), n("degraded-success").alias("degraded"), F.lit(2).alias("shapes"), F.lit(0).alias("failures"))
    return D.suspects(s)


@query("SELECT * FROM (VALUES (2, 'warning'), (3, 'error'), (4, 'critical')) t(id, severity)")
def severity_filter(spark, sf_dir):
    d = spark.createDataFrame([(1, "info"), (2, "warning"), (3, "error"), (4, "critical"), (5, "odd")], "id int, severity string")
    return d.where(D.severity_at_least(F.col("severity"), "warning"))


CALL = "array<struct<url:string,transport:string,method:string,status:int,requestBody:string,body:string>>"


@query("SELECT * FROM (VALUES (1, 1, 'https://s.test/graphql', 'graphql', 162), (1, 2, 'https://s.test/api/auth/token', 'auth', 98), (1, 3, 'https://s.test/track', 'analytics', 12)) t(page_id, rank, url, category, score)")
def network_candidates_ranked(spark, sf_dir):
    calls = [("https://s.test/track", "xhr", "GET", 200, None, '{"ok":1}'), ("https://s.test/api/auth/token", "xhr", "GET", 200, None, '{"t":"x"}'), ("https://s.test/graphql", "fetch", "POST", 200, '{"query":"{x}"}', '{"data":{"x":{"items":[1,2],"pageInfo":{}}}}'), ("https://s.test/raw", "fetch", "GET", 200, None, "<html>")]
    d = spark.createDataFrame([(1, calls)], f"page_id int, requests {CALL}")
    return D.network_candidates(d, "requests").drop("payload", "signals", "data_path")


@query("SELECT * FROM (VALUES (1, '/p2', NULL, CAST(NULL AS BIGINT)), (2, NULL, 'z', NULL), (3, NULL, NULL, 30), (4, NULL, NULL, NULL)) t(id, url, cursor, \"offset\")")
def json_next_page(spark, sf_dir):
    rows = [(1, '{"meta":{"next":"/p2"}}'), (2, '{"data":{"c":{"pageInfo":{"hasNextPage":true,"endCursor":"z"}}}}'), (3, '{"offset":20,"limit":10}'), (4, "not json")]
    return spark.createDataFrame(rows, "id int, body string").select("id", F.inline(F.array(D.json_next(F.col("body")))))


@query("""WITH l AS (SELECT 'lang' AS name, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT name, value, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM c)
    SELECT name, value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def frequency_tables(spark, sf_dir):
    return D.frequencies(table(spark, sf_dir, "documents"), ["lang", "source"], 10)


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true)) t(request_id, allowed)")
def access_policy(spark, sf_dir):
    r = spark.createDataFrame([(1, "a", ["dev"], "jobs:read", "job/1"), (2, "a", ["dev"], "jobs:delete", "job/1"), (3, "b", ["dev"], "jobs:read", "job/1"), (4, "a", ["ops"], "jobs:delete", "job/9")], "request_id int, tenant string, roles array<string>, action string, resource string")
    p = spark.createDataFrame([("a", "dev", "jobs:*", "*", "allow"), ("a", "dev", "jobs:delete", "job/*", "deny"), ("a", "ops", "*", "*", "allow")], "tenant string, role string, p_action string, p_resource string, effect string")
    return D.access(r, p)


@query("SELECT * FROM (VALUES ('OBJECT<k: BIGINT>')) t(schema)")
def json_schema_inference(spark, sf_dir):
    return spark.createDataFrame([(D.json_schema(table(spark, sf_dir, "events"), "props"),)], "schema string")


@query("""SELECT c_mktsegment AS segment, c_name AS proxy FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1""")
def healthiest_first(spark, sf_dir):
    """Healthiest proxy of every pool: an aggregate, not a sort."""
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("proxy"))


@query("""SELECT 'baseline' AS source, o_orderkey AS id FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'trend', o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def flatten_alerts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tag = lambda s, c: o.where(c).select(F.lit(s).alias("source"), F.col("o_orderkey").alias("id"))
    return tag("baseline", "o_totalprice > 300000").unionAll(tag("trend", "o_orderstatus = 'P'"))
