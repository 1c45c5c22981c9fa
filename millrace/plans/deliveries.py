"""Queries over user code, payloads for outside systems, and snapshots of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deliveries as O
from ..operators import snapshots, usercode
from ..streaming import stateful

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark, sf_dir, name):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


# ---------------------------------------------------------------- user code


def size_step(item):
    """Too long: an error; very short: dropped; others get their size class."""
    if item["n_chars"] > 5000:
        raise ValueError("too long")
    return None if item["n_chars"] < 100 else item | {"k": item["n_chars"] // 100}


def keep_step(item):
    return True


@query("""SELECT doc_id, n_chars <= 5000 AND n_chars < 100 AS dropped, CASE WHEN n_chars > 5000 THEN 'too long' END AS error, CASE WHEN n_chars BETWEEN 100 AND 5000 THEN '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"k":' || (n_chars // 100) || '}' END AS item FROM documents""")
def item_pipeline(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "n_chars")).alias("item"))
    return usercode.pipeline(d, [size_step, keep_step])


def long_enough(item):
    if item["n_chars"] < 300:
        raise ValueError(f"{item['n_chars']} characters")
    return {"id": item["doc_id"]}


@query("""SELECT doc_id, n_chars >= 300 AS ok, CASE WHEN n_chars >= 300 THEN '{"id":' || doc_id || '}' END AS data, CASE WHEN n_chars < 300 THEN n_chars || ' characters' END AS error FROM documents""")
def item_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "n_chars")).alias("item"))
    return usercode.validated(d, long_enough).drop("item")


def two_items(page):
    yield {"id": page["page_id"], "part": "head"}
    yield {"id": page["page_id"], "part": "body"}


def one_item(page):
    yield {"id": page["page_id"]}


@query("""SELECT page_id, route, seq, item FROM (SELECT page_id, route, 0 AS seq, CASE WHEN route = 'deep' THEN '{"id":' || page_id || ',"part":"head"}' ELSE '{"id":' || page_id || '}' END AS item FROM r WHERE route <> 'flat'
    UNION ALL SELECT page_id, route, 1, '{"id":' || page_id || ',"part":"body"}' FROM r WHERE route = 'deep')""".replace("FROM r ", "FROM (SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'query' WHEN len(string_split(url, '/')) > 5 THEN 'deep' ELSE 'flat' END AS route FROM pages) "))
def routed_items(spark, sf_dir):
    """Pages with a query string give one item, pages deep in a site two, others none."""
    route = F.when(F.col("url").contains("?"), "query").when(F.size(F.split("url", "/")) > 5, "deep").otherwise("flat")
    return usercode.route_items(table(spark, sf_dir, "pages").select("page_id", route.alias("route")), {"deep": two_items, "query": one_item})


# ---------------------------------------------------------------- payloads


@query("""SELECT user_id::VARCHAR AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def queue_messages(spark, sf_dir):
    return O.messages(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id")


@query("""SELECT * FROM (VALUES (1, '{"index":{"_index":"pages","pipeline":"clean","_id":"x"}}' || chr(10) || '{"a":1}' || chr(10)), (2, '{"index":{"_index":"pages","pipeline":"clean"}}' || chr(10) || '{"_id":"","b":"é"}' || chr(10))) t(id, lines)""")
def index_bulk_lines(spark, sf_dir):
    d = spark.createDataFrame([(1, '{"_id":"x","a":1}'), (2, '{"_id":"","b":"é"}')], "id int, item string")
    return d.select("id", O.index_lines(F.col("item"), "pages", "clean").alias("lines"))


ITEMS = ['{"a":1,"b":"x,y"}', '{"c":null,"a":"q\\"q"}', '{"d":[1,2]}']


@query("""SELECT * FROM (VALUES ('json', CAST(2 AS BIGINT), '[{"a":1,"b":"x,y"},{"c":null,"a":"q\\"q"}]', 'application/json'), ('json', 1, '[{"d":[1,2]}]', 'application/json'),
    ('jsonl', 2, '{"a":1,"b":"x,y"}' || chr(10) || '{"c":null,"a":"q\\"q"}', 'application/x-ndjson'), ('jsonl', 1, '{"d":[1,2]}', 'application/x-ndjson'),
    ('csv', 2, 'a,b,c' || chr(10) || '1,"x,y",""' || chr(10) || '"q\\"q","",""', 'text/csv'), ('csv', 1, 'd' || chr(10) || '[1,2]', 'text/csv'),
    ('csv of the first', 2, 'a,b' || chr(10) || '1,"x,y"' || chr(10) || '"q\\"q",""', 'text/csv'), ('csv of the first', 1, 'd' || chr(10) || '[1,2]', 'text/csv')) t(form, rows, body, content_type)""")
def delivery_payloads(spark, sf_dir):
    d = spark.createDataFrame(list(enumerate(ITEMS)), "n int, item string").coalesce(1)
    out = None
    for name, form, keys in (("json", "json", "all"), ("jsonl", "jsonl", "all"), ("csv", "csv", "all"), ("csv of the first", "csv", "first")):
        one = O.payloads(d, form=form, size=2, keys=keys, order="n").select(F.lit(name).alias("form"), "rows", "body", "content_type")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES (1, 'crawl/j1/2024-05-06-17.csv'), (2, 'crawl/unknown/2024-05-06-18.csv')) t(id, key)")
def object_keys(spark, sf_dir):
    d = spark.createDataFrame([(1, "j1", 17), (2, None, 18)], "id int, job string, ts long")
    return d.select("id", O.object_key("crawl/{jobId}/{date}-{ts}.{ext}", F.col("job"), F.lit("2024-05-06").cast("date"), F.col("ts"), "csv").alias("key"))


@query("""SELECT '"' || page_id || '","' || replace(url, '"', '""') || '","","","","","","","","","{}"' AS value FROM pages""")
def record_export(spark, sf_dir):
    return O.record_lines(table(spark, sf_dir, "pages").select(F.col("page_id").alias("sequence"), "url"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS payload, '{"jobId":"j1","kind":"result"}' AS metadata FROM region""")
def database_rows(spark, sf_dir):
    return O.table_rows(table(spark, sf_dir, "region"), jobId="j1", kind="result")


@query("""SELECT * FROM (VALUES ('j', 'a', 'new é', 'text/plain', 5, CAST(6 AS BIGINT)), ('j', 'b', 'kept', NULL, 2, 4), ('k', 'a', 'other', NULL, 1, 5)) t(job_id, path, body, content_type, "at", bytes)""")
def artifact_upserts(spark, sf_dir):
    schema = "job_id string, path string, body string, content_type string, at int"
    stored = spark.createDataFrame([("j", "a", "old", None, 9), ("j", "b", "kept", None, 2)], schema)
    return O.upsert_artifacts(stored, spark.createDataFrame([("j", "a", "first", None, 3), ("j", "a", "new é", "text/plain", 5), ("k", "a", "other", None, 1)], schema))


@query("SELECT * FROM (VALUES (1, 'a=1,b=3,c=4'), (2, 'b=3'), (3, 'a=1')) t(id, merged)")
def metadata_merge(spark, sf_dir):
    d = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (2, None, {"b": "3"}), (3, {"a": "1"}, None)], "id int, o map<string,string>, n map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(O.merge_metadata(F.col("o"), F.col("n"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return d.select("id", F.array_join(entries, ",").alias("merged"))


# ---------------------------------------------------------------- snapshots


CALLS = "array<struct<requestHeaders:map<string,string>,responseHeaders:map<string,string>>>"
RESULTS = [
    (200, 1, True, "fine", [({"Authorization": "x"}, {"Set-Cookie": "sid=1; Path=/"}), ({}, {"set-cookie": "lang=en"})], [("localStorage.setItem", " token "), ("fetch", "token")]),
    (403, 3, None, "Session expired, sign in", [({"authorization": "y"}, {"set-cookie": "sid=2"})], [("sessionStorage.getItem", "cart"), ("localStorage.getItem", "token")]),
    (500, None, False, None, [], [("localStorage.getItem", " ")]),
]


def _results(spark):
    return spark.createDataFrame(RESULTS, f"status int, attempts int, auth_wall boolean, body string, requests {CALLS}, events array<struct<type:string,key:string>>")


@query("SELECT CAST(3 AS BIGINT) AS results, CAST(0 AS BIGINT) AS challenge_solved, CAST(0 AS BIGINT) AS signature_likely, CAST(1 AS BIGINT) AS auth_wall, CAST(0 AS BIGINT) AS empty_success, CAST(1 AS BIGINT) AS retry_heavy, CAST(2 AS BIGINT) AS non_ok, CAST(6 AS BIGINT) AS drift, CAST(0 AS BIGINT) AS corrections")
def run_signals(spark, sf_dir):
    no = F.lit(None).cast("boolean")
    return snapshots.signals(_results(spark).select("status", "attempts", no.alias("challenge_solved"), F.lit(False).alias("signature_likely"), "auth_wall", no.alias("empty_success"), F.lit(2).alias("drift"), F.lit(None).cast("int").alias("corrections")))


@query("SELECT * FROM (VALUES ('cookie', 'sid', CAST(2 AS BIGINT)), ('cookie', 'lang', 1), ('storage', 'token', 2), ('storage', 'cart', 1)) t(kind, value, n)")
def auth_artefacts(spark, sf_dir):
    return snapshots.auth_artefacts(_results(spark))


@query("SELECT CAST(2 AS BIGINT) AS auth_headers, CAST(1 AS BIGINT) AS login_walls, CAST(1 AS BIGINT) AS expired_sessions")
def auth_counts(spark, sf_dir):
    return snapshots.auth_counts(_results(spark))


@query("SELECT * FROM (VALUES ('wasm', CAST(2 AS BIGINT)), ('web-crypto', 1), ('iframe', 2)) t(signal, n)")
def surface_signals(spark, sf_dir):
    scripts = spark.createDataFrame([("x = WebAssembly.instantiate('a.wasm')",), ("w.postMessage(crypto.subtle.digest())",), (None,)], "preview string")
    events = spark.createDataFrame([("webassembly.compile",), ("window.postMessage",), ("fetch",), (None,)], "type string")
    return snapshots.surface_signals(scripts, events)


@query("SELECT * FROM (VALUES ('a', true, 'accept=x,if-modified-since=Mon,if-none-match=e1'), ('b', false, 'If-None-Match=own'), ('c', false, ''), ('d', false, '')) t(cache_key, conditional, headers)")
def cache_validators(spark, sf_dir):
    requests = spark.createDataFrame([("a", None, {"accept": "x"}), ("b", "get", {"If-None-Match": "own"}), ("c", "POST", None), ("d", "GET", None)], "cache_key string, method string, headers map<string,string>")
    cache = spark.createDataFrame([("a", "e1", "Mon"), ("b", "e2", None), ("c", "e3", "Tue")], "cache_key string, etag string, last_modified string")
    found = snapshots.with_validators(requests, cache)
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.select("cache_key", "conditional", F.array_join(entries, ",").alias("headers"))


@query("SELECT * FROM (VALUES (1, 'interrupted', NULL), (2, 'running', 'w2'), (3, 'completed', 'w3'), (4, 'running', 'w4')) t(id, status, worker)")
def job_leases(spark, sf_dir):
    jobs = spark.createDataFrame([(1, "running", "w1", 100), (2, "running", "w2", 101), (3, "completed", "w3", 5), (4, "running", "w4", None)], "id int, status string, worker string, lease_until long")
    return snapshots.expire_leases(jobs, 100).select("id", "status", "worker")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, CASE WHEN ok THEN 100 ELSE 80 END AS score FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN ok THEN least(100, score + 5) ELSE greatest(0, score - 20) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id::VARCHAR AS key, event_id, score FROM r""")
def proxy_scores(spark, sf_dir):
    """Users' events as reports on proxies: the score after each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis("ts").alias("ms"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return stateful.scores(e).withColumnRenamed("out", "score")
