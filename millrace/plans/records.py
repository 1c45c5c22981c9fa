"""Queries over documents, events, conversations and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, text, url
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
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis("ts"))


_EV = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


@query("SELECT ('0x' || substr(md5(text), 1, 8))::BIGINT % 8 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(url.hash_shard(F.col("text"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 8 AS shard FROM documents")
def shard_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", url.hash_shard(F.col("text"), 8).alias("shard"))


@query("""SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'please') OR contains(lower(role), 'please') ORDER BY conv_id, turn LIMIT 20 OFFSET 5""")
def substring_search_page(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return R.page(c.where(R.matches_query(c, "please")), ["conv_id", "turn"], 5, 20).select("conv_id", "turn")


@query("SELECT doc_id, lang, source FROM documents ORDER BY source, doc_id DESC LIMIT 30 OFFSET 60")
def paged_listing(spark, sf_dir):
    return R.page(table(spark, sf_dir, "documents"), ["source", F.desc("doc_id")], 60, 30).select("doc_id", "lang", "source")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50)")
def tail_n(spark, sf_dir):
    return R.tail(table(spark, sf_dir, "events"), "event_id", 50).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id > 500 AND event_type = 'purchase' ORDER BY event_id LIMIT 40 OFFSET 10")
def event_filter_page_after_sequence(spark, sf_dir):
    return R.events_after(table(spark, sf_dir, "events"), 500, "purchase", "", 10, 40).select("event_id", "user_id")


_Q = "q AS (SELECT event_id, user_id, CAST(user_id % 5 AS BIGINT) AS priority, epoch_us(ts) // 1000 AS enqueued_at, event_type || '-' || event_id AS unique_key, event_type AS lane FROM events)"


def _queue(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", (F.col("user_id") % 5).cast("bigint").alias("priority"), F.col("ms").alias("enqueued_at"), F.concat_ws("-", "event_type", "event_id").alias("unique_key"), F.col("event_type").alias("lane"))


@query(f"WITH {_Q} SELECT unique_key, priority, enqueued_at FROM q ORDER BY priority DESC, enqueued_at, unique_key LIMIT 100")
def priority_queue_order(spark, sf_dir):
    return _queue(spark, sf_dir).orderBy(*R.queue_order()).limit(100).select("unique_key", "priority", "enqueued_at")


@query(f"WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY priority DESC, enqueued_at, unique_key) AS rank FROM q) SELECT lane, rank, unique_key FROM r WHERE rank <= 8")
def lane_head_topk(spark, sf_dir):
    return R.lane_heads(_queue(spark, sf_dir), "lane", 8).select("lane", F.col("rank").cast("bigint").alias("rank"), "unique_key")


@query(f"WITH {_Q} SELECT unique_key, enqueued_at - priority * 1e11 AS score FROM q WHERE lane = 'error'")
def pending_score(spark, sf_dir):
    return _queue(spark, sf_dir).where("lane = 'error'").select("unique_key", R.pending_score(F.col("priority"), F.col("enqueued_at")).alias("score"))


@query(f"""WITH {_Q}, n AS (SELECT user_id, count(*) FILTER (lane = 'error') AS active, count(*) FILTER (lane = 'click') AS recent FROM q GROUP BY 1)
    SELECT unique_key FROM q JOIN n USING (user_id) WHERE lane = 'view' AND active < 3 AND recent < 25""")
def dequeue_eligible(spark, sf_dir):
    q = _queue(spark, sf_dir)
    n = q.groupBy("user_id").agg(F.count_if(F.col("lane") == "error").alias("active"), F.count_if(F.col("lane") == "click").alias("recent"))
    d = q.where("lane = 'view'").join(n, "user_id")
    return R.eligible(d, F.col("active"), 3, F.col("recent"), 25, F.lit(0), F.lit(1)).select("unique_key")


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedup_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "source")
    return R.first_wins(d, ["text_md5"], ["doc_id"])


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1")
def seen_antijoin(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.seen(e, e.where("event_type = 'error'").select("user_id").distinct(), ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) SELECT user_id, min(ms) AS first_seen, max(ms) AS last_seen, arg_max(event_id, ms * 1000000 + event_id) AS latest FROM e GROUP BY 1")
def seen_minmax(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.min("ms").alias("first_seen"), F.max("ms").alias("last_seen"), F.max_by("event_id", F.struct("ms", "event_id")).alias("latest"))


@query("""WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
    SELECT user_id FROM s, n WHERE last_seen >= now - INTERVAL 3 DAY ORDER BY last_seen DESC, user_id LIMIT 50""")
def seen_ttl_evict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = R.record_seen(e, "user_id", "ts", "event_id")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return R.prune_seen(state, now, "3 DAY", 50, "user_id").select("user_id")


@query("SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY 1")
def status_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "purchase", "error", "signup", "view")) + " FROM events GROUP BY 1")
def status_pivot(spark, sf_dir):
    kinds = ["click", "purchase", "error", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0, kinds)


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'view') AS degraded,
    round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events GROUP BY 1""")
def success_rates(spark, sf_dir):
    ok = F.count_if(F.col("event_type") != "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), ok.alias("success"), F.count_if(F.col("event_type") == "view").alias("degraded"), F.round(ok / F.count(F.lit(1)), 6).alias("success_rate"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS low, max(value) AS high FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").where("value is not null").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS label, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def counter_sum(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("bigint").alias("label")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type AS name, arg_max(value, event_id) AS gauge FROM events GROUP BY 1")
def gauge_last(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.max_by("value", "event_id").alias("gauge"))


@query("""WITH h AS (SELECT event_type, round(sum(value), 4) AS total, count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 50) AS b, count(*) FILTER (value <= 100) AS c, count(value) AS d FROM events GROUP BY 1)
    SELECT event_type, total, unnest(['10.0', '50.0', '100.0', '+Inf']) AS le, unnest([a, b, c, d]) AS n FROM h""")
def histogram_buckets(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "events"), "value", (10.0, 50.0, 100.0), ["event_type"])


@query(f"WITH {_EV} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS recent FROM e")
def sliding_budget_count(spark, sf_dir):
    return R.sliding_count(events(spark, sf_dir), "user_id", "ms", 3_600_000).select("event_id", "recent")


@query(f"WITH {_EV}, r AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS k FROM e) SELECT user_id, ms + 3600000 AS release_ms FROM r WHERE k = 5")
def kth_recent_release(spark, sf_dir):
    return R.kth_recent_release(events(spark, sf_dir), "user_id", "ms", 5, 3_600_000)


@query(f"""WITH {_EV}, g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS island FROM e),
    s AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ms, event_id) AS BIGINT) AS streak FROM g)
    SELECT event_id, streak, CAST(CASE WHEN streak > 0 THEN least(60000.0, 1000.0 * power(2.0, streak - 1)) ELSE 0 END AS BIGINT) AS backoff_ms FROM s""")
def failure_streak_backoff(spark, sf_dir):
    return R.failure_streaks(events(spark, sf_dir), "user_id", ["ms", "event_id"], F.col("event_type") == "error").select("event_id", "streak", "backoff_ms")


_MK = r"""CASE WHEN regexp_matches(lower(text), '\b(ping|pong|heartbeat|keepalive|keep_alive)\b') THEN 'heartbeat' WHEN regexp_matches(lower(text), '\b(auth|authorize|authorization|token|login|refresh)\b') THEN 'auth'
    WHEN regexp_matches(lower(text), '\b(subscribe|subscription|subscribed|listen|join|watch|channel)\b') THEN 'subscribe' WHEN regexp_matches(lower(text), '\b(ack|ready|welcome|connected|hello|ok)\b') THEN 'ack'
    WHEN regexp_matches(lower(text), '\b(error|failed|forbidden|unauthorized|denied)\b') THEN 'error' WHEN text IS NULL OR trim(text) = '' THEN 'unknown' ELSE 'data' END"""


@query(f"SELECT conv_id, turn, role, {_MK} AS kind FROM conversations")
def transcript_classify(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", classify.message_kind(F.col("text")).alias("kind"))


@query(f"WITH m AS (SELECT *, {_MK} AS kind FROM conversations) SELECT conv_id, count(*) AS messages, count(*) FILTER (kind = 'data') AS data, count(*) FILTER (kind <> 'data') AS control, count(DISTINCT role) AS roles, min(turn) FILTER (kind = 'data') AS first_data FROM m GROUP BY 1")
def transcript_rollup(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("kind", classify.message_kind(F.col("text")))
    data = F.col("kind") == "data"
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(data).alias("data"), F.count_if(~data).alias("control"), F.countDistinct("role").alias("roles"), F.min(F.when(data, F.col("turn"))).alias("first_data"))


@query(f"WITH m AS (SELECT *, {_MK} AS kind FROM conversations) SELECT conv_id, kind, role, min(turn) AS turn FROM m GROUP BY ALL")
def first_message_by_kind(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("kind", classify.message_kind(F.col("text")))
    return m.groupBy("conv_id", "kind", "role").agg(F.min("turn").alias("turn"))


@query("""WITH a AS (SELECT conv_id, turn, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY role, conv_id ORDER BY turn) AS p FROM conversations)
    SELECT conv_id, turn, CASE WHEN p IS NULL THEN 'first-seen' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS state FROM a""")
def change_state_by_hash(spark, sf_dir):
    w = Window.partitionBy("role", "conv_id").orderBy("turn")
    h = F.md5("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", h.alias("h"), F.lag(h).over(w).alias("p"))
    return c.select("conv_id", "turn", F.when(F.col("p").isNull(), "first-seen").when(F.col("p") == F.col("h"), "unchanged").otherwise("changed").alias("state"))


def _reasons(now, before):
    """Why each row of ``now`` is read again, against the row of ``before`` with the id one less."""
    n = now.select("doc_id", "source", F.md5("text").alias("h"), "n_chars")
    o = before.select((F.col("doc_id") + 1).alias("doc_id"), F.col("source").alias("os"), F.md5("text").alias("oh"), F.col("n_chars").alias("on"), F.lit(1).alias("known"))
    reason = F.when(F.col("known").isNull(), "new-url").when(F.col("os") != F.col("source"), "etag").when(F.col("oh") == F.col("h"), "unchanged").when(F.abs(F.col("n_chars") - F.col("on")) < 0.1 * F.col("on"), "length-threshold").otherwise("content-diff")
    return n.join(o, "doc_id", "left").select("doc_id", reason.alias("reason"))


@query("""SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new-url' WHEN o.source <> n.source THEN 'etag' WHEN md5(o.text) = md5(n.text) THEN 'unchanged' WHEN abs(n.n_chars - o.n_chars) < 0.1 * o.n_chars THEN 'length-threshold' ELSE 'content-diff' END AS reason
    FROM documents n LEFT JOIN documents o ON o.doc_id = n.doc_id - 1""")
def incremental_reason(spark, sf_dir):
    """Every document against the one before it."""
    d = table(spark, sf_dir, "documents")
    return _reasons(d, d)


@query("""WITH p AS (SELECT a.doc_id, unnest([{'f': 'quality', 'o': a.quality, 'n': b.quality}, {'f': 'toxic', 'o': a.toxic, 'n': b.toxic}]) AS x FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, x.f AS field, 'updated' AS kind, x.o AS previous, x.n AS current FROM p WHERE x.o IS DISTINCT FROM x.n""")
def field_diff_explode(spark, sf_dir):
    a, b = table(spark, sf_dir, "labels"), table(spark, sf_dir, "labels")
    j = a.join(b.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("nq"), F.col("toxic").alias("nt")), "doc_id")
    x = j.select("doc_id", F.inline(F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").alias("previous"), F.col("nq").alias("current")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").alias("previous"), F.col("nt").alias("current")))))
    return x.where(~F.col("previous").eqNullSafe(F.col("current"))).select("doc_id", "field", F.lit("updated").alias("kind"), "previous", "current")


@query("""WITH p AS (SELECT unnest([{'f': 'quality', 'o': a.quality, 'n': b.quality}, {'f': 'toxic', 'o': a.toxic, 'n': b.toxic}]) AS x FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1)
    SELECT x.f AS field, count(*) AS n FROM p WHERE x.o IS DISTINCT FROM x.n GROUP BY 1 ORDER BY n DESC, field LIMIT 20""")
def top_changed_fields(spark, sf_dir):
    return R.top_entries(field_diff_explode(spark, sf_dir), "field", 20)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE 'undefined' END AS kind FROM events")
def json_path_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("bigint").alias("k"), text.value_kind(k).alias("kind"))


@query("SELECT user_id, count(DISTINCT event_type) AS shapes, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS shape FROM events GROUP BY 1")
def shape_variants(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("shapes"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("shape"))


_ISSUES = "i AS (SELECT d.doc_id, [CASE WHEN trim(coalesce(d.text, '')) = '' THEN 'missing:text' END, CASE WHEN l.quality IS NULL THEN 'missing:quality' END, CASE WHEN d.n_chars < 200 THEN 'mismatch:n_chars' END] AS x FROM documents d LEFT JOIN labels l USING (doc_id))"


def _issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = F.array_compact(F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "missing:text"), F.when(F.col("quality").isNull(), "missing:quality"), F.when(F.col("n_chars") < 200, "mismatch:n_chars")))
    return d.select("doc_id", "source", x.alias("issues"))


@query(f"WITH {_ISSUES}, f AS (SELECT doc_id, list_filter(x, lambda y: y IS NOT NULL) AS x FROM i) SELECT doc_id, len(x) = 0 AS valid, array_to_string(x, ';') AS issues FROM f")
def schema_validate_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("doc_id", (F.size("issues") == 0).alias("valid"), F.array_join("issues", ";").alias("issues"))


@query("SELECT source, round(count(l.quality) / count(*), 6) AS quality_coverage, round(count(nullif(trim(d.text), '')) / count(*), 6) AS text_coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def field_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("quality_coverage"), F.round(F.count(F.nullif(F.trim("text"), F.lit(""))) / F.count(F.lit(1)), 6).alias("text_coverage"))


@query("""WITH s AS (SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 0) AS bad, count(*) FILTER (l.toxic = 1) AS hot, count(*) FILTER (d.n_chars < 100) AS fail, count(DISTINCT d.lang) AS shapes FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
    SELECT source, CAST(greatest(0, floor(100 - 35.0 * fail / n - 30.0 * bad / n - 20.0 * hot / n - CASE WHEN shapes > 1 THEN 10 ELSE 0 END + 0.5)) AS BIGINT) AS health FROM s""")
def health_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("hot"), F.count_if(F.col("n_chars") < 100).alias("fail"), F.countDistinct("lang").alias("shapes"))
    score = F.floor(100 - 35.0 * F.col("fail") / F.col("n") - 30.0 * F.col("bad") / F.col("n") - 20.0 * F.col("hot") / F.col("n") - F.when(F.col("shapes") > 1, 10).otherwise(0) + 0.5)
    return s.select("source", F.greatest(F.lit(0), score).cast("bigint").alias("health"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)Bearer\\s+[A-Za-z0-9._-]+', 'Bearer ***REDACTED***', 'g'), '(?i)token[=:]\\s*[A-Za-z0-9._-]+', 'token=***REDACTED***', 'g'), '(?i)apikey[=:]\\s*[A-Za-z0-9._-]+', 'apikey=***REDACTED***', 'g'), '(?i)password[=:]\\s*\\S+', 'password=***REDACTED***', 'g')) AS redacted_md5 FROM documents")
def redact_string(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) AS escaped_md5 FROM documents")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_html(F.col("text"))).alias("escaped_md5"))


@query("""SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:00").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 1800000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT user_id, ms, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS s FROM g) SELECT user_id, min(ms) AS start_ms, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    w = F.session_window("ts", "30 minutes")
    return events(spark, sf_dir).groupBy("user_id", w.alias("w")).agg(F.min("ms").alias("start_ms"), F.count(F.lit(1)).alias("n")).select("user_id", "start_ms", "n")
