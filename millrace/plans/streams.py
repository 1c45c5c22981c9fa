"""Streaming queries over the events table, run to the end of their input, and plan-time templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import template as T
from ..streaming import runs, stateful

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def stream(spark, sf_dir):
    e = runs.read_events(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("key"), F.unix_millis("ts").alias("ms"), "event_id", "ts", F.md5("event_type").alias("hash"), "event_type")


@query("""SELECT user_id::VARCHAR AS key, event_id, CASE WHEN p IS NULL THEN 'first-seen' WHEN p = event_type THEN 'unchanged' ELSE 'changed' END AS state
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS p FROM events)""")
def stream_change_state(spark, sf_dir):
    return runs.run_to_end(stateful.stream_change_states(stream(spark, sf_dir).select("key", "ms", "event_id", "hash"))).withColumnRenamed("out", "state")


@query("SELECT DISTINCT user_id::VARCHAR AS key, event_type FROM events")
def stream_dedup(spark, sf_dir):
    s = stream(spark, sf_dir).select("key", "event_type", "ts")
    return runs.run_to_end(stateful.dedup_stream(s, "ts", ["key", "event_type"], "4000 days").select("key", "event_type"))


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS d, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max(ts) AS m FROM events)
    SELECT event_type, strftime(d, '%Y-%m-%d') AS day, n FROM w, m WHERE d + INTERVAL 1 DAY <= m - INTERVAL 10 MINUTE""")
def stream_daily_counts(spark, sf_dir):
    """Finished windows only: what the watermark hasn't closed isn't given out."""
    w = stateful.windowed_counts(stream(spark, sf_dir), "ts", ["event_type"], "1 day", "10 minutes")
    return runs.run_to_end(w).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


BUCKET = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, ms, 1::DOUBLE AS tokens, ms AS last FROM e WHERE n = 1 UNION ALL
      SELECT user_id, event_id, n, ms, least(2.0::DOUBLE, have + wait / 1000 * 0.001::DOUBLE) * (wait > 0)::INT + have * (wait = 0)::INT - 1, start + wait::BIGINT FROM
      (SELECT *, CASE WHEN have >= 1 THEN 0::DOUBLE ELSE ceil((1 - have) * 1000 / 0.001::DOUBLE) END AS wait FROM
      (SELECT e.user_id, e.event_id, e.n, e.ms, greatest(e.ms, r.last) AS start, least(2.0::DOUBLE, r.tokens + (greatest(e.ms, r.last) - r.last)::DOUBLE / 1000 * 0.001::DOUBLE) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
    SELECT user_id::VARCHAR AS key, event_id, last - ms AS wait_ms FROM r"""


@query(BUCKET)
def stream_token_bucket(spark, sf_dir):
    return runs.run_to_end(stateful.stream_token_bucket(stream(spark, sf_dir).select("key", "ms", "event_id"), 0.001, 2.0)).withColumnRenamed("out", "wait_ms")


@query("SELECT event_id, '/u/' || user_id || '?k=' || coalesce(json_extract_string(props, '$.k'), '') || '&x=' AS link FROM events")
def replay_template(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = F.to_json(F.struct(F.struct("user_id").alias("u"), F.from_json("props", "k bigint").alias("p")))
    return e.select("event_id", T.interpolate("/u/{{ u.user_id }}?k={{p.k}}&x={{ none.such }}", state).alias("link"))


@query("SELECT * FROM (VALUES ('/shop/12/item', 'item', '12'), ('/shop/12/a/b', 'deep', NULL), ('/other', 'default', NULL)) t(path, name, id)")
def route_globs(spark, sf_dir):
    d = spark.createDataFrame([("/shop/12/item",), ("/shop/12/a/b",), ("/other",)], "path string")
    p = F.col("path")
    return d.select("path", T.route(p, [("item", "/shop/:id/item"), ("deep", "/shop/**")]).alias("name"), T.glob_match(p, "/shop/:id/item")["id"].alias("id"))


@query("SELECT * FROM (VALUES (1, 'é.txt'), (2, 'plain.pdf'), (3, NULL)) t(id, name)")
def disposition_names(spark, sf_dir):
    d = spark.createDataFrame([(1, "attachment; filename=\"x.txt\"; filename*=UTF-8''%C3%A9.txt"), (2, "attachment; filename=plain.pdf"), (3, "inline")], "id int, h string")
    return d.select("id", T.disposition_name(F.col("h")).alias("name"))


@query("""SELECT * FROM (VALUES (1, 'captcha_challenge', 'captcha', true, false), (2, 'login_page', 'login-form', true, false), (3, 'authenticated', 'session-artifacts', false, true), (4, 'unknown', NULL, false, false), (5, 'unknown', NULL, false, false),
    (6, 'manual_required', 'qr-login', false, true), (7, 'sso_redirect', 'oauth-sso-redirect', true, false), (8, 'expired', 'auth-expired', true, false), (9, 'risk_challenge', 'account-risk', false, true), (10, 'mfa_challenge', 'mfa', true, false),
    (11, 'redirecting', 'http-redirect', true, false), (12, 'authenticated', 'session-artifacts', false, true), (13, 'login_page', 'login-form', true, false), (14, 'manual_required', 'passkey-webauthn', false, true)) t(id, state, reason, recoverable, terminal)""")
def login_states(spark, sf_dir):
    rows = [
        (1, "Solve the CAPTCHA to log in", "https://s.test/", 200, False), (2, "Welcome back", "https://s.test/login", 200, False), (3, "My account", None, None, None), (4, "Blue mug", "https://s.test/", 200, False), (5, None, None, None, None),
        (6, "Scan to login", "https://s.test/", 200, False), (7, "", "https://s.test/oauth/start", 302, False), (8, "no", "https://s.test/", 401, True), (9, "no", "https://s.test/", 423, True), (10, "Enter the OTP", "https://s.test/login", 200, False),
        (11, "", "https://s.test/x", 302, False), (12, "Blue mug", "https://s.test/", 200, True), (13, '<input name="p" type="password">', "https://s.test/", 200, False), (14, "Use a passkey or the captcha", "https://s.test/", 200, False),
    ]
    d = spark.createDataFrame(rows, "id int, t string, u string, status int, session boolean")
    seen = d.select("id", T.login_state(F.col("t"), F.col("u"), F.col("status"), F.col("session")).alias("s"))
    return seen.select("id", "s.state", "s.reason", "s.recoverable", "s.terminal")


@query("SELECT * FROM (VALUES (1, 'websocket'), (2, 'feed'), (3, 'sitemap'), (4, 'graphql'), (5, 'json'), (6, 'html'), (7, 'binary')) t(id, kind)")
def source_kinds(spark, sf_dir):
    rows = [(1, "wss://s.test", None, None), (2, "https://s.test/x", None, "<?xml version='1.0'?><rss>"), (3, "https://s.test/x", "text/xml", "<urlset>"), (4, "https://s.test/graphql", "application/json", "{}"), (5, "https://s.test/x", None, "[1]"), (6, "https://s.test/x", "text/html", ""), (7, "https://s.test/x", "image/png", "PNG")]
    d = spark.createDataFrame(rows, "id int, u string, c string, b string")
    return d.select("id", T.source_kind(F.col("u"), F.col("c"), F.col("b")).alias("kind"))


@query("SELECT * FROM (VALUES (1, 40, 40), (2, NULL, 80), (3, 1000, 1000), (4, -3, -3)) t(id, given, used)")
def queue_priorities(spark, sf_dir):
    d = spark.createDataFrame([(1, "40", "seed", 0), (2, None, "sitemap", 2), (3, "5000", "seed", 1), (4, "-3x", "link", 3)], "id int, p string, s string, d int")
    given = F.when(F.col("p").isNotNull(), T.normalize_priority(F.col("p")))
    return d.select("id", given.alias("given"), T.queue_priority(given, F.col("s"), F.col("d"), {"seed": 100, "sitemap": 90, "link": 50}).alias("used"))
