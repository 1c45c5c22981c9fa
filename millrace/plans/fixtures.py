"""Scalar functions and graph operators on small literal tables, which the shared tables can't exercise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, network, text, udf, url
from ..operators import changes
from ..streaming import runs
from . import compiler

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT * FROM (VALUES (1, CAST(100 AS BIGINT)), (2, 400), (3, 1000), (4, 2000)) t(id, delay_ms)""")
def retry_delay(spark, sf_dir):
    rows = [(1, 1, "fixed", None), (2, 3, "exponential", None), (3, 6, "exponential", None), (4, 3, "exponential", "2")]
    d = spark.createDataFrame(rows, "id int, attempt int, strategy string, retry_after string")
    wait = F.coalesce(text.retry_after_ms(F.col("retry_after"), F.current_timestamp()), F.lit(0))
    return d.select("id", text.retry_delay_ms(F.col("attempt"), F.lit(100), F.col("strategy"), F.lit(1000), wait).alias("delay_ms"))


@query("SELECT * FROM (VALUES (1, CAST(120000 AS BIGINT)), (2, 60000), (3, 0), (4, NULL)) t(id, ms)")
def retry_after_parse(spark, sf_dir):
    rows = [(1, "120"), (2, "Wed, 21 Oct 2015 07:29:00 GMT"), (3, "Wed, 21 Oct 2015 07:00:00 GMT"), (4, "soon")]
    d = spark.createDataFrame(rows, "id int, v string")
    return d.select("id", text.retry_after_ms(F.col("v"), F.lit("2015-10-21 07:28:00").cast("timestamp")).alias("ms"))


ROBOTS = "User-agent: *\r\nDisallow: /a\r\nAllow: /a/b # open\r\nCrawl-delay: 1.5\r\nDisallow: /same\r\nAllow: /same\r\nUser-agent: special\r\nDisallow: /only\r\n"


@query("SELECT * FROM (VALUES ('/a/b/c', true, false, CAST(1500 AS INTEGER)), ('/a/x', false, true, 1500), ('/same', true, true, 1500), ('/only', true, false, 1500), ('/', true, true, 1500)) t(path, allowed, special, delay_ms) WHERE path <> '/a/b/c' UNION ALL SELECT '/a/b/c', true, true, 1500")
def robots_access(spark, sf_dir):
    d = spark.createDataFrame([(p,) for p in ("/a/b/c", "/a/x", "/same", "/only", "/")], "path string")
    link = F.concat(F.lit("https://shop.test"), F.col("path"))
    return d.select("path", udf.robots_allowed(F.lit(ROBOTS), link).alias("allowed"), udf.robots_allowed(F.lit(ROBOTS), link, "special").alias("special"), udf.crawl_delay_ms(F.lit(ROBOTS)).alias("delay_ms"))


@query("SELECT * FROM (VALUES (1, 'https://shop.test/list?a=1&b=2&utm_source=x', 'https://shop.test/list?a=1&b=2', 'POST https://shop.test/list?a=1&b=2&utm_source=x 2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881'), (2, 'http://example.com//a//b/?a=%20x&ref=q&z=1', 'http://example.com/a/b?a=%20x&z=1', 'POST http://example.com//a//b/?a=%20x&ref=q&z=1 2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881'), (3, NULL, 'not a url', NULL)) t(id, unique_key, canonical, post_key) WHERE id < 3 UNION ALL SELECT 3, '', 'not a url', ''")
def url_identity(spark, sf_dir):
    rows = [(1, "https://Shop.Test/list?b=2&utm_source=x&a=1#f"), (2, "HTTP://Example.com:80//a//b/?z=1&ref=q&a=%20x"), (3, "not a url")]
    d = spark.createDataFrame(rows, "id int, u string")
    u = F.col("u")
    broken = url.scheme(u) == ""
    key = lambda c: F.when(broken, "").otherwise(c)
    return d.select("id", key(url.unique_key(u)).alias("unique_key"), url.canonical(u).alias("canonical"), key(url.unique_key(u, F.lit("POST"), F.lit("x"))).alias("post_key"))


LINKS = [
    ("https://s.test/?page=2", None, None, None), ("https://s.test/x", "next", None, None), ("https://s.test/x", "canonical", None, None), ("https://s.test/f.pdf", None, None, None), ("https://s.test/logout", None, None, None),
    ("https://s.test/api/x", None, None, None), ("https://s.test/?q=z", None, None, None), ("https://s.test/category/x", None, None, None), ("https://s.test/product/1", None, None, None), ("https://s.test/other", None, None, None),
    ("https://s.test/a", None, "Sign out", None), ("https://s.test/b", None, "Load more", None), ("https://s.test/c", None, "Search here", None), ("https://s.test/d", None, "research", None), ("https://s.test/e", "alternate", None, "de"), ("https://s.test/data.json", None, None, None), ("https://s.test/t.woff", None, None, None),
]


@query("""SELECT * FROM (VALUES (0, 'pagination', 85), (1, 'pagination', 85), (2, 'canonical', NULL), (3, 'asset', NULL), (4, 'logout', NULL), (5, 'api', 30), (6, 'search', 40), (7, 'listing', 45), (8, 'detail', 70), (9, 'generic', NULL),
    (10, 'logout', NULL), (11, 'pagination', 85), (12, 'search', 40), (13, 'generic', NULL), (14, 'alternate-language', NULL), (15, 'asset', NULL), (16, 'generic', NULL)) t(id, kind, priority)""")
def link_priority(spark, sf_dir):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(LINKS)], "id int, u string, rel string, t string, lang string")
    d = d.withColumn("kind", classify.link_kind(F.col("u"), F.col("rel"), F.col("lang"), None, F.col("t")))
    return d.select("id", "kind", classify.link_priority(F.col("kind")).alias("priority"))


SITE = """<html><head><link rel="canonical" href="/self"><link rel="alternate" hreflang="de" href="/de"></head><body>
<a href="/a">One</a> <a href="/a#again">Same page, other place</a> <a href="/files/list.csv">Table</a> <a href="https://other.test/x">Off</a> <a href="/bye">Log out</a>
<a href="/ads" rel="nofollow sponsored">Ad</a> <a href="/product/7">Mug</a> <a href="/skip/me">Skip</a> <a rel="next" href="/?page=2">Older</a></body></html>"""
MAP = "<?xml version='1.0'?><urlset><url><loc>https://s.test/p/1</loc></url><url><loc>https://s.test/news.xml</loc></url></urlset>"
FEED = "<rss><channel><item><title>x</title><link><![CDATA[https://s.test/n?a=1&b=2]]></link></item></channel></rss>"


@query("""SELECT * FROM (VALUES ('https://s.test/', 'discovery', 'https://s.test/a', 'generic', NULL, NULL), ('https://s.test/', 'discovery', 'https://s.test/a#again', 'generic', NULL, NULL), ('https://s.test/', 'discovery', 'https://s.test/product/7', 'detail', 5, 'shop'),
    ('https://s.test/', 'discovery', 'https://s.test/?page=2', 'pagination', 85, 'pagination'), ('https://s.test/map', 'sitemap', 'https://s.test/p/1', 'pagination', 85, 'pagination'), ('https://s.test/map', 'sitemap', 'https://s.test/news.xml', 'sitemap', 90, 'sitemap'),
    ('https://s.test/feed', 'feed', 'https://s.test/n?a=1&b=2', 'generic', NULL, NULL)) t(parent, source, url, kind, priority, label)""")
def link_discovery(spark, sf_dir):
    """Pages, a sitemap and a feed: gates by kind, nofollow, a rule that skips and one that names."""
    plan = {"name": "s", "discovery": {"respectNoFollow": True, "rules": [{"pattern": "/skip/", "action": "skip"}, {"pattern": "/product/", "priority": 5, "label": "shop"}]}}
    pages = spark.createDataFrame([("https://s.test/", SITE), ("https://s.test/map", MAP), ("https://s.test/feed", FEED)], "url string, body string")
    return compiler.discover(plan, pages).select("parent", "source", "url", "kind", "priority", "label")


@query("SELECT * FROM (VALUES (1, 'data', 148), (2, '', 97), (3, '', -8), (4, NULL, NULL)) t(id, path, score)")
def json_primary_value(spark, sf_dir):
    """The part of a JSON answer that holds its data."""
    rows = [(1, '{"data":{"items":[{"id":1},{"id":2}]}}'), (2, '{"ok":true,"items":[{"a":1}]}'), (3, "[]"), (4, "not json")]
    return spark.createDataFrame(rows, "id int, body string").select("id", network.primary_value(F.col("body")).alias("v")).select("id", "v.path", "v.score")


@query("""SELECT * FROM (VALUES (1, 'object'), (2, 'array'), (3, 'string'), (4, 'number'), (5, 'boolean'), (6, 'null'), (7, 'undefined')) t(id, kind)""")
def json_type_of(spark, sf_dir):
    d = spark.createDataFrame(list(enumerate(['{"a":1}', "[1]", '"x"', "-1.5", "true", "null", None], 1)), "id int, v string")
    return d.select("id", text.value_kind(F.col("v")).alias("kind"))


@query("""SELECT * FROM (VALUES ('a.b[0]', 'updated', '1', '2'), ('a.b[1]', 'added', NULL, '3'), ('c', 'removed', '"x"', NULL), ('d', 'added', NULL, 'null')) t(path, kind, previous, current)""")
def json_field_diff(spark, sf_dir):
    d = spark.createDataFrame([('{"a":{"b":[1]},"c":"x"}', '{"a":{"b":[2,3]},"d":null}')], "p string, c string")
    return d.select(F.inline(udf.json_diff(F.col("p"), F.col("c"))))


@query("SELECT * FROM (VALUES (1, CAST(93784.5 AS DOUBLE)), (2, 300.0), (3, NULL)) t(id, seconds)")
def iso_duration(spark, sf_dir):
    d = spark.createDataFrame([(1, "P1DT2H3M4.5S"), (2, "PT5M"), (3, "5 minutes")], "id int, v string")
    return d.select("id", text.iso_duration_seconds(F.col("v")).alias("seconds"))


@query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 1), ('d', 2), ('x', NULL), ('y', NULL)) t(id, wave)")
def dag_waves(spark, sf_dir):
    nodes = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a"]), ("d", ["b", "c"]), ("x", ["y"]), ("y", ["x"])], "id string, depends_on array<string>")
    return changes.dag_waves(spark, nodes, runs.store(spark))


@query("SELECT * FROM (VALUES ('add-field', 'price', 2), ('widen-field', 'name', 2)) t(change, field, version)")
def schema_evolve(spark, sf_dir):
    _, version, log = changes.evolve_schema({"name": ["string"]}, 1, {"name": ["string", "null"], "price": ["number"]})
    return spark.createDataFrame([(k, f, version) for k, f in log], "change string, field string, version int")


@query("SELECT * FROM (VALUES ('u0', 0), ('u1', 1), ('u2', 1), ('u3', 2)) t(url, depth)")
def frontier_breadth_first(spark, sf_dir):
    edges = spark.createDataFrame([("u0", "u1"), ("u0", "u2"), ("u1", "u3"), ("u2", "u3"), ("u3", "u0"), ("u3", "u4")], "parent string, url string")
    return changes.breadth_first(spark, edges, spark.createDataFrame([("u0",)], "url string"), 2, runs.store(spark))


@query("SELECT * FROM (VALUES ('k1', 'unchanged'), ('k2', 'changed'), ('k3', 'first-seen')) t(key, content_state)")
def change_tracking_run(spark, sf_dir):
    state = spark.createDataFrame([("k1", "old", '{"a":1}'), ("k2", "old", '{"a":1}')], "key string, body string, extracted string")
    run = spark.createDataFrame([("k1", None, None, 304), ("k2", "new", '{"a":2}', 200), ("k3", "x", '{"a":1}', 200)], "key string, body string, extracted string, status int")
    return changes.apply_run(state, run)[0].select("key", "content_state")


@query("SELECT * FROM (VALUES (1, 'Mug & \"cup\" <b>'), (2, '&lt;')) t(id, text)")
def xml_entities(spark, sf_dir):
    d = spark.createDataFrame([(1, "Mug &amp; &quot;cup&quot; &lt;b&gt;"), (2, "&amp;lt;")], "id int, v string")
    return d.select("id", text.decode_entities(F.col("v")).alias("text"))


@query("SELECT * FROM (VALUES (1, 'login', 'https://s.test/?token=***REDACTED***&a=1', 'Bearer ***REDACTED*** and password=***REDACTED***')) t(id, slug, url, text)")
def redaction(spark, sf_dir):
    d = spark.createDataFrame([(1, "https://Login/", "https://s.test/?token=abc&a=1", "bearer abc.def and Password: hunter2")], "id int, s string, u string, t string")
    return d.select("id", url.slug(F.col("s")).alias("slug"), url.redact(F.col("u")).alias("url"), text.redact(F.col("t")).alias("text"))
