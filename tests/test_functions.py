"""URLs, markup, robots, wire formats, sinks, sources, plans and streams on small literal inputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import text, udf, url, web, wire
from millrace.operators import changes, dedup, history, relational, sinks
from millrace.plans import compiler
from millrace.sources import readers
from millrace.streaming import stateful

PAGE = """<html><head><title> Blue
 mug </title><link rel="next" href="/p/2"><meta property="og:image" content="/og.png">
<script type="application/ld+json">{"@type":"AudioObject","name":"Song","contentUrl":"/s.bin"}</script><script>var a = "<p>x</p>";</script></head>
<body><div id="m" class="a b"><p>one<p>two <b>bold</b><ul><li>x<li class="last">y</ul></div><a href="/q?b=2&amp;a=1">go</a><a href="#top">top</a>
<img src="i.jpg" alt="pic" srcset="i2.jpg 2x, i3.jpg 3x"><img data-src="lazy.webp"><video src="v.mp4" poster="p.png"></video><picture><source srcset="w.avif"></picture><a href="t.flac">tune</a><div style="background:url('bg.gif')"></div><img src="i.jpg"></body>"""


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_html_engine():
    root = web.parse_html(PAGE)
    assert web.css(PAGE, "title") == ["Blue mug"]
    assert web.css(PAGE, "#m > p") == ["one", "two bold"]
    assert web.css(PAGE, "div.a.b li:last-child, li.last") == ["y"]
    assert web.css(PAGE, "li:nth-of-type(1)") == ["x"] and web.css(PAGE, 'a[href^="/q"]', "href", "https://s.test/x/") == ["https://s.test/q?b=2&a=1"]
    assert web.xpath(root, "//li[2]") == ["y"] and web.xpath(root, '//div[@id="m"]/p[1]/text()') == ["one"] and web.xpath(root, "//title | //a/@href")[1:] == ["/q?b=2&a=1", "#top", "t.flac"]
    assert web.next_page(PAGE, "https://s.test/p/1") == "https://s.test/p/2"
    assert web.css(None, "a") == [] and web.parse_html("<p>cut <b").elements() is not None


def test_media_assets():
    got = web.media_assets(PAGE, "https://s.test/d/")
    assert [(a["kind"], a["url"].removeprefix("https://s.test/")) for a in got] == [
        ("image", "d/i.jpg"), ("image", "d/i2.jpg"), ("image", "d/i3.jpg"), ("image", "d/lazy.webp"), ("video", "d/v.mp4"), ("image", "d/p.png"), ("image", "d/w.avif"),
        ("audio", "d/t.flac"), ("image", "d/bg.gif"), ("image", "og.png"), ("audio", "s.bin"),
    ]


@pytest.mark.parametrize("link,base,want", [("/a b", "https://S.test:443/x", "https://s.test/a%20b"), ("é", "http://s.test/", "http://s.test/%C3%A9"), ("", None, None), ("mailto:x@y.z", "http://s.test", "mailto:x@y.z"), (None, "http://s.test", None), ("http://[", "http://s", None)])
def test_resolve(link, base, want):
    assert web.resolve(link, base) == want


def test_feeds_and_manifests():
    rss = "<rss><channel><item><title>A</title><link>/a</link></item></channel></rss>"
    assert web.feed_items(rss) == [{"title": "A", "link": "/a", "description": None, "published": None}] and web.feed_items("<rss") == []
    m = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=100\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900\nhigh.m3u8"
    assert [v["url"] for v in web.hls_variants(m, "https://s.test/")] == ["https://s.test/high.m3u8", "https://s.test/low.m3u8"]


def test_wire():
    assert [wire.encode_varint(n).hex() for n in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    f = wire.fields(bytes.fromhex("089601120774657374696e67"))
    assert [(x["field"], x["type"], wire.show(x["value"])) for x in f] == [(1, "uint32", "150"), (2, "string", "testing")]
    assert wire.frames(bytes.fromhex("0000000003089601"))[0]["message"].hex() == "089601" and wire.frames(b"\0\0\0\0\5x") == []
    with pytest.raises(ValueError):
        wire.frames(b"\0\0\0\0\5x", strict=True)
    with pytest.raises(ValueError):
        wire.fields(b"\x0a\x05x", strict=True)
    assert wire.fields(b"\x0a\x05x") == []
    big = wire.encode({1: (1 << 63) + 5, 2: {1: 7, 2: "in"}, 3: [1, 2], 4: 1.5})
    assert [x["value"] for x in wire.fields(big)][0] == (1 << 63) + 5 and [x["type"] for x in wire.fields(big)] == ["int64", "message", "bool", "uint32", "double"]
    assert [(x["field"], x["type"], x["repeated"]) for x in wire.infer([big, big])] == [(1, "int64", False), (2, "message", False), (3, "bool", True), (4, "double", False)]


def test_url_columns(spark):
    d = spark.createDataFrame([("https://u:p@Www.Shop.co.UK:8443/a/b.Tar.gz?x=1#f",), ("http://10.0.0.1/",), ("https://s.test/list/page/3?z=1",), (None,)], "u string")
    u = F.col("u")
    got = rows(d.select(url.host(u), url.registrable_domain(url.host(u)), url.extension(u), url.origin(u), url.next_page(u)))
    assert got[0] == ("www.shop.co.uk", "shop.co.uk", ".gz", "https://www.shop.co.uk:8443", None)
    assert got[1][1] == "10.0.0.1" and got[2][4] == "https://s.test/list/page/4?z=1" and got[3] == (None,) * 5


def test_bloom(spark):
    assert dedup.bloom_size(1000, 0.01) == (9586, 7)
    d = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    built = dedup.bloom_build(d.where("id < 1000"), "k", 1000, 0.01)
    got = rows(dedup.bloom_contains(d, "k", built, 1000, 0.01).groupBy(F.col("id") < 1000).agg(F.sum(F.col("maybe").cast("int"))))
    assert dict(got)[True] == 1000 and dict(got)[False] < 50
    keys = pd.Series(["", "k", "key é 漢字 🙂", "k" * 300])
    assert dedup.bloom_places(keys, 9586, 7).tolist() == [[dedup.fnv1a(k, (i * 0x9E3779B9) & 0xFFFFFFFF) % 9586 for i in range(7)] for k in keys]
    mixed = d.select("k").unionAll(d.select("k").limit(3)).unionByName(spark.createDataFrame([(None,)], "k string"))
    small, large = (sorted(map(str, rows(dedup.bloom_contains(mixed, "k", built, 1000, 0.01, broadcast_bytes=n)))) for n in (1 << 26, 1))
    assert small == large and len(small) == 2004


def test_bloom_asks_all_documents(spark, tmp_path):
    from millrace.plans import markup

    docs, labels = spark.range(6000).withColumnRenamed("id", "doc_id"), spark.range(0, 6000, 3).withColumnRenamed("id", "doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert dict(rows(markup.bloom_membership(spark, str(tmp_path)))) == {i: i % 3 == 0 for i in range(6000)}
    got = {r["doc_id"]: r["maybe"] for r in markup.bloom_asked(markup._keys(labels), markup._keys(docs)).collect()}
    assert len(got) == 6000 and all(got[i] for i in range(0, 6000, 3))
    assert 4 <= sum(got[i] for i in range(6000) if i % 3) <= 120  # of 4000; a filter with room for many more keys would make none
    labels.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert not any(dict(rows(markup.bloom_membership(spark, str(tmp_path)))).values())


def test_discovery_counts_after_filters(spark):
    """A page whose first 150 links lead elsewhere keeps the one that does not; at most maxLinksPerPage are kept."""
    far = "".join(f'<a href="https://other.test/{i}">x</a>' for i in range(150))
    pages = spark.createDataFrame([("https://s.test/", far + '<a href="/in">in</a>'), ("https://s.test/many", "".join(f'<a href="/l{i}">x</a>' for i in range(80)))], "url string, body string")
    got = compiler.discover({"name": "x"}, pages).collect()
    assert [r["url"] for r in got if r["parent"] == "https://s.test/"] == ["https://s.test/in"]
    assert [r["url"] for r in got if r["parent"] != "https://s.test/"] == [f"https://s.test/l{i}" for i in range(50)]
    open_ = {"name": "x", "discovery": {"skipLogout": False, "skipAssetLinks": False, "enqueueCanonical": True, "enqueueAlternateLanguages": True, "fileExtensions": [".csv"]}}
    from millrace.plans.fixtures import SITE

    kinds = {r["kind"] for r in compiler.discover(open_, spark.createDataFrame([("https://s.test/", SITE.replace("list.csv", "a.pdf").replace("/bye", "/b.csv"))], "url string, body string")).collect()}
    assert kinds == {"canonical", "alternate-language", "asset", "generic", "detail", "pagination"}
    assert compiler.discover({"name": "x"}, pages.limit(0)).count() == 0


def test_network_ranking():
    from millrace.functions import network

    assert network.endpoint("https://s.test/api/v2/search?q=1", "POST") == (14 + 10 + 4, "api-data", ["api-path", "content-endpoint", "post-request"])
    assert network.endpoint("https://s.test/x", "POST", '{"operationName":"a"}')[:2] == (40, "graphql")
    assert network.endpoint("https://s.test/health/ping")[:2] == (-18, "health")
    assert [network.shape_score(x) for x in ([], {}, "ok", "", "x" * 400, True, 3, None, [[1], {}], {"error": 1}, {"errors": 1, "token": 2, "x": 3})] == [-8, -10, -10, -8, 10, -6, 1, 0, 52, -25, -17]
    calls = [{"url": "https://s.test/a", "transport": "xhr", "body": "{}"}, {"url": "https://s.test/b", "transport": "fetch", "body": "<p>"}, {"url": "https://s.test/c", "transport": "websocket", "body": "{}"}]
    assert [c["url"][-1] for c in network.rank_calls(calls)] == ["a"] and [c["url"][-1] for c in network.rank_calls(calls, require_json=False, prefer=("/b$",))] == ["b", "a"]
    best = network.rank_calls([{"url": "/x", "transport": "fetch", "status": 200, "body": '{"data":{"items":[{"id":1}]}}'}], select="primary-data")[0]
    assert best["data_path"] == "data" and json.loads(best["payload"]) == {"items": [{"id": 1}]}


def test_reasons_of_all_documents(spark, tmp_path):
    from millrace.plans import records

    d = [(1, "s", "a", 100), (2, "s", "a", 100), (3, "s", "b", 105), (4, "s", "c", 300), (5, "t", "c", 300), (8, "t", "c", 300)]
    spark.createDataFrame(d, "doc_id bigint, source string, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(rows(records.incremental_reason(spark, str(tmp_path)))) == {1: "new-url", 2: "unchanged", 3: "length-threshold", 4: "content-diff", 5: "etag", 8: "new-url"}


def test_json_changes(spark):
    d = spark.createDataFrame([('{"b":1.0,"a":[1,{"c":null}]}', "{")], "x string, y string")
    assert rows(d.select(udf.stable_json(F.col("x")), udf.stable_json(F.col("y")))) == [('{"a":[1,{"c":null}],"b":1}', None)]


def test_change_runs(spark):
    empty = spark.createDataFrame([], "key string, body string, extracted string")
    run = lambda *r: spark.createDataFrame(list(r), "key string, body string, extracted string, status int")
    a, state = changes.apply_run(empty, run(("u", "v1", '{"n":1}', 200)))
    assert rows(a) == [("u", "first-seen", None)]
    b, state = changes.apply_run(state, run(("u", None, None, 304)))
    assert rows(b)[0][1] == "unchanged"
    c, state = changes.apply_run(state, run(("u", "v2", '{"n":2}', 200), ("w", "x", "{}", 200)))
    got = {r["key"]: r for r in c.collect()}
    assert got["u"]["content_state"] == "changed" and tuple(got["u"]["changes"][0]) == ("n", "updated", "1", "2") and got["w"]["content_state"] == "first-seen"
    assert sorted(r["key"] for r in state.collect()) == ["u", "w"]


def test_relational(spark):
    d = spark.createDataFrame([(1, "b", 1), (2, "a", 2), (3, "a", 1), (4, None, 5)], "id int, k string, v int")
    assert sorted(rows(relational.first_wins(d.where("k is not null"), ["k"], ["id"]))) == [("a", 2, 2), ("b", 1, 1)]
    assert sorted(rows(relational.upsert(d.where("id < 3").select("k", "id", "v"), d.where("id = 3").select("k", "id", "v"), ["k"], "id"))) == [("a", 3, 1), ("b", 1, 1)]
    assert rows(relational.page(d, ["id"], -5, 0)) == [(1, "b", 1)] and relational.top_entries(d, "k").first()["k"] == "a"
    assert rows(d.agg(relational.nearest_rank("v", 50), relational.nearest_rank("v", 95))) == [(1, 5)]
    assert d.where(relational.matches_query(d, '"K":"B"')).count() == 1


def test_baseline_alerts(spark):
    d = spark.createDataFrame([(6, 10, 8, 10, 1, 0, 65, 80)], "p int, pp int, r int, pr int, f int, pf int, h int, ph int")
    a = history.baseline_alerts(*[F.col(c) for c in ("p", "pp", "r", "pr", "f", "pf", "h", "ph")])
    assert rows(d.select(a)) == [(["pages-fetched-drop", "failure-count-increase", "health-score-drop"],)]


def test_sinks(spark, tmp_path):
    items = ['{"a":{"b":1,"c":{}},"l":[1,2],"q":"x\\"y"}', '{"a":null,"n":"p,q"}']
    d = spark.createDataFrame([(i,) for i in items], "item string").coalesce(1)
    names = sinks.headers(d)
    assert names == ["a", "a.b", "l", "n", "q"]
    assert [r[0] for r in sinks.csv_lines(d, names).collect()] == [',1,"[1,2]",,"x""y"', ',,,"p,q",']
    assert [r[0] for r in sinks.csv_lines(d, names, "all").collect()][1] == '"","","","p,q",""'
    sinks.write_jsonl(d, f"{tmp_path}/j", "item")
    assert spark.read.text(f"{tmp_path}/j").count() == 2
    sinks.write_sharded(spark.range(50).select("id", F.col("id").cast("string").alias("k")), f"{tmp_path}/s", "k", 4)
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 4
    d = spark.createDataFrame([("héllo",), ("abc",), (None,)], "t string")
    assert [tuple(r[0]) for r in d.select(sinks.truncate_bytes(F.col("t"), 2)).collect()][:2] == [("h", True), ("ab", True)]
    m = sinks.batches_to(spark.range(10).coalesce(1), lambda rows_: None, 4).collect()
    assert [(r["rows"], r["attempts"], r["error"]) for r in m] == [(4, 1, None), (4, 1, None), (2, 1, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}\nnot json\n{"a":2}\n')
    (tmp_path / "ok.json").write_text('{"a":1}\n{"a":2}\n')
    p = f"{tmp_path}/x.json"
    assert readers.ndjson(spark, p, "a int").where("a is not null").count() == 2
    assert readers.ndjson_all_or_nothing(spark, p, "a int").count() == 0 and readers.ndjson_all_or_nothing(spark, f"{tmp_path}/ok.json", "a int").count() == 2
    import sqlite3

    c = sqlite3.connect(f"{tmp_path}/d.db")
    c.execute("create table t (id integer, name text, score real)")
    c.executemany("insert into t values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(100)])
    c.commit()
    source = readers.sqlite_table(f"{tmp_path}/d.db", "t")
    spark.dataSource.register(source)
    df = spark.read.format(source.name()).load()
    assert df.count() == 100 and df.agg(F.sum("score")).first()[0] == 2475.0


def test_plans(spark):
    with pytest.raises(compiler.PlanError):
        compiler.validate({"name": "x", "extract": [{"name": "a", "type": "script"}]})
    plan = {"name": "x", "extract": [{"name": "id", "type": "regex", "pattern": r"id=(\d+)"}, {"name": "tags", "type": "regex", "pattern": r"#\w+", "all": True}, {"name": "t", "type": "css", "selector": "title"}, {"name": "j", "type": "json", "path": "a.0.b"}],
            "quality": {"schema": {"required": ["id", "t", "none"], "types": {"id": "number", "tags": "string"}}}}
    d = spark.createDataFrame([("https://s.test", "<title>T</title> id=7 #x #y"), ("https://s.test/2", '{"a":[{"b":5}]}')], "url string, body string")
    got = compiler.assess(plan, compiler.extract(plan, d)).orderBy("url").collect()
    assert tuple(got[0]["extracted"]) == ("7", ["#x", "#y"], "T", None) and got[0]["issues"] == ["missing:none", "type:tags"]
    assert got[1]["extracted"]["j"] == "5" and "missing:id" in got[1]["issues"] and not got[1]["valid"]
    links = compiler.discover({"name": "x"}, spark.createDataFrame([("https://s.test/", PAGE)], "url string, body string")).collect()
    assert [r["url"] for r in links][:2] == ["https://s.test/p/2", "https://s.test/q?b=2&a=1"] and links[0]["kind"] == "pagination"  # the head names the next page


def test_token_bucket_fold():
    r = pd.DataFrame({"ms": [0, 0, 0, 1000]})
    out, tokens, last = stateful.fold_bucket(r, 2.0, None, 1.0, 2.0)
    assert out == [0, 0, 1000, 1000] and last == 2000
    half, t, at = stateful.fold_bucket(r[:2], 2.0, None, 1.0, 2.0)
    assert half + stateful.fold_bucket(r[2:], t, at, 1.0, 2.0)[0] == out


def test_autoscale_means(spark):
    """Plain sums in order, over batch borders, with ties at the limit and nulls; as the query's SQL has them."""
    import duckdb

    from millrace.plans import markup

    tie = [61.42, 109.31, 23.59, 45.68]  # 240.00000000000003 in order, 240 when compensated
    assert sum(tie) == 240 < ((tie[0] + tie[1]) + tie[2]) + tie[3]
    e = pd.DataFrame([("1", i, v, 0) for i, v in enumerate(tie)], columns=["key", "event_id", "value", "failed"]).assign(ms=0)
    e["ms"] = e["event_id"]
    assert [r["out"] for r in stateful.autoscale(spark.createDataFrame(e), slow_ms=60.0).orderBy("event_id").collect()] == [1, 1, 1, 1]  # not 2 at the end
    c = duckdb.connect()
    c.execute("create table events as select i as event_id, make_timestamp(i * 1000000) as ts, i % 3 as user_id, case when i % 7 = 0 then null when i % 4 = 0 then 'error' else 'view' end as event_type, case when i % 11 > 0 then (i * 37) % 120 + 0.25 end as value from range(200) t(i)")
    want = sorted(c.execute(markup.SQL["autoscale_replay"]).fetchall())
    e = c.execute("select user_id::varchar as key, epoch_us(ts) // 1000 as ms, event_id, coalesce(value, 0)::double as value, (event_type = 'error')::int as failed from events").fetchall()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = stateful.autoscale(spark.createDataFrame(e, "key string, ms long, event_id long, value double, failed int"), slow_ms=60.0)
        assert sorted(rows(got)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_streams_match_replays(spark, tmp_path):
    e = [("a" if i % 3 else "b", i * 700, i, f"h{i // 4 % 3}") for i in range(60)]
    schema = "key string, ms long, event_id long, hash string"
    for k in range(3):  # three files are three batches
        pd.DataFrame(e[k * 20 : k * 20 + 20], columns=["key", "ms", "event_id", "hash"]).to_json(f"{tmp_path}/e{k}.json", orient="records", lines=True)
    batch = spark.createDataFrame(e, schema)
    for name, make, want in (("c", stateful.stream_change_states, stateful.change_states(batch)), ("b", lambda s: stateful.stream_token_bucket(s, 1.0, 2.0), stateful.token_bucket(batch, 1.0, 2.0))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/*.json")
        q = make(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert sorted(rows(spark.table(f"out_{name}"))) == sorted(rows(want))


def test_stream_windows(spark, tmp_path):
    pd.DataFrame({"user": [1, 1, 2, 1], "at": ["2024-01-01T00:01:00", "2024-01-01T00:59:00", "2024-01-01T00:10:00", "2024-01-01T05:00:00"]}).to_json(f"{tmp_path}/w.json", orient="records", lines=True)
    stream = spark.readStream.schema("user long, at timestamp").json(f"{tmp_path}/*.json")
    q = stateful.windowed_counts(stream, "at", ["user"]).writeStream.format("memory").queryName("out_w").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted((r["user"], r["n"]) for r in spark.table("out_w").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_titles_of_all_pages(spark, tmp_path):
    from millrace.plans import markup

    pages = {"<title>a &amp;&amp; b</title>": ("a && b", False), "<title>plain\n one</title>": ("plain one", False), "<title>c&#39;d": ("c'd", False), "<p>none": (None, True), "<title> </title><p>x": (None, False), "": (None, True), None: (None, True)}
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(rows(markup.css_title(spark, str(tmp_path)))) == [(i, *x) for i, x in enumerate(pages.values())]


def test_title_entities(spark, tmp_path):
    """Cut and unknown entities of a title stay as they are, as in the query's SQL."""
    import duckdb

    from millrace.plans import markup

    titles = ["a&amp;&amp;&amp", "a&amp;&am", "a &", "&lt;b&gt; &lt &gtx", "AT&T &copy 2 &copy; &eacute;", "&quot;c&#39; &#39 &#233; &#x41;", "&amp;lt; &amp;amp;", "&LT; &nbsp;d&&e"]
    want = ["a&&&amp", "a&&am", "a &", "<b> &lt &gtx", "AT&T &copy 2 &copy; &eacute;", "\"c' &#39 &#233; &#x41;", "&lt; &amp;", "&LT; &nbsp;d&&e"]
    pages = [(i, "u", f"<html><title>{t}</title><p>x &amp y") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(rows(markup.css_title(spark, str(tmp_path))))
    assert got == [(i, t, False) for i, t in enumerate(want)]
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.execute(markup.SQL["css_title"]).fetchall()) == got


def test_signals_beside_other_letters(spark, tmp_path):
    """Borders of signal words are those of ASCII, as in the query's SQL."""
    import duckdb

    from millrace.plans import pages

    bodies = ["ñdes aesé", "DES des Des", "xdes des_ 1des aes2", "\u0130des des\u0130 des\u0301", "ümd5ü-sha1.", "éwebgl WebGL canvasß navigator.plugins navigator_plugins", "", None, "<script src=a>des</script><SCRIPT>я-rsa-я"]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(bodies)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(rows(pages.page_surface_signals(spark, str(tmp_path))))
    assert [r[3] for r in got] == [2, 1, 0, 1, 2, 0, 0, None, 2] and [r[4] for r in got] == [0, 0, 0, 0, 0, 4, 0, None, 0]
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.execute(pages.SQL["page_surface_signals"]).fetchall()) == got


def test_text_columns(spark):
    d = spark.createDataFrame([("<p>a</p><script>x</script> <b>c</b>", "image/png", "P1DT1S")], "h string, m string, d string")
    assert rows(d.select(text.visible_text(F.col("h")), text.mime_kind(F.col("m")), text.iso_duration_seconds(F.col("d")))) == [("a c", "image", 86401.0)]
    assert json.loads(d.select(F.to_json(F.struct(text.escape_html(F.col("h")).alias("e")))).first()[0])["e"].startswith("&lt;p&gt;")
