"""A whole run of a plan: results, quality, links, changes and exports."""

from millrace.plans import runner

PLAN = {"name": "shop", "extract": [{"name": "title", "type": "css", "selector": "h1"}, {"name": "price", "type": "regex", "pattern": r"EUR ([0-9.]+)"}], "quality": {"schema": {"required": ["title", "price"], "types": {"price": "number"}}}}


def test_run(spark, tmp_path):
    rows = [("https://s.test/a?b=1&a=2", "<h1>Mug</h1> EUR 3.50 <a href='/p/2'>n</a>", 200), ("https://s.test/a?a=2&b=1#x", "<h1>Again</h1>", 200), ("https://s.test/b", "<h1>Cup</h1>", 200), ("https://s.test/c", "Please sign in", 401)]
    responses = spark.createDataFrame(rows, "url string, body string, status int")
    empty = spark.createDataFrame([], "key string, body string, extracted string")
    r = runner.run(PLAN, responses, empty)
    got = {x["url"]: x for x in r.results.collect()}
    assert len(got) == 3 and {u: x["outcome"] for u, x in got.items()}["https://s.test/c"] == "auth"
    first = min(u for u in got if "/a?" in u)
    assert got[first]["extracted"]["title"] in ("Mug", "Again") and got["https://s.test/b"]["issues"] == ["missing:price"]
    s = r.snapshot.first()
    assert (s["records"], s["failures"]) == (3, 1) and s["health"] < 100
    assert {x["field"]: x["present"] for x in r.coverage.collect()}["title"] == 2
    assert {x["content_state"] for x in r.changes.collect()} == {"first-seen"}
    again = runner.run(PLAN, responses, r.state)
    assert {x["content_state"] for x in again.changes.collect()} == {"unchanged"}
    runner.export(r, [{"table": "results", "format": "parquet", "path": f"{tmp_path}/r"}, {"table": "coverage", "format": "csv", "path": f"{tmp_path}/c"}])
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3 and spark.read.text(f"{tmp_path}/c").count() == 2
