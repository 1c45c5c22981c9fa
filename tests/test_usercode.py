"""User code and deliveries beyond what the registered queries show."""

import hashlib
import hmac
import json

import pytest

from millrace.operators import deliveries, sinks, usercode


def test_steps():
    assert usercode.run_steps({"a": 1}, [lambda i: {**i, "b": 2}, lambda i: "kept", lambda i: 0]) == ({"a": 1, "b": 2}, False, None)
    assert usercode.run_steps({"a": 1}, [lambda i: None, lambda i: 1 / 0]) == (None, True, None)
    item, dropped, error = usercode.run_steps({"a": 1}, [lambda i: i["none"]])
    assert item is None and not dropped and "none" in error


def test_pipeline_edges(spark):
    d = spark.createDataFrame([(1, None), (2, '{"a":1}')], "id int, item string")
    got = {r["id"]: (r["item"], r["dropped"], r["error"]) for r in usercode.pipeline(d, []).collect()}
    assert got == {1: (None, True, None), 2: ('{"a":1}', False, None)}
    assert usercode.pipeline(d.limit(0), []).count() == 0 and usercode.pipeline(d.select("item"), []).columns == ["item", "dropped", "error"]
    assert usercode.validated(d.where("id = 2"), lambda x: x).first()["ok"]


def test_plugins(spark):
    seen = []
    plugins = usercode.Plugins().register("tag", lambda name, skip=False: {"beforeRequest": lambda p: seen.append(name) or {"tag": name, "skip": skip}, "afterExtract": lambda df: df.withColumnRenamed(df.columns[0], name)})
    plugins.register("silent", lambda: {"beforeRequest": lambda p: None, "other": 3}).use("silent").use("tag", name="x").use("tag", name="y", skip=True).use("tag", name="z")
    assert plugins.hook("beforeRequest", {}) == {"tag": "y", "skip": True} and seen == ["x", "y"]
    assert plugins.hook("onError", {}) == {} and plugins.stages("afterExtract", spark.range(1)).columns == ["z"]
    with pytest.raises(KeyError):
        plugins.use("none")
    with pytest.raises(ValueError):
        plugins.register("bad", None)


def test_retry():
    calls = []

    def twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "ok"

    assert usercode.with_retry(twice, 3)() == "ok"
    calls.clear()
    with pytest.raises(OSError):
        usercode.with_retry(twice, 2)()


def test_payloads_and_backends(spark, tmp_path):
    d = spark.createDataFrame([(f'{{"n":{i}}}',) for i in range(5)], "item string").coalesce(1)
    rows = deliveries.payloads(d, size=2, secret="s").collect()
    assert sorted(r["rows"] for r in rows) == [1, 2, 2]
    assert all(r["signature"] == "sha256=" + hmac.new(b"s", r["body"].encode(), hashlib.sha256).hexdigest() for r in rows)
    assert sorted(x["n"] for r in rows for x in json.loads(r["body"])) == list(range(5))
    assert deliveries.payloads(d.limit(0)).count() == 0 and deliveries.csv_text([]) == ""
    backends = deliveries.Backends().register("jsonl", lambda df, path: sinks.write_jsonl(df, path, "item"))
    backends.write("jsonl", d, path=f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 5
    with pytest.raises(KeyError):
        backends.write("none", d)
    with pytest.raises(ValueError):
        deliveries.write_table(d, "jdbc:none", "x; drop table y")
