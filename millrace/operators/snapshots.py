"""Snapshots of a run's results: signals, sign-in artefacts (names only) and runtime surfaces; cache validators and leases.

Every result is read once and counts are partial aggregates; top lists are cut after counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signals(results: DataFrame) -> DataFrame:
    """One row of counts of ``results(status, attempts, challenge_solved, signature_likely, auth_wall, empty_success, drift, corrections)``; nulls count as no."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return results.agg(
        F.count(F.lit(1)).alias("results"), *[count(F.col(c)).alias(c) for c in ("challenge_solved", "signature_likely", "auth_wall", "empty_success")],
        count(F.col("attempts") > 1).alias("retry_heavy"), count(F.col("status") >= 400).alias("non_ok"), F.coalesce(F.sum("drift"), F.lit(0)).alias("drift"), F.coalesce(F.sum("corrections"), F.lit(0)).alias("corrections"),
    )


def top(df: DataFrame, name: str, limit: int) -> DataFrame:
    """The most frequent values of a column with their counts; of equals the first by value."""
    return df.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def auth_artefacts(results: DataFrame, limit: int = 20) -> DataFrame:
    """Names of cookies set and of storage keys used, most frequent first: (kind, value, n). Values of credentials are never read.

    ``results``: requests array<struct<requestHeaders, responseHeaders: map>>, events array<struct<type, key>>.
    """
    low = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    calls = results.select(F.explode("requests").alias("r"))
    cookies = calls.select(F.trim(F.split_part(low(F.col("r.responseHeaders"))["set-cookie"], F.lit("="), F.lit(1))).alias("name"))
    stored = results.select(F.explode("events").alias("e")).where(F.col("e.type").rlike(r"^(localStorage|sessionStorage)\.")).select(F.trim("e.key").alias("name"))
    both = [top(df, "name", limit).select(F.lit(kind).alias("kind"), "value", "n") for kind, df in (("cookie", cookies), ("storage", stored))]
    return both[0].unionByName(both[1])


def auth_counts(results: DataFrame) -> DataFrame:
    """auth_headers, login_walls and expired_sessions of ``results(auth_wall, body, requests)``."""
    low = F.lower(F.coalesce("body", F.lit("")))
    expired = low.contains("session expired") | low.contains("token expired") | low.contains("expired token")
    sent = F.size(F.filter(F.coalesce("requests", F.array().cast(results.schema["requests"].dataType)), lambda r: F.exists(F.map_keys(F.coalesce(r["requestHeaders"], F.create_map().cast("map<string,string>"))), lambda k: F.lower(k) == "authorization")))
    return results.agg(F.coalesce(F.sum(sent), F.lit(0)).alias("auth_headers"), F.count_if(F.coalesce("auth_wall", F.lit(False))).alias("login_walls"), F.count_if(expired).alias("expired_sessions"))


def surface_signals(scripts: DataFrame, events: DataFrame) -> DataFrame:
    """How often scripts (``preview``) and hook events (``type``) speak of WebAssembly, Web Crypto and frames: (signal, n)."""
    head = F.lower(F.substring("preview", 1, 2000))
    says = lambda *words: F.when(F.greatest(*[F.contains(head, F.lit(w)).cast("int") for w in words]) == 1, 1).otherwise(0)
    kind = F.coalesce("type", F.lit(""))
    marks = {
        "wasm": (says(".wasm", "webassembly"), F.startswith(kind, F.lit("webassembly."))),
        "web-crypto": (says("crypto.subtle", "subtle.encrypt", "subtle.decrypt"), F.startswith(kind, F.lit("crypto.subtle."))),
        "iframe": (says("postmessage", "contentwindow", "iframe"), F.startswith(kind, F.lit("iframe.")) | F.contains(kind, F.lit("postMessage"))),
    }
    rows = scripts.select(*[m[0].alias(k) for k, m in marks.items()]).unionByName(events.select(*[m[1].cast("int").alias(k) for k, m in marks.items()]))
    return rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("signal"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("hit")) for k in marks]))).groupBy("signal").agg(F.sum("hit").alias("n"))


def with_validators(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """GET requests (cache_key, method, headers) with the validators of their cache entries; headers that are set already stay."""
    j = requests.join(cache.select("cache_key", "etag", "last_modified"), "cache_key", "left")
    get = F.upper(F.coalesce("method", F.lit("GET"))) == "GET"
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    has = lambda name: F.exists(F.map_keys(own), lambda k: F.lower(k) == name)
    pairs = F.array_compact(F.array(*[F.when(get & F.col(c).isNotNull() & (F.col(c) != "") & ~has(n), F.struct(F.lit(n).alias("k"), F.col(c).alias("v"))) for n, c in (("if-none-match", "etag"), ("if-modified-since", "last_modified"))]))
    return j.select("cache_key", "method", F.map_concat(own, F.map_from_entries(pairs)).alias("headers"), (F.size(pairs) > 0).alias("conditional"))


def expire_leases(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Running jobs whose lease ended are interrupted and lose their worker; others stay."""
    over = (F.col("status") == "running") & (F.col("lease_until") <= now_ms)
    return jobs.withColumns({"status": F.when(over, "interrupted").otherwise(F.col("status")), "worker": F.when(~F.coalesce(over, F.lit(False)), F.col("worker"))})
