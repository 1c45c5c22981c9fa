"""Protection surfaces, outcome classes, captured network calls, access policies and frequency reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network

# Marks of protection providers; each group of marks is one signal.
PROVIDERS = (
    ("cloudflare", {"header": ("cf-ray",), "server": ("cloudflare",), "body": ("/cdn-cgi/challenge-platform/",)}),
    ("cloudflare", {"body": ("attention required", "cf-chl"), "cookie": ("__cf_bm",)}),
    ("akamai", {"server": ("akamaighost",), "cookie": ("_abck", "bm_sv", "ak_bmsc")}),
    ("datadome", {"header": ("x-datadome",), "cookie": ("datadome",), "body": ("datadome",)}),
    ("imperva", {"server": ("imperva",), "cookie": ("incap_ses", "visid_incap")}),
    ("f5", {"server": ("big-ip",), "cookie": ("bigipserver",), "body": ("f5 distributed cloud",)}),
    ("shape-perimeterx", {"server": ("shape",), "body": ("perimeterx", "_px3"), "cookie": ("_px",)}),
)
# Texts of challenges, auth walls, signature errors and empty answers.
CHALLENGE = ("captcha", "verify you are human", "challenge", "access denied")
AUTH_WALL = ("sign in", "login", "unauthorized", "access token", "session expired", "forbidden")
SIGNATURE = ("invalid signature", "signature error", "bad signature", "invalid token", "token expired", "timestamp expired", "nonce")
EMPTY_SUCCESS = ("verify you are human", "enable javascript", "access denied", "login", "captcha")
SEVERITY = {"info": 1, "warning": 2, "error": 3, "critical": 4}


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def protection(headers: Column, body: Column, status: Column) -> Column:
    """detected, provider (most signals; of equals the first of the list), signals, challenge."""
    low = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    part = {"server": F.lower(F.coalesce(low["server"], F.lit(""))), "cookie": F.lower(F.coalesce(low["set-cookie"], F.lit(""))), "body": F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 12_000))}
    hits: dict[str, list[Column]] = {}
    for name, marks in PROVIDERS:
        hit = reduce(lambda a, b: a | b, [_any(part[k], words) if k != "header" else reduce(lambda a, b: a | b, [low[h].isNotNull() for h in words]) for k, words in marks.items()])
        hits.setdefault(name, []).append(hit.cast("int"))
    counts = [(name, sum(cols[1:], cols[0])) for name, cols in hits.items()]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts)]))
    total = reduce(lambda a, b: a + b, [n for _, n in counts])
    challenge = status.isin(403, 429) | _any(part["body"], CHALLENGE)
    return F.struct((total > 0).alias("detected"), F.when(best["n"] > 0, best["name"]).alias("provider"), total.alias("signals"), challenge.alias("challenge"))


def outcome(status: Column, body: Column, filled_fields: Column, challenge: Column, valid: Column) -> Column:
    """anti-bot > auth > signature > degraded-success > ok."""
    t = F.lower(F.coalesce(body, F.lit("")))
    empty = (status > 0) & (status < 400) & (filled_fields == 0) & (~valid | _any(t, EMPTY_SUCCESS))
    return F.when(challenge, "anti-bot").when(status.isin(401, 403) & _any(t, AUTH_WALL), "auth").when((status >= 400) & _any(t, SIGNATURE), "signature").when(empty, "degraded-success").otherwise("ok")


def severity_at_least(severity: Column, least: str) -> Column:
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[severity], F.lit(1))
    return rank >= SEVERITY.get(least, 1)


# ---------------------------------------------------------------- captured network calls


def network_candidates(pages: DataFrame, requests: str, limit: int = 10, **options) -> DataFrame:
    """JSON calls of each page, best first: (page_id, rank, url, category, score, signals, data_path, payload). Pages never meet in a shuffle."""
    rows = pages.select("page_id", F.explode(network.ranked(F.col(requests), limit=limit, **options)).alias("c"))
    return rows.select("page_id", "c.*")


def json_next(body: Column) -> Column:
    """Next page of a JSON answer: a next link, a cursor of page info, or offset and limit added."""
    at = lambda p: F.get_json_object(body, p)
    links = F.coalesce(*[at(f"$.{c}{n}") for c in ("", "meta.", "links.", "pagination.", "paging.", "data.") for n in ("next", "nextPage", "next_page", "nextUrl", "next_url", "nextLink")])
    cursor = F.when(body.rlike(r'"hasNextPage"\s*:\s*true'), F.nullif(F.regexp_extract(body, r'"endCursor"\s*:\s*"([^"]*)"', 1), F.lit("")))
    offset = at("$.offset").try_cast("bigint") + at("$.limit").try_cast("bigint")
    return F.struct(links.alias("url"), cursor.alias("cursor"), offset.alias("offset"))


# ---------------------------------------------------------------- reports


def frequencies(df: DataFrame, columns: list[str], limit: int = 20) -> DataFrame:
    """Most frequent values of several columns in one pass: (name, value, n, rank)."""
    from pyspark.sql import Window

    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= limit)


def suspects(stats: DataFrame) -> DataFrame:
    """Scored rules over one row of counts (total, anti_bot, auth, signature, degraded, shapes, failures), worst first."""
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    rules = [("anti-bot", share("anti_bot") * 100), ("auth-wall", share("auth") * 90), ("signature", share("signature") * 85), ("degraded-success", share("degraded") * 70), ("failures", share("failures") * 60), ("shape-drift", F.when(F.col("shapes") > 1, 10.0).otherwise(0.0))]
    x = stats.select(F.inline(F.array(*[F.struct(F.lit(n).alias("type"), F.round(s, 6).alias("score")) for n, s in rules])))
    return x.where("score > 0").orderBy(F.desc("score"), "type")


def access(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Allowed or not: a matching deny overrides any allow, nothing matching denies. A trailing * of a pattern matches any ending.

    Both sides meet on tenant and role; patterns are tested inside that.
    """
    fits = lambda p, v: F.col(p).isin("*") | (F.col(p) == F.col(v)) | (F.endswith(F.col(p), F.lit("*")) & F.startswith(F.col(v), F.regexp_replace(F.col(p), r"\*$", "")))
    j = requests.join(policies.withColumnRenamed("role", "prole"), "tenant", "left").where(F.col("prole").isNull() | F.array_contains("roles", F.col("prole")) | (F.col("prole") == "*"))
    hit = fits("p_action", "action") & fits("p_resource", "resource")
    g = j.groupBy("request_id").agg(F.coalesce(F.bool_or(hit & (F.col("effect") == "deny")), F.lit(False)).alias("denied"), F.coalesce(F.bool_or(hit & (F.col("effect") == "allow")), F.lit(False)).alias("allowed"))
    return requests.select("request_id").join(g, "request_id", "left").select("request_id", F.coalesce(F.col("allowed") & ~F.col("denied"), F.lit(False)).alias("allowed"))


def target_matches(link: Column, host_suffixes: Column, include: Column | None = None, exclude: Column | None = None) -> Column:
    """A proxy's target: host suffix, then include and exclude patterns."""
    from ..functions.url import host

    h = host(link)
    ok = host_suffixes.isNull() | (F.size(host_suffixes) == 0) | F.exists(host_suffixes, lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s)))
    if include is not None:
        ok = ok & (include.isNull() | F.rlike(link, include))
    return ok & ~F.coalesce(F.rlike(link, exclude), F.lit(False)) if exclude is not None else ok


def json_schema(df: DataFrame, column: str) -> str:
    """Schema of JSON texts merged over all rows, as Spark writes variants' schemas: a mergeable aggregate."""
    return df.agg(F.expr(f"schema_of_variant_agg(try_parse_json({column}))")).first()[0]
