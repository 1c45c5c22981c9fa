"""Captured network calls: how much a JSON payload looks like data, which part of it is the data, and the order of calls."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys, lower case without marks, by what they hold.
PRIMARY = ("data", "result", "results", "payload", "response", "body", "content", "value", "props", "pageprops")
COLLECTION = ("items", "list", "results", "records", "products", "entries", "edges", "nodes", "hits", "documents", "articles", "rows", "collections", "collection")
META = ("ok", "success", "status", "statuscode", "code", "message", "messages", "error", "errors", "meta", "metadata", "requestid", "traceid", "timestamp", "tokentype", "expiresin")
PAGINATION = ("pageinfo", "pagination", "paging", "cursor", "nextcursor", "prevcursor", "hasnextpage", "haspreviouspage", "total", "totalcount", "count", "offset", "limit")
# Kinds of endpoints with their points, in order; the first five always name the kind.
ENDPOINTS = (
    ("graphql", 36, "graphql-interface", r"/graphql"),
    ("metrics", -40, "metrics-endpoint", r"(?:^|/)(metrics?|stats|telemetry|rum)(?:/|$)"),
    ("analytics", -42, "analytics-endpoint", r"analytics|beacon|collect|track|pixel|events?(?:/|$)|logging?(?:/|$)"),
    ("auth", -34, "auth-endpoint", r"(?:^|/)(auth|login|logout|token|session|csrf|captcha)(?:/|$)"),
    ("health", -18, "health-endpoint", r"(?:^|/)(health|heartbeat|ping|ready|live)(?:/|$)"),
    ("bootstrap-data", 16, "bootstrap-endpoint", r"bootstrap|initial|prefetch|dehydrated|hydration|page-data"),
    ("api-data", 14, "api-path", r"/api/|/rest/|/v\d+/"),
    ("content-data", 10, "content-endpoint", r"search|results|catalog|collection|listing|products?|items?|detail|content|feed"),
)
_FORCING = 5
RANKED = "array<struct<rank:int,url:string,category:string,score:int,signals:array<string>,data_path:string,payload:string>>"


def plain_key(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def parse(text: str | None):
    """(whether it is JSON, value)."""
    try:
        return True, json.loads(text, parse_constant=float)
    except (TypeError, ValueError):
        return False, None


def _object_points(keys: list[str]) -> int:
    kinds = {name: sum(k in group for k in keys) for name, group in (("collection", COLLECTION), ("page", PAGINATION), ("meta", META))}
    own = len(keys) - kinds["meta"]
    listed = kinds["collection"] > 0
    given = (
        (listed, 45 + min(15, 6 * kinds["collection"])), (listed and own <= 2, 14), ("data" in keys, 18), (listed and kinds["page"] > 0, 14), (0 < own <= 4, 10),
        (own == 1 and len(keys) <= 3, 12), (own == 0, -35), ("errors" in keys and "data" not in keys, -25), ("token" in keys and len(keys) <= 3, -12),
    )
    return 10 + sum(points for holds, points in given if holds)


def shape_score(value, depth: int = 0) -> int:
    """Points of one JSON value: lists of objects and objects with a collection most, flags and empty values least."""
    if isinstance(value, list):
        if not value:
            return -8 - depth
        head = value[:3]
        return 28 + min(30, 4 * len(value)) + 10 * sum(isinstance(x, dict) for x in head) + 6 * sum(isinstance(x, list) for x in head) - 2 * depth
    if isinstance(value, dict):
        return _object_points([plain_key(k) for k in value]) - 2 * depth if value else -10 - depth
    if isinstance(value, str):
        text = value.strip()
        if not text or text.lower() in ("ok", "success", "true", "false"):
            return (-10 if text else -8) - depth
        return min(12, len(text) // 40)
    return {True: -6, False: 1}[isinstance(value, bool)] - depth if value is not None else -depth


def primary(value, path: str = "", depth: int = 0) -> tuple[int, str, object]:
    """(score, path, part) of the best part of a JSON value: itself, or one below it; of equals the outer, then the earlier one."""
    best = (shape_score(value, depth), path, value)
    if depth >= 5 or not isinstance(value, (dict, list)):
        return best
    if isinstance(value, list):
        below = [(str(i), x, -10) for i, x in enumerate(value[:3]) if isinstance(x, (dict, list))]
    else:
        alone = sum(plain_key(k) not in META for k in value) == 1
        bonus = lambda k: 35 * (k in PRIMARY) + 28 * (k in COLLECTION) - 25 * (k in META) - 4 * (k in PAGINATION) + 18 * (alone and k not in META) - 4 * depth
        below = [(k, x, bonus(plain_key(k))) for k, x in value.items()]
    for key, part, more in below:
        score, at, found = primary(part, f"{path}.{key}" if path else key, depth + 1)
        if score + more > best[0]:
            best = (score + more, at, found)
    return best


def endpoint(link: str | None, method: str | None = "GET", body: str | None = None) -> tuple[int, str, list[str]]:
    """Points, kind and signals of a call by its address, method and request."""
    parts = urlsplit(link or "")
    address = (f"{parts.path or '/'}{'?' + parts.query if parts.query else ''}" if parts.scheme else link or "").lower()
    ok, sent = parse(body)
    asks = '"query"' in (body or "").lower() or (ok and isinstance(sent, dict) and bool(sent.get("query") or sent.get("operationName")))
    score, kind, signals = 0, "other", []
    for i, (name, points, signal, pattern) in enumerate(ENDPOINTS):
        if re.search(pattern, address) or (i == 0 and asks):
            score, signals = score + points, [*signals, signal]
            if i < _FORCING or kind == "other":
                kind = name
    if (method or "GET").upper() == "POST" and kind in ("graphql", "api-data", "bootstrap-data", "content-data"):
        score, signals = score + 4, [*signals, "post-request"]
    return score, kind, signals


def rank_calls(calls: list[dict], *, prefer: tuple[str, ...] = (), avoid: tuple[str, ...] = (), transports: tuple[str, ...] = ("fetch", "xhr"), only: str | None = None, require_json: bool = True, select: str = "payload", limit: int = 10) -> list[dict]:
    """Calls best first. ``select``: the payload, or the best part of it (``primary-data``)."""
    out = []
    for i, c in enumerate(calls):
        link, body = c.get("url") or "", c.get("body")
        is_json, value = parse(body)
        if (c.get("transport") or "").lower() not in transports or (only and not re.search(only, link)) or (require_json and not is_json):
            continue
        points, kind, signals = endpoint(link, c.get("method"), c.get("requestBody"))
        for patterns, name, more in ((prefer, "prefer", 18), (avoid, "avoid", -28)):
            hits = [p for p in patterns if re.search(p, link)]
            points, signals = points + more * len(hits), signals + [f"{name}:{p}" for p in hits]
        own = shape_score(value) if is_json else 0
        main, path, part = primary(value) if is_json else (0, "", body)
        chosen = select == "primary-data" and is_json
        status = c.get("status")
        score = (
            (8 if status is None else 50 if 200 <= status < 300 else 0) + {"fetch": 10, "xhr": 8}.get((c.get("transport") or "").lower(), 0) + 25 * is_json + min(15, len((body or "").encode()) // 256)
            + max(-40, min(40, points)) + max(-20, min(35, shape_score(part if chosen else value if is_json else body))) + (max(0, min(18, main)) if chosen else 0) - 15 * (own <= 0) + max(0, len(calls) - i)
        )
        out.append({"url": c.get("url"), "category": kind, "score": score, "signals": signals, "data_path": path if chosen and path else None, "payload": json.dumps(part) if chosen and path else body})
    out.sort(key=lambda x: -x["score"])
    return [{"rank": k, **x} for k, x in enumerate(out[:limit], 1)]


def ranked(calls: Column, **options) -> Column:
    """``rank_calls`` of an array of (url, transport, method, status, requestBody, body), a page at a time, so pages never meet."""

    @F.pandas_udf(RANKED)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([rank_calls(json.loads(x) if x else [], **options) for x in text])

    return run(F.to_json(calls))


def primary_value(body: Column) -> Column:
    """Path and score of the best part of a JSON text; null for other text."""

    def one(text):
        ok, value = parse(text)
        if not ok:
            return None
        score, path, part = primary(value)
        return {"path": path, "score": score, "part": json.dumps(part)}

    @F.pandas_udf("struct<path:string,score:int,part:string>")
    def run(text: pd.Series) -> pd.DataFrame:
        found = [one(x) or {"path": None, "score": None, "part": None} for x in text]
        return pd.DataFrame(found, columns=["path", "score", "part"]).astype({"score": "Int32"})

    return run(body)
