"""Arrow-batched UDFs over ``functions.web`` and ``functions.wire``, for what columns can't express."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import web, wire

ASSET = "array<struct<url:string,kind:string,source:string,tag:string,attribute:string,title:string,alt:string>>"
FIELD = "array<struct<field:int,wire:int,type:string,value:string>>"


def _null(f):
    return lambda x, *a: None if x is None else f(x, *a)


def css(html: Column, selector: str, attribute: str = "text", base: Column | None = None) -> Column:
    @F.pandas_udf("array<string>")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([web.css(x, selector, attribute, y) for x, y in zip(h, b, strict=True)])

    return run(html, base if base is not None else F.lit(None).cast("string"))


def xpath(html: Column, expression: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([web.xpath(web.parse_html(x), expression) for x in h])

    return run(html)


LINK = "struct<source:string,next:string,links:array<struct<url:string,tag:string,rel:string,text:string,hreflang:string,media_type:string,nofollow:boolean>>>"


def link_candidates(body: Column, base: Column, content_type: Column | None = None) -> Column:
    @F.pandas_udf(LINK)
    def run(h: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([web.link_candidates(x, y, z) for x, y, z in zip(h, b, c, strict=True)], columns=["source", "next", "links"])

    return run(body, base, content_type if content_type is not None else F.lit(None).cast("string"))


def page_rules(body: Column, base: Column, rules: list[dict]) -> Column:
    """All HTML rules of a plan with one parse a page: a struct of arrays r0, r1, ... of texts (of JSON texts for media)."""
    kinds = ",".join(f"r{i}:array<string>" for i in range(len(rules)))

    def values(root, raw, link, rule):
        kind = rule["type"]
        if kind == "css":
            return web.css(root, rule["selector"], rule.get("attribute", "text"), link)
        if kind == "links":
            return web.css(root, rule.get("selector", "a[href]"), "href", link)
        if kind == "xpath":
            return web.xpath(root, rule["xpath"])
        if kind == "media":
            return [json.dumps(m) for m in web.media_assets(root, link, rule.get("maxItems", 50))]
        return [json.dumps(y, sort_keys=True) for y in web.json_ld(root)]

    @F.pandas_udf(f"struct<{kinds}>")
    def run(h: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, link in zip(h, b, strict=True):
            root = web.parse_html(raw)
            rows.append([values(root, raw, link, r) for r in rules])
        return pd.DataFrame(rows, columns=[f"r{i}" for i in range(len(rules))])

    return run(body, base)


def resolve(link: Column, base: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([web.resolve(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(link, base)


def media_assets(html: Column, base: Column, limit: int = 200) -> Column:
    @F.pandas_udf(ASSET)
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([web.media_assets(x, y, limit) for x, y in zip(h, b, strict=True)])

    return run(html, base)


def json_ld(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([[json.dumps(y, sort_keys=True) for y in web.json_ld(web.parse_html(x))] for x in h])

    return run(html)


def next_page(html: Column, base: Column) -> Column:
    @F.pandas_udf("string")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([web.next_page(x, y) for x, y in zip(h, b, strict=True)], dtype=object)

    return run(html, base)


def robots_allowed(robots: Column, link: Column, agent: str = "*") -> Column:
    @F.pandas_udf("boolean")
    def run(r: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([web.robots_allowed(x, y, agent) for x, y in zip(r, u, strict=True)])

    return run(robots, link)


def crawl_delay_ms(robots: Column, agent: str = "*") -> Column:
    @F.pandas_udf("int")
    def run(r: pd.Series) -> pd.Series:
        return pd.Series([web.crawl_delay_ms(x, agent) for x in r])

    return run(robots)


def feed_items(xml: Column) -> Column:
    @F.pandas_udf("array<struct<title:string,link:string,description:string,published:string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([web.feed_items(y) for y in x])

    return run(xml)


def hls_variants(text: Column, base: Column) -> Column:
    @F.pandas_udf("array<struct<url:string,bandwidth:long>>")
    def run(t: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([web.hls_variants(x, y) for x, y in zip(t, b, strict=True)])

    return run(text, base)


def wire_fields(data: Column, strict: bool = False) -> Column:
    @F.pandas_udf(FIELD)
    def run(d: pd.Series) -> pd.Series:
        return pd.Series([[{"field": f["field"], "wire": f["wire"], "type": f["type"], "value": wire.show(f["value"])} for f in wire.fields(bytes(x), strict)] if x is not None else None for x in d])

    return run(data)


def grpc_frames(data: Column, strict: bool = False) -> Column:
    @F.pandas_udf("array<struct<compressed:boolean,message:binary>>")
    def run(d: pd.Series) -> pd.Series:
        return pd.Series([wire.frames(bytes(x), strict) if x is not None else None for x in d])

    return run(data)


def stable_json(text: Column) -> Column:
    """JSON with sorted keys and whole numbers without a fraction; null for what doesn't parse."""

    def one(x):
        try:
            return json.dumps(_whole(json.loads(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in t], dtype=object)

    return run(text)


def _whole(x):
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, dict):
        return {k: _whole(v) for k, v in x.items()}
    return [_whole(v) for v in x] if isinstance(x, list) else x


def json_diff(previous: Column, current: Column) -> Column:
    """Changes between two JSON texts: path, kind (added, removed, updated), both values as JSON. Arrays compare by place."""

    def walk(a, b, path, out):
        if isinstance(a, dict) and isinstance(b, dict):
            for k in sorted({*a, *b}):
                p = f"{path}.{k}" if path else k
                if k not in a:
                    out.append((p, "added", None, b[k]))
                elif k not in b:
                    out.append((p, "removed", a[k], None))
                else:
                    walk(a[k], b[k], p, out)
        elif isinstance(a, list) and isinstance(b, list):
            for i in range(max(len(a), len(b))):
                p = f"{path}[{i}]"
                if i >= len(a):
                    out.append((p, "added", None, b[i]))
                elif i >= len(b):
                    out.append((p, "removed", a[i], None))
                else:
                    walk(a[i], b[i], p, out)
        elif a != b or isinstance(a, bool) != isinstance(b, bool):
            out.append((path, "updated", a, b))

    def one(x, y):
        out: list = []
        walk(json.loads(x) if x else None, json.loads(y) if y else None, "", out)
        text = lambda v, there: json.dumps(v, sort_keys=True) if there else None
        return [{"path": p, "kind": k, "previous": text(a, k != "added"), "current": text(b, k != "removed")} for p, k, a, b in out]

    @F.pandas_udf("array<struct<path:string,kind:string,previous:string,current:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(previous, current)
