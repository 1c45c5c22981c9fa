"""Scalar functions on text, markup and headers, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    """Trimmed text of the first title element, null without one."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles and tags, with single blanks."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"\s+", " "))


def compact_dom(html: Column) -> Column:
    """Markup without script, style, svg, meta, link and comments, with single blanks."""
    out = html
    for tag in ("script", "style", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<(meta|link)\b[^>]*>", ""), r"(?s)<!--.*?-->", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def hrefs(html: Column) -> Column:
    """Targets of anchors in order; those with a fragment are left out."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href=["']([^"'#]+)["']"""), 1)


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def redact(text: Column) -> Column:
    """Credentials in running text."""
    mark = "***REDACTED***"
    for pattern, start in ((r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer "), (r"(?i)token[=:]\s*[A-Za-z0-9._-]+", "token="), (r"(?i)apikey[=:]\s*[A-Za-z0-9._-]+", "apikey="), (r"(?i)password[=:]\s*\S+", "password=")):
        text = F.regexp_replace(text, pattern, start + mark)
    return text


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode_entities(text: Column) -> Column:
    """The five XML entities; the ampersand last, so nothing is decoded twice."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), 1), lambda x: decode_entities(F.trim(x)))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), r"\.{2,}", "."), 1, 255)


def iso_duration_seconds(text: Column) -> Column:
    """PnDTnHnMnS in seconds, null otherwise."""
    pattern = r"^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9.]+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(pattern), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Seconds or an HTTP date, in milliseconds from ``now`` (a timestamp), not below zero."""
    seconds = F.when(value.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.trim(value).cast("double") * 1000)
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    gap = F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_millis(date) - F.unix_millis(now)))
    return F.coalesce(seconds.cast("bigint"), gap)


def retry_delay_ms(attempt: Column, base: Column, strategy: Column, most: Column, floor_ms: Column | None = None) -> Column:
    """Fixed or doubling delay, capped, then raised to what the server asked for; no jitter."""
    raw = F.when(strategy == "exponential", base * F.pow(F.lit(2.0), attempt - 1)).otherwise(base)
    out = F.least(raw, most).cast("bigint")
    return F.greatest(out, floor_ms) if floor_ms is not None else out


def mime_kind(mime: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(mime), r"^(image|video|audio)/", 1), F.lit(""))


def value_kind(json_text: Column) -> Column:
    """Type of a JSON text: object, array, string, number, boolean, null; undefined for none."""
    t = F.ltrim(json_text)
    return (
        F.when(t.isNull() | (t == ""), "undefined").when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), "string")
        .when(t.rlike(r"^(true|false)\b"), "boolean").when(t.rlike(r"^null\b"), "null").when(t.rlike(r"^-?[0-9]"), "number").otherwise("undefined")
    )


def percent_delta(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, (current - previous) * 100.0 / previous)


def ratio(current: Column, previous: Column) -> Column:
    return F.when(previous != 0, current * 1.0 / previous)
