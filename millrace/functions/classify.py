"""Ordered first-match classifiers, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U

# Patterns of link kinds, in order; the first that matches names the kind.
LINK_KINDS = (
    ("logout", r"(^|/)(logout|signout|log-out|exit)(/|$)"),
    ("api", r"/api(/|$)|[?&](api|format)="),
    ("pagination", r"([?&](page|p|pg|offset|cursor)=)|/(page|p)/[0-9]+"),
    ("search", r"([?&](q|query|keyword|search)=)|/search(/|$)"),
    ("listing", r"([?&](category|cat|collection|tag|brand)=)|/(category|categories|collection|collections|list|listing|catalog|catalogue|browse)(/|$)"),
    ("detail", r"/(product|products|item|items|detail|details|dp)/|/p/[a-z0-9_-]+"),
)
# Extensions of files that aren't pages.
ASSETS = (
    ".7z", ".avi", ".bmp", ".css", ".csv", ".doc", ".docx", ".gif", ".gz", ".ico", ".jpeg", ".jpg",
    ".js", ".json", ".m4a", ".mov", ".mp3", ".mp4", ".pdf", ".png", ".ppt", ".pptx", ".rar", ".rss",
    ".svg", ".tar", ".tgz", ".txt", ".webm", ".webp", ".xls", ".xlsx", ".xml", ".zip",
)
# Words of a link's text that name its kind.
TEXT_KINDS = {"logout": r"\b(log\s*out|sign\s*out)\b", "pagination": r"\b(next|next page|older|more|load more|下一页|更多)\b", "search": r"\bsearch\b"}
# Priorities of kinds; others have none.
PRIORITIES = {"sitemap": 90, "pagination": 85, "detail": 70, "listing": 45, "search": 40, "api": 30}
# Kinds of transcript messages, in order.
MESSAGE_KINDS = (
    ("heartbeat", r"\b(ping|pong|heartbeat|keepalive|keep_alive)\b"),
    ("auth", r"\b(auth|authorize|authorization|token|login|refresh)\b"),
    ("subscribe", r"\b(subscribe|subscription|subscribed|listen|join|watch|channel)\b"),
    ("ack", r"\b(ack|ready|welcome|connected|hello|ok)\b"),
    ("error", r"\b(error|failed|forbidden|unauthorized|denied)\b"),
)


def first_match(text: Column, rules, otherwise: Column) -> Column:
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def link_kind(link: Column, rel: Column | None = None, hreflang: Column | None = None, media_type: Column | None = None, anchor: Column | None = None, tag: Column | None = None, next_url: Column | None = None) -> Column:
    """Kind of a link: what its element says first (next page, canonical, another language, a file), then its URL or text."""
    none = F.lit(None).cast("string")
    rel, hreflang, media_type, anchor, tag, next_url = (none if c is None else c for c in (rel, hreflang, media_type, anchor, tag, next_url))
    tokens = F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+")
    low, words = F.lower(link), F.lower(F.trim(F.coalesce(anchor, F.lit(""))))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    out = (
        F.when(F.coalesce(link == next_url, F.lit(False)) | F.array_contains(tokens, "next"), "pagination").when(F.array_contains(tokens, "canonical"), "canonical")
        .when(given(hreflang) | (F.array_contains(tokens, "alternate") & F.coalesce(tag == "link", F.lit(False))), "alternate-language")
        .when(U.extension(link).isin(*ASSETS) | given(media_type), "asset")
    )
    for name, pattern in LINK_KINDS:
        hit = low.rlike(pattern)
        out = out.when(hit | words.rlike(TEXT_KINDS[name]) if name in TEXT_KINDS else hit, name)
    return out.otherwise("generic")


def link_priority(kind: Column) -> Column:
    out = None
    for k, v in PRIORITIES.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def message_kind(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match(low, MESSAGE_KINDS, F.when(F.trim(low) == "", "unknown").otherwise("data"))


def discovery_allowed(link: Column, parent: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), same_origin: bool = True) -> Column:
    keep = U.origin(link) == U.origin(parent) if same_origin else F.lit(True)
    if include:
        hit = F.lit(False)
        for p in include:
            hit = hit | link.rlike(p)
        keep = keep & hit
    for p in exclude:
        keep = keep & ~link.rlike(p)
    return keep


def page_kind(link: Column, html: Column) -> Column:
    """search > listing > detail > generic."""
    low = F.lower(link)
    return F.when(low.rlike(LINK_KINDS[3][1]) | html.rlike(r"(?i)type=[\"']search[\"']"), "search").when(low.rlike(LINK_KINDS[4][1]), "listing").when(low.rlike(LINK_KINDS[5][1]), "detail").otherwise("generic")
