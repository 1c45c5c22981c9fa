"""URL functions as native columns: parts, grouping keys, canonical forms, shard and page-number helpers.

They read ASCII URLs as the URL standard does; percent-encoding of other characters is in ``functions.web``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels that make a country domain three labels long.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
# Query parameters that say nothing about the page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "referrer")
# Query parameters that hold a page number, first found wins.
PAGE_PARAMETERS = ("page", "p", "pg", "pageNum", "pagenum", "page_num", "offset")

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host name without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":[0-9]*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def _plain_port(url: Column) -> Column:
    p = port(url)
    default = ((scheme(url) == "https") & (p == "443")) | ((scheme(url) == "http") & (p == "80"))
    return F.when((p == "") | default, "").otherwise(F.concat(F.lit(":"), p))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), _plain_port(url))


def registrable_domain(name: Column) -> Column:
    """Last two labels, three under a country domain with a common second level; addresses and single labels stay."""
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    n = F.size(labels)
    three = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    take = F.when(three, 3).otherwise(2)
    address = name.rlike(r"^[0-9.]+$|:")
    return F.when(address | (n <= 2), name).otherwise(F.array_join(F.slice(labels, n - take + 1, take), "."))


def group_key(url: Column, by: str = "hostname") -> Column:
    return {"hostname": host, "origin": origin, "registrableDomain": lambda u: registrable_domain(host(u))}[by](url)


def extension(url: Column) -> Column:
    """Extension of the last path segment with its dot, lower case; none for a name that starts with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path(url), r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1))


def slug(text: Column, limit: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"^https?://", ""), r"[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, limit)
    return F.when(s == "", "item").otherwise(s)


def _pairs(url: Column) -> Column:
    q = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(q, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("").alias("v")))


def _join(pairs: Column) -> Column:
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.when(F.size(pairs) == 0, "").otherwise(F.concat(F.lit("?"), text))


def canonical(url: Column, ignore: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case host, no default port, no tracking parameters, parameters by name (stable), one trailing slash less, single slashes, no fragment."""
    kept = F.filter(_pairs(url), lambda p: ~F.lower(p["k"]).isin(*ignore))
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    p = path(url)
    p = F.regexp_replace(F.when((F.length(p) > 1) & F.endswith(p, F.lit("/")), F.regexp_replace(p, "/$", "")).otherwise(p), "/{2,}", "/")
    out = F.concat(origin(url), p, _join(ordered))
    return F.when(url.rlike(_URL), out).otherwise(url)


def fingerprint(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def unique_key(url: Column, method: Column | None = None, body: Column | None = None, drop: tuple[str, ...] = ()) -> Column:
    """Request identity: URL without fragment, parameters by (name, value); the method unless a plain GET; sha256 of a body."""
    kept = F.filter(_pairs(url), lambda p: ~F.lower(p["k"]).isin(*drop)) if drop else _pairs(url)
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))
    key = F.concat(origin(url), path(url), _join(ordered))
    if method is None:
        return key
    has_body = F.coalesce(body, F.lit("")) != "" if body is not None else F.lit(False)
    prefix = F.when((F.upper(method) != "GET") | has_body, F.concat(F.upper(method), F.lit(" "))).otherwise("")
    suffix = F.when(has_body, F.concat(F.lit(" "), F.sha2(body, 256))).otherwise("") if body is not None else F.lit("")
    return F.concat(prefix, key, suffix)


def next_page(url: Column) -> Column:
    """The URL with its first page parameter, or /page/N, one higher; null without one."""
    out = F.lit(None).cast("string")
    grown = lambda pattern, keep: F.concat(F.regexp_extract(url, pattern, 1), (F.regexp_extract(url, pattern, keep).cast("bigint") + 1).cast("string"), F.regexp_extract(url, pattern, keep + 1))
    in_path = r"(?i)^([^?#]*/(?:page|p)/)([0-9]+)((?:[/?#].*)?)$"
    out = F.when(url.rlike(in_path), grown(in_path, 2))
    for name in reversed(PAGE_PARAMETERS):
        pattern = rf"^([^#]*[?&]{name}=)([0-9]+)((?:[&#].*)?)$"
        out = F.when(url.rlike(pattern), grown(pattern, 2)).otherwise(out)
    return out


def hash_shard(text: Column, shards: int) -> Column:
    """First 8 hex digits of md5, modulo."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(shards))


def redact(url: Column, names: tuple[str, ...] = ("token", "apikey", "api_key", "password", "secret"), mark: str = "***REDACTED***") -> Column:
    return F.regexp_replace(url, rf"([?&](?:{'|'.join(names)})=)[^&#]*", f"$1{mark}")
