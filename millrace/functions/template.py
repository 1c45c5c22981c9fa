"""Templates, globs and small parsers that compile to columns at plan time."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import first_match

_TOKEN = re.compile(r"\{\{\s*([\w.\[\]-]+)\s*\}\}")


def path_of(state: Column, dotted: str) -> Column:
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in re.split(r"[.\[\]]+", dotted) if p)
    return F.get_json_object(state, "$" + steps)


def interpolate(template: str, state: Column, strict: bool = False) -> Column:
    """``{{ a.b }}`` from a JSON column; a missing value is empty, or makes the whole null if ``strict``. No row-level parsing: tokens become columns."""
    parts, at = [], 0
    for m in _TOKEN.finditer(template):
        parts += [F.lit(template[at : m.start()]), path_of(state, m[1]) if strict else F.coalesce(path_of(state, m[1]), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def has_template(text: Column) -> Column:
    return text.rlike(_TOKEN.pattern)


def glob_pattern(glob: str) -> tuple[str, list[str]]:
    """Regular expression and parameter names of a path glob: ``:name`` a segment, ``*`` within one, ``**`` any."""
    names, out = [], ""
    for t in re.findall(r"\*\*|\*|:\w+|[^*:]+|:", glob):
        if t == "**":
            out += ".*"
        elif t == "*":
            out += "[^/]*"
        elif t.startswith(":") and len(t) > 1:
            names.append(t[1:])
            out += "([^/]+)"
        else:
            out += re.escape(t)
    return f"^{out}$", names


def glob_match(path: Column, glob: str) -> Column:
    """Map of parameters where the path fits, null elsewhere."""
    pattern, names = glob_pattern(glob)
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(path, pattern, i + 1))]
    return F.when(path.rlike(pattern), F.create_map(*pairs).cast("map<string,string>"))


def route(path: Column, globs: list[tuple[str, str]]) -> Column:
    """Name of the first glob that fits, else ``default``."""
    return first_match(path, [(name, glob_pattern(g)[0]) for name, g in globs], F.lit("default"))


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition: the extended form first."""
    wide = F.nullif(F.url_decode(F.regexp_extract(header, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1)), F.lit(""))
    plain = F.nullif(F.regexp_extract(header, r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1), F.lit(""))
    return F.coalesce(wide, plain)


# Marks of sign-in pages.
LOGIN_URL = r"(?i)/(login|signin|sign-in|auth|sso|oauth|authorize)(/|$|\?)"
LOGIN_MARKS = {
    "password": r"(?i)<input[^>]+type=[\"']password[\"']",
    "mfa": r"(mfa|2fa|two[-\s]?factor|verification code|otp|一次性|验证码|二次验证)",
    "captcha": r"(captcha|recaptcha|hcaptcha|geetest|turnstile|验证码)",
    "qr": r"(qr code|scan to login|扫码|二维码)",
    "risk": r"(risk|unusual activity|verify your identity|账号风险|安全验证|风控|账户异常)",
    "passkey": r"(passkey|webauthn|security key|biometric|通行密钥|安全密钥)",
    "success": r"(logout|sign out|dashboard|my account|profile|退出登录|个人中心|账户中心)",
    "expired": r"(session expired|token expired|please login again|登录已过期|会话过期|unauthorized)",
}


def login_state(body: Column, link: Column | None = None, status: Column | None = None, has_session: Column | None = None, location: Column | None = None) -> Column:
    """state, reason, authenticated, terminal and recoverable of a page seen while signing in. Text is address and body together."""
    link, location = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (link, location))
    status = F.lit(200) if status is None else F.coalesce(status, F.lit(200))
    text = F.concat_ws("\n", link, F.coalesce(body, F.lit("")))
    low = F.lower(text)
    mark = {k: low.rlike(p) for k, p in LOGIN_MARKS.items()}
    moved = status.isin(301, 302, 303, 307, 308)
    delegated = link.rlike("(?i)oauth|authorize|openid|saml|sso") | low.rlike("idp|identity provider")
    session = F.lit(False) if has_session is None else F.coalesce(has_session, F.lit(False))
    # States and reasons, the first that holds
    rules = (
        ("manual_required", "passkey-webauthn", mark["passkey"]), ("manual_required", "qr-login", mark["qr"]), ("risk_challenge", "account-risk", mark["risk"] | (status == 423)),
        ("captcha_challenge", "captcha", mark["captcha"]), ("mfa_challenge", "mfa", mark["mfa"]), ("sso_redirect", "oauth-sso-redirect", delegated & moved),
        ("expired", "auth-expired", status.isin(401, 403, 419, 440) | mark["expired"]), ("login_page", "login-form", text.rlike(LOGIN_MARKS["password"]) | link.rlike(LOGIN_URL) | location.rlike(LOGIN_URL)),
        ("authenticated", "session-artifacts", mark["success"] | session), ("redirecting", "http-redirect", moved),
    )
    pick = lambda at, other: reduce(lambda c, r: c.when(r[2], r[at]), rules[1:], F.when(rules[0][2], rules[0][at])).otherwise(other)
    state = pick(0, F.lit("unknown"))
    return F.struct(
        state.alias("state"), pick(1, F.lit(None)).alias("reason"), (state == "authenticated").alias("authenticated"),
        state.isin("authenticated", "manual_required", "risk_challenge").alias("terminal"),
        state.isin("expired", "login_page", "captcha_challenge", "mfa_challenge", "redirecting", "sso_redirect").alias("recoverable"),
    )


def normalize_priority(value: Column, fallback: int = 0) -> Column:
    return F.greatest(F.lit(-1000), F.least(F.lit(1000), F.coalesce(F.regexp_extract(value, r"^\s*(-?[0-9]+)", 1).try_cast("int"), F.lit(fallback))))


def queue_priority(explicit: Column, source: Column, depth: Column, base: dict[str, int], penalty: int = 5) -> Column:
    """Explicit, else the source's base less a penalty for each level of depth."""
    named = reduce(lambda a, kv: F.when(source == kv[0], kv[1]).otherwise(a), base.items(), F.lit(0))
    return F.coalesce(explicit, named - depth * penalty)


def source_kind(link: Column, content_type: Column, body: Column) -> Column:
    """websocket, feed, sitemap, graphql, json, html or binary."""
    u, c, b = F.lower(link), F.lower(F.coalesce(content_type, F.lit(""))), F.ltrim(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2000)))
    return (
        F.when(u.rlike("^wss?:"), "websocket").when(c.rlike("rss|atom") | b.rlike(r"^(<\?xml[^>]*>\s*)?<(rss|feed)\b"), "feed").when(b.rlike("<(urlset|sitemapindex)"), "sitemap")
        .when(u.rlike("/graphql") , "graphql").when(c.contains("json") | b.rlike(r"^[\[{]"), "json").when(c.contains("html") | b.rlike(r"<(html|!doctype|body|div|p)\b"), "html").otherwise("binary")
    )


def jittered(delay_ms: Column, share: float, *key: Column) -> Column:
    """Delay plus up to ``share`` of it, by a hash of the key, so that reruns agree."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / 1_000_000.0)
    return (delay_ms * (1 + share * u)).cast("bigint")
