"""Queries over collected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text, url

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


@query(f"""
    SELECT {_HOST} AS host, count(*) AS pages,
           count(DISTINCT nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '')) AS titles,
           CAST(sum(octet_length(encode(html))) AS BIGINT) AS body_bytes
    FROM pages GROUP BY 1""")
def page_host_summary(spark, sf_dir):
    p = pages(spark, sf_dir)
    return p.groupBy(url.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(text.title(F.col("html"))).alias("titles"), F.sum(F.octet_length("html")).cast("bigint").alias("body_bytes"))


@query(r"""
    SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title,
           CAST(octet_length(encode(html)) AS BIGINT) AS body_bytes, sha256(html) AS body_hash FROM pages""")
def page_meta(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.title(F.col("html")).alias("title"), F.octet_length("html").cast("bigint").alias("body_bytes"), F.sha2("html", 256).alias("body_hash"))


@query(r"""
    WITH s AS (SELECT page_id,
        len(regexp_extract_all(html, '(?i)<script[^>]+src=')) AS script_sources,
        len(regexp_extract_all(html, '(?i)<script')) - len(regexp_extract_all(html, '(?i)<script[^>]+src=')) AS inline_scripts,
        len(list_distinct(list_transform(regexp_extract_all(html, '(?i)\b(cryptojs|aes|des|rsa|hmac|sha1|sha256|sha512|md5|base64)\b'), lambda x: lower(x)))) AS crypto_signals,
        len(list_distinct(regexp_extract_all(html, '(?i)\b(webdriver|navigator\.plugins|navigator\.languages|webgl|canvas|fingerprint)\b'))) AS automation_signals
      FROM pages)
    SELECT *, 3 * crypto_signals + 2 * automation_signals AS score FROM s""")
def page_surface_signals(spark, sf_dir):
    h = F.col("html")
    words = lambda p: F.regexp_extract_all(h, F.lit(rf"(?i)(?<!\w)({p})(?!\w)"), 0)  # noqa: E731 - borders as \w has them: Java's \b takes letters of any script for part of a word
    distinct = lambda found: F.size(F.array_distinct(found)).cast("bigint")
    external = text.count_matches(h, r"(?i)<script[^>]+src=")
    s = pages(spark, sf_dir).select(
        "page_id", external.alias("script_sources"), (text.count_matches(h, r"(?i)<script") - external).alias("inline_scripts"),
        distinct(F.transform(words("cryptojs|aes|des|rsa|hmac|sha1|sha256|sha512|md5|base64"), F.lower)).alias("crypto_signals"),
        distinct(words(r"webdriver|navigator\.plugins|navigator\.languages|webgl|canvas|fingerprint")).alias("automation_signals"),
    )
    return s.withColumn("score", 3 * F.col("crypto_signals") + 2 * F.col("automation_signals"))


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_VISIBLE}) AS visible_chars, md5({_VISIBLE}) AS visible_md5 FROM pages")
def visible_text_len(spark, sf_dir):
    v = text.visible_text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.length(v).cast("bigint").alias("visible_chars"), F.md5(v).alias("visible_md5"))


_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_Q = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(f"""
    SELECT page_id, {_HOST} AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, {_Q} AS query,
           lower(regexp_extract(regexp_extract({_PATH}, '([^/]*)$', 1), '^.+(\\.[^.]*)$', 1)) AS extension
    FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", url.host(u).alias("host"), url.origin(u).alias("origin"), url.path(u).alias("path"), url.query(u).alias("query"), url.extension(u).alias("extension"))


@query(f"""
    WITH h AS (SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.') AS l FROM pages)
    SELECT page_id, CASE WHEN len(l) <= 2 THEN host
                         WHEN length(l[-1]) = 2 AND l[-2] IN ('ac','co','com','edu','gov','net','org') THEN l[-3] || '.' || l[-2] || '.' || l[-1]
                         ELSE l[-2] || '.' || l[-1] END AS domain FROM h""")
def registrable_domain(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.registrable_domain(url.host(F.col("url"))).alias("domain"))


@query(r"""
    WITH s AS (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS s FROM pages)
    SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM s""")
def url_slug(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.slug(F.col("url")).alias("slug"))


_KEPT = f"list_filter(string_split({_Q}, '&'), lambda x: x <> '' {{}})"
_CANON = f"""
    WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o, {_PATH} AS p,
                      list_sort({_KEPT.format("AND lower(split_part(x, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','referrer')")}) AS q FROM pages),
    c AS (SELECT page_id, o || regexp_replace(CASE WHEN length(p) > 1 AND p LIKE '%/' THEN p[:-2] WHEN p = '' THEN '/' ELSE p END, '/{{2,}}', '/', 'g')
                 || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM u)
"""


@query(_CANON + "SELECT page_id, canonical, sha256(canonical) AS fingerprint FROM c")
def canonical_url(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", url.canonical(u).alias("canonical"), url.fingerprint(u).alias("fingerprint"))


@query(f"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o, {_PATH} AS p, list_sort({_KEPT.format('')}) AS q FROM pages)
    SELECT page_id, o || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS unique_key FROM u""")
def unique_key(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.unique_key(F.col("url")).alias("unique_key"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^([^#]*[?&]page=)', 1) || (CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1) || regexp_extract(url, '[?&]page=[0-9]+(.*)$', 1) AS next_url
    FROM pages WHERE regexp_matches(url, '^[^#]*[?&]page=[0-9]+([&#]|$)')""")
def next_page_by_url_pattern(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.next_page(F.col("url")).alias("next_url")).where("next_url is not null")


_HREF = r"""regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"''#]+)["'']', 1)"""


@query(f"SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, {_HREF} AS h FROM pages)")
def links_regex_explode(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.posexplode(text.hrefs(F.col("html"))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT page_id, len({_HREF}) AS links, len(list_distinct({_HREF})) AS distinct_links FROM pages")
def links_distinct_per_page(spark, sf_dir):
    h = text.hrefs(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.size(h).cast("bigint").alias("links"), F.size(text.distinct_in_order(h)).cast("bigint").alias("distinct_links"))


def _links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.col("url").alias("parent"), F.explode(text.hrefs(F.col("html"))).alias("href"))


_LINKS = f"l AS (SELECT page_id, url AS parent, unnest({_HREF}) AS href FROM pages)"


@query(f"WITH {_LINKS} SELECT href, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, href LIMIT 20")
def top_hrefs(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("href").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "href").limit(20)


_KIND = r"""CASE WHEN lower(regexp_extract(regexp_extract(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)) IN ('.7z','.avi','.bmp','.css','.csv','.doc','.docx','.gif','.gz','.ico','.jpeg','.jpg','.js','.json','.m4a','.mov','.mp3','.mp4','.pdf','.png','.ppt','.pptx','.rar','.rss','.svg','.tar','.tgz','.txt','.webm','.webp','.xls','.xlsx','.xml','.zip') THEN 'asset'
    WHEN regexp_matches(lower(href), '(^|/)(logout|signout|log-out|exit)(/|$)') THEN 'logout' WHEN regexp_matches(lower(href), '/api(/|$)|[?&](api|format)=') THEN 'api'
    WHEN regexp_matches(lower(href), '([?&](page|p|pg|offset|cursor)=)|/(page|p)/[0-9]+') THEN 'pagination' WHEN regexp_matches(lower(href), '([?&](q|query|keyword|search)=)|/search(/|$)') THEN 'search'
    WHEN regexp_matches(lower(href), '([?&](category|cat|collection|tag|brand)=)|/(category|categories|collection|collections|list|listing|catalog|catalogue|browse)(/|$)') THEN 'listing'
    WHEN regexp_matches(lower(href), '/(product|products|item|items|detail|details|dp)/|/p/[a-z0-9_-]+') THEN 'detail' ELSE 'generic' END"""


@query(f"WITH {_LINKS}, k AS (SELECT page_id, {_KIND} AS kind FROM l) SELECT page_id, kind, CASE kind WHEN 'sitemap' THEN 90 WHEN 'pagination' THEN 85 WHEN 'detail' THEN 70 WHEN 'listing' THEN 45 WHEN 'search' THEN 40 WHEN 'api' THEN 30 END AS priority, count(*) AS n FROM k GROUP BY ALL")
def link_kind_classify(spark, sf_dir):
    k = _links(spark, sf_dir).select("page_id", classify.link_kind(F.col("href")).alias("kind"))
    return k.groupBy("page_id", "kind", classify.link_priority(F.col("kind")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINKS} SELECT page_id, count(*) AS kept FROM l
    WHERE regexp_extract(href, '^([a-z]+://[^/?#]+)', 1) = regexp_extract(parent, '^([a-z]+://[^/?#]+)', 1) AND NOT regexp_matches(href, '[?]') GROUP BY 1""")
def discovery_filter(spark, sf_dir):
    keep = classify.discovery_allowed(F.col("href"), F.col("parent"), exclude=("[?]",))
    return _links(spark, sf_dir).where(keep).groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {_LINKS} SELECT href, CASE WHEN regexp_matches(href, '/news') THEN 'news' WHEN regexp_matches(href, '\\.html$') THEN 'page' WHEN regexp_matches(href, '^/') THEN 'relative' END AS rule, count(*) AS n FROM l GROUP BY ALL""")
def discovery_rule_match(spark, sf_dir):
    rule = classify.first_match(F.col("href"), (("news", "/news"), ("page", r"\.html$"), ("relative", "^/")), F.lit(None))
    return _links(spark, sf_dir).groupBy("href", rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINKS}, d AS (SELECT DISTINCT parent, href FROM l), n AS (SELECT parent, count(*) AS fan_out FROM d GROUP BY 1)
    SELECT d.href, count(*) AS parents, max(fan_out) AS widest_parent FROM d JOIN n USING (parent) GROUP BY 1""")
def link_graph_degrees(spark, sf_dir):
    """Distinct parents of every target and the largest fan-out among them."""
    d = _links(spark, sf_dir).select("parent", "href").distinct()
    n = d.groupBy("parent").agg(F.count(F.lit(1)).alias("fan_out"))
    return d.join(n, "parent").groupBy("href").agg(F.count(F.lit(1)).alias("parents"), F.max("fan_out").alias("widest_parent"))


@query(r"""SELECT page_id, ('0x' || substr(md5(url), 1, 8))::BIGINT % 16 AS shard FROM pages""")
def page_shard(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.hash_shard(F.col("url"), 16).alias("shard"))


@query(r"""SELECT page_id, regexp_replace(url, '([?&](?:token|apikey|api_key|password|secret|ref)=)[^&#]*', '\1***REDACTED***', 'g') AS url FROM pages""")
def redact_url(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", url.redact(F.col("url"), ("token", "apikey", "api_key", "password", "secret", "ref")).alias("url"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<svg\b[^>]*>.*?</svg>', '', 'g'), '(?is)<(meta|link)\b[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\s+', ' ', 'g'))) AS compact_md5 FROM pages""")
def compact_dom(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(text.compact_dom(F.col("html"))).alias("compact_md5"))


@query(f"""WITH {_LINKS}, e AS (SELECT DISTINCT parent, href, {_HOST.replace('url', 'parent')} AS h FROM l),
    r AS (SELECT h, href, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, href) AS rank FROM r) SELECT h AS host, rank, href, n FROM k WHERE rank <= 3""")
def host_link_top3(spark, sf_dir):
    e = _links(spark, sf_dir).select("parent", "href", url.host(F.col("parent")).alias("host")).distinct()
    r = e.groupBy("host", "href").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "href")).cast("bigint")).where("rank <= 3").select("host", "rank", "href", "n")
