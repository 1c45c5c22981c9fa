"""Declarative extraction plans compiled to one DataFrame projection.

A plan is a dict: name, extract (list of rules), discovery, quality.schema, dedup. A rule is
{name, type, ...} with type regex, json, css, links, xpath, media, surface, meta or json_ld. A later
rule of the same name replaces an earlier one. Responses: (url, body[, status, headers]).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, text, udf, url

KINDS = {"regex", "json", "css", "links", "xpath", "media", "surface", "meta", "json_ld"}


class PlanError(ValueError):
    pass


def validate(plan: dict) -> dict:
    """The plan with defaults; raises for what can't be compiled."""
    if not isinstance(plan.get("name"), str) or not plan["name"]:
        raise PlanError("a plan needs a name")
    rules = plan.get("extract", [])
    for r in rules:
        if r.get("type") not in KINDS:
            raise PlanError(f"rule {r.get('name')}: type {r.get('type')} is not one of {sorted(KINDS)}")
        if not r.get("name"):
            raise PlanError("a rule needs a name")
        if r["type"] == "regex":
            try:
                re.compile(r["pattern"])
            except (re.error, KeyError) as e:
                raise PlanError(f"rule {r['name']}: {e}") from None
    discovery = {"sameOrigin": True, "include": [], "exclude": [], "maxLinksPerPage": 50, **plan.get("discovery", {})}
    return {**plan, "extract": list({r["name"]: r for r in rules}.values()), "discovery": discovery, "quality": plan.get("quality", {})}


def json_path(column: Column, path: str) -> Column:
    """Dotted path; digits index arrays; null for invalid JSON or a missing key."""
    if not path:
        return F.expr("1") if column is None else F.to_json(F.try_parse_json(column))
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.replace("[", ".").replace("]", "").split(".") if p)
    return F.get_json_object(column, "$" + steps)


def rule_column(rule: dict, body: Column, link: Column) -> Column:
    """Value of a rule that needs no parsed page."""
    kind, limit = rule["type"], rule.get("maxItems", 50)
    if kind == "regex":
        grouped = re.compile(rule["pattern"]).groups > 0
        flags = "(?i)" if "i" in rule.get("flags", "") else ""
        if rule.get("all"):
            return F.slice(F.regexp_extract_all(body, F.lit(flags + rule["pattern"]), 1 if grouped else 0), 1, limit)
        hit = F.regexp_extract(body, flags + rule["pattern"], 1 if grouped else 0)
        return F.when(body.rlike(flags + rule["pattern"]), hit)
    if kind == "json":
        return json_path(body, rule.get("path", ""))
    if kind == "meta":
        return F.struct(link.alias("url"), text.title(body).alias("title"), F.octet_length(body).alias("bodyBytes"), F.sha2(body, 256).alias("bodyHash"))
    external = text.count_matches(body, r"(?i)<script[^>]+src=")
    return F.struct(external.alias("scripts"), (text.count_matches(body, r"(?i)<script") - external).alias("inlineScripts"), F.sha2(body, 256).alias("bodyHash"))


HTML_KINDS = ("css", "links", "xpath", "media", "json_ld")


def _page_column(rule: dict, found: Column) -> Column:
    """A rule's value from the texts that it found in the parsed page."""
    kind, limit = rule["type"], rule.get("maxItems", 50)
    if kind == "links":
        return F.slice(text.distinct_in_order(found), 1, limit)
    if kind == "media":
        one = udf.ASSET.removeprefix("array<").removesuffix(">")
        return F.transform(found, lambda x: F.from_json(x, one))
    if kind == "json_ld":
        return found
    return F.slice(found, 1, limit) if rule.get("all") else F.try_element_at(found, F.lit(1))


def extract(plan: dict, responses: DataFrame) -> DataFrame:
    """``responses`` with ``extracted``: one struct of all rules. A page is parsed once for all of its HTML rules."""
    plan = validate(plan)
    html = [r for r in plan["extract"] if r["type"] in HTML_KINDS]
    out = responses.withColumn("_page", udf.page_rules(F.col("body"), F.col("url"), html)) if html else responses
    columns = []
    for r in plan["extract"]:
        value = _page_column(r, F.col(f"_page.r{html.index(r)}")) if r in html else rule_column(r, F.col("body"), F.col("url"))
        columns.append(value.alias(r["name"]))
    return out.withColumn("extracted", F.struct(*columns)).select(*responses.columns, "extracted")


def discover(plan: dict, responses: DataFrame) -> DataFrame:
    """Link rows of every page: absolute, distinct, filtered, classified and prioritised; then the first ``maxLinksPerPage`` of a page.

    All tests run inside a page's own array, so pages never meet. ``discovery``: sameOrigin, include and exclude (patterns),
    respectNoFollow, classify, enqueueCanonical, enqueueAlternateLanguages, skipLogout, skipAssetLinks, fileExtensions that
    are no pages, and rules {pattern, action, priority, label}, of which the first that fits counts. Sitemaps and feeds give their
    locations; ``content_type`` is read where responses have it.
    """
    d = validate(plan)["discovery"]
    kind_of = F.col("content_type") if "content_type" in responses.columns else None
    pages = responses.select(F.col("url").alias("parent"), udf.link_candidates(F.col("body"), F.col("url"), kind_of).alias("page"))
    source = F.coalesce(F.col("page.source"), F.lit("discovery"))
    xml, rules = F.col("page.source").isNotNull(), d.get("rules", [])

    def wanted(x: Column) -> Column:
        keep = classify.discovery_allowed(x["url"], F.col("parent"), tuple(d["include"]), tuple(d["exclude"]), d["sameOrigin"])
        if d.get("respectNoFollow"):
            keep = keep & ~x["nofollow"]
        if d.get("fileExtensions"):
            keep = keep & (xml | ~url.extension(x["url"]).isin(*d["fileExtensions"]))
        return F.coalesce(keep, F.lit(False))

    def described(x: Column) -> Column:
        kind = classify.link_kind(x["url"], x["rel"], x["hreflang"], x["media_type"], x["text"], x["tag"], F.col("page.next")) if d.get("classify", True) else F.lit("generic")
        sitemap = (F.col("page.source") == "sitemap") & ((url.extension(x["url"]) == ".xml") | F.contains(F.lower(x["url"]), F.lit("sitemap")))
        kind = F.when(F.coalesce(sitemap, F.lit(False)), "sitemap").otherwise(kind)
        rule = classify.first_match(x["url"], [(str(i), r["pattern"]) for i, r in enumerate(rules)], F.lit(None)).cast("int") if rules else F.lit(None).cast("int")
        of = lambda name: F.coalesce(*[F.when(rule == i, F.lit(r[name])) for i, r in enumerate(rules) if r.get(name) is not None], F.lit(None))
        label = F.when(kind.isin("sitemap", "pagination"), kind)
        return F.struct(
            x["url"].alias("url"), kind.alias("kind"), F.coalesce(of("priority").cast("int"), classify.link_priority(kind)).alias("priority"), F.coalesce(of("label").cast("string"), label).alias("label"),
            x["text"].alias("anchor"), x["rel"].alias("rel"), x["nofollow"].alias("nofollow"), x["hreflang"].alias("hreflang"), F.coalesce(of("action") == "skip", F.lit(False)).alias("skip"),
        )

    gone = [k for k, on in (("canonical", not d.get("enqueueCanonical")), ("alternate-language", not d.get("enqueueAlternateLanguages")), ("logout", d.get("skipLogout", True)), ("asset", d.get("skipAssetLinks", True))) if on]
    links = F.transform(F.filter("page.links", wanted), described)
    links = F.slice(F.filter(links, lambda x: ~x["kind"].isin(*gone) & ~x["skip"] if gone else ~x["skip"]), 1, d["maxLinksPerPage"])
    rows = pages.select("parent", source.alias("source"), F.posexplode(links).alias("pos", "x")).select("parent", "source", "pos", "x.*").drop("skip")
    return rows.withColumn("unique_key", url.unique_key(F.col("url")))


def is_empty(value: Column, kind: str) -> Column:
    out = value.isNull()
    if kind == "string":
        out = out | (F.trim(value) == "")
    elif kind.startswith("array"):
        out = out | (F.size(value) == 0)
    return F.coalesce(out, F.lit(True))


def assess(plan: dict, extracted: DataFrame) -> DataFrame:
    """``issues`` and ``valid`` of every row by the plan's schema; rows are never dropped."""
    schema = validate(plan)["quality"].get("schema", {})
    fields = {f.name: f.dataType.simpleString() for f in extracted.schema["extracted"].dataType.fields}
    issues = []
    for name in schema.get("required", []):
        missing = is_empty(F.col(f"extracted.{name}"), fields[name]) if name in fields else F.lit(True)
        issues.append(F.when(missing, F.lit(f"missing:{name}")))
    plain = {"string": "string", "array": "array", "number": ("bigint", "int", "double"), "boolean": "boolean", "object": "struct"}
    for name, want in schema.get("types", {}).items():
        if name in fields and not fields[name].startswith(plain[want]):
            numeric = want == "number" and fields[name] == "string"
            wrong = F.col(f"extracted.{name}").isNotNull() & (F.col(f"extracted.{name}").try_cast("double").isNull() if numeric else F.lit(True))
            issues.append(F.when(wrong, F.lit(f"type:{name}")))
    found = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
    return extracted.withColumn("issues", found).withColumn("valid", F.size("issues") == 0)
