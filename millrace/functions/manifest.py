"""Media manifests, GraphQL introspection and request planning: small parsers of one text each."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

from .web import resolve


def _local(n) -> str:
    return n.tag.rpartition("}")[2]


def _kids(n, name: str):
    return [c for c in n if _local(c) == name]


def duration_seconds(text: str | None) -> float | None:
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?", text or "")
    return sum(float(x or 0) * k for x, k in zip(m.groups(), (86400, 3600, 60, 1), strict=True)) if m else None


def dash_segments(xml: str | None, base: str) -> list[str]:
    """Segments of the representation with most bandwidth: initialisation, then a list, a timeline or a numbered template."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []

    def base_of(n, above):
        b = _kids(n, "BaseURL")
        return resolve((b[0].text or "").strip(), above) if b else above

    best, total = None, duration_seconds(root.get("mediaPresentationDuration")) or 0.0
    top = base_of(root, base)
    for period in _kids(root, "Period"):
        length = duration_seconds(period.get("duration")) or total
        for group in _kids(period, "AdaptationSet"):
            for rep in _kids(group, "Representation"):
                if best is None or int(rep.get("bandwidth", 0)) > best[0]:
                    best = (int(rep.get("bandwidth", 0)), rep, group, base_of(rep, base_of(group, base_of(period, top))), length)
    if best is None:
        return []
    width, rep, group, at, length = best
    listed = _kids(rep, "SegmentList") or _kids(group, "SegmentList")
    if listed:
        first = [x.get("sourceURL") for x in _kids(listed[0], "Initialization")]
        return [resolve(u, at) for u in [*first, *(x.get("media") for x in _kids(listed[0], "SegmentURL"))] if u]
    template = _kids(rep, "SegmentTemplate") or _kids(group, "SegmentTemplate")
    if not template:
        return [at]
    t = template[0]

    def fill(pattern: str, number: int, time: int) -> str:
        values = {"RepresentationID": rep.get("id", ""), "Bandwidth": str(width), "Number": number, "Time": time}
        put = lambda m: (f"{int(values[m[1]]):0{int(m[2])}d}" if m[2] else str(values[m[1]]))
        return resolve(re.sub(r"\$(RepresentationID|Bandwidth|Number|Time)(?:%0(\d+)d)?\$", put, pattern), at)

    number, out = int(t.get("startNumber", 1)), []
    if t.get("initialization"):
        out.append(fill(t.get("initialization"), number, 0))
    scale, lines = int(t.get("timescale", 1)), _kids(t, "SegmentTimeline")
    if lines:
        time = 0
        for s in _kids(lines[0], "S"):
            time = int(s.get("t", time))
            for _ in range(int(s.get("r", 0)) + 1):
                out.append(fill(t.get("media"), number, time))
                number, time = number + 1, time + int(s.get("d"))
    elif t.get("duration"):
        for k in range(-(-int(length * scale) // int(t.get("duration")))):
            out.append(fill(t.get("media"), number + k, k * int(t.get("duration"))))
    return out


def type_name(t: dict | None) -> str | None:
    """A GraphQL type reference as written: [T!]!"""
    if not t:
        return None
    if t.get("kind") == "NON_NULL":
        return f"{type_name(t.get('ofType'))}!"
    return f"[{type_name(t.get('ofType'))}]" if t.get("kind") == "LIST" else t.get("name")


def introspection(body: str | None) -> list[dict]:
    """(type, kind, field, returns) of an introspection answer; built-in types are left out."""
    try:
        schema = (json.loads(body or "").get("data") or {}).get("__schema") or {}
    except (ValueError, AttributeError):
        return []
    return [{"type": t["name"], "kind": t["kind"], "field": f["name"], "returns": type_name(f.get("type"))} for t in schema.get("types", []) if not t["name"].startswith("__") for f in t.get("fields") or []]


def next_request(url: str, method: str, body: str | None, cursor: str, variable: str = "after") -> dict:
    """The request with the cursor set: in the variables of a JSON body, or as a query parameter."""
    try:
        sent = json.loads(body) if body else None
    except ValueError:
        sent = None
    if isinstance(sent, dict) and ("query" in sent or "variables" in sent):
        sent["variables"] = {**(sent.get("variables") or {}), variable: cursor}
        return {"url": url, "method": method, "body": json.dumps(sent, sort_keys=True)}
    bare = re.sub(rf"([?&]){variable}=[^&#]*&?", r"\1", url).rstrip("?&")
    return {"url": f"{bare}{'&' if '?' in bare else '?'}{variable}={cursor}", "method": method, "body": body}


def widest(types: list[str]) -> list[str]:
    return sorted(set(types))
