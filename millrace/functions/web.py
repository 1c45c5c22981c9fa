"""Web formats that columns can't parse: URL resolution, HTML with selectors and XPath, robots, manifests, feeds.

Plain Python on one text each; ``functions.udf`` wraps them for Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

# Elements without content, and those that another one closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "form", "pre"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def resolve(link: str | None, base: str | None = None) -> str | None:
    """Absolute URL with lower-case scheme and host, no default port, percent-encoded path; null if there is none."""
    if link is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", link.strip()).replace("\\", "/"))
        if not parts.scheme or (parts.scheme in ("http", "https") and not parts.hostname):
            return None
        netloc = parts.hostname or ""
        if any(ord(c) > 127 for c in netloc):
            netloc = netloc.encode("idna").decode()
        if parts.port and parts.port != {"http": 80, "https": 443}.get(parts.scheme):
            netloc += f":{parts.port}"
        path = quote(parts.path, safe="/%:@!$&'()*+,;=~-._") or ("/" if netloc else "")
        return urlunsplit((parts.scheme.lower(), netloc.lower(), path, quote(parts.query, safe="=&%/?:@!$'()*+,;~-._[]"), quote(parts.fragment, safe="=&%/?:@!$'()*+,;~-._")))
    except (ValueError, UnicodeError):
        return None


# ---------------------------------------------------------------- documents


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") and self.tag != c.tag else c.text() for c in self.children)

    def elements(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.elements()

    def html(self) -> str:
        inner = "".join(c if isinstance(c, str) else c.outer() for c in self.children)
        return inner

    def outer(self) -> str:
        attrs = "".join(f' {k}="{v or ""}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{self.html()}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str | Node | None) -> Node:
    if isinstance(html, Node):
        return html
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# ---------------------------------------------------------------- selectors

_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:([~*^$|]?=)["']?([^"'\]]*)["']?)?\]|:(last-child|first-child|nth-of-type\((\d+)\))""")


def _compound(text: str):
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not understood: {text}")
        tests.append(m.groups())
        at = m.end()
    return tests


def _fits(node: Node, tests) -> bool:
    for tag, id_, cls, attr, op, value, pseudo, nth in tests:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if id_ and node.attrs.get("id") != id_:
            return False
        if cls and cls not in (node.attrs.get("class") or "").split():
            return False
        if attr:
            v = node.attrs.get(attr)
            if attr not in node.attrs:
                return False
            v = v or ""
            if op and not {"=": v == value, "~=": value in v.split(), "*=": value in v, "^=": v.startswith(value), "$=": v.endswith(value), "|=": v == value or v.startswith(value + "-")}[op]:
                return False
        if pseudo:
            same = [c for c in node.parent.children if isinstance(c, Node)]
            if pseudo == "last-child" and same[-1] is not node or pseudo == "first-child" and same[0] is not node:
                return False
            if nth and [c for c in same if c.tag == node.tag].index(node) != int(nth) - 1:
                return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements in document order: tags, ids, classes, attributes, descendants, children, commas, first-/last-child, nth-of-type."""
    chains = []
    for part in selector.split(","):
        tokens = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip())
        chains.append([(t if t == ">" else _compound(t)) for t in tokens])

    def match(node, chain) -> bool:
        if not _fits(node, chain[-1]):
            return False
        rest = chain[:-1]
        if not rest:
            return True
        if rest[-1] == ">":
            return node.parent.tag != "#document" and match(node.parent, rest[:-1])
        up = node.parent
        while up and up.tag != "#document":
            if match(up, rest):
                return True
            up = up.parent
        return False

    return [n for n in root.elements() if any(match(n, c) for c in chains)]


def xpath(root: Node, expression: str) -> list[str]:
    """Strings of //a/b[@x="y"][n]/@attr or text(), and unions of those."""
    out = []
    for path in expression.split("|"):
        now = [root]
        for axis, step in re.findall(r"(//|/)([^/]+(?:\[[^\]]*\])?)", path.strip()):
            m = re.match(r"@([\w:-]+)$", step)
            pool = [d for n in now for d in (n.elements() if axis == "//" else (c for c in n.children if isinstance(c, Node)))]
            if m:
                now = [n.attrs[m[1]] for n in ([*now, *pool] if axis == "//" else now) if m[1] in n.attrs]
                break
            if step == "text()":
                now = [c.strip() for n in (pool if axis == "//" else now) for c in n.children if isinstance(c, str) and c.strip()]
                break
            name = re.match(r"[\w*-]+", step)[0]
            pool = [n for n in dict.fromkeys(pool) if name in ("*", n.tag)]
            for p in re.findall(r"\[([^\]]*)\]", step):
                a = re.match(r"@([\w:-]+)(?:\s*=\s*[\"'](.*)[\"'])?$", p)
                if a:
                    pool = [n for n in pool if a[1] in n.attrs and (a[2] is None or n.attrs[a[1]] == a[2])]
                else:
                    k = int(p)
                    kept, seen = [], {}
                    for n in pool:
                        seen[id(n.parent)] = seen.get(id(n.parent), 0) + 1
                        if seen[id(n.parent)] == k:
                            kept.append(n)
                    pool = kept
            now = pool
        out += [x if isinstance(x, str) else x.text().strip() for x in now]
    return out


URL_ATTRIBUTES = {"href", "src", "action", "poster"}


def css(html: str | None, selector: str, attribute: str = "text", base: str | None = None) -> list[str]:
    out = []
    for n in select(parse_html(html), selector):
        if attribute == "text":
            out.append(re.sub(r"\s+", " ", n.text()).strip())
        elif attribute == "html":
            out.append(n.html())
        elif attribute in n.attrs:
            v = n.attrs[attribute] or ""
            out.append((resolve(v, base) or v) if attribute in URL_ATTRIBUTES and base else v)
    return out


# ---------------------------------------------------------------- media

# Media kinds of extensions.
MEDIA = {
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image", ".webp": "image", ".avif": "image", ".svg": "image", ".bmp": "image", ".ico": "image", ".tif": "image", ".tiff": "image",
    ".mp4": "video", ".m4v": "video", ".mov": "video", ".mkv": "video", ".webm": "video", ".m3u8": "video", ".mpd": "video", ".ts": "video", ".avi": "video", ".flv": "video", ".wmv": "video",
    ".mp3": "audio", ".m4a": "audio", ".aac": "audio", ".wav": "audio", ".flac": "audio", ".ogg": "audio", ".oga": "audio", ".opus": "audio", ".weba": "audio", ".wma": "audio",
}


def media_kind(link: str | None, mime: str | None = None, hint: str = "") -> str | None:
    if mime and (m := re.match(r"(image|video|audio)/", mime.lower())):
        return m[1]
    ext = re.search(r"\.[a-z0-9]+$", urlsplit(link or "").path.lower())
    if ext and ext[0] in MEDIA:
        return MEDIA[ext[0]]
    return next((k for k in ("image", "video", "audio") if k in hint.lower()), None)


def srcset(value: str | None) -> list[str]:
    return [p.split()[0] for p in (value or "").split(",") if p.strip()]


def media_assets(html: str | None, base: str, limit: int = 200) -> list[dict]:
    """Media of a page, distinct by kind and URL, first found first: elements, then meta data, then JSON-LD."""
    import json

    root, found = parse_html(html), {}

    def add(link, kind, source, tag, attr, **more):
        u = resolve(link, base)
        kind = kind or media_kind(u)
        if u and kind and (kind, u) not in found:
            found[kind, u] = {"url": u, "kind": kind, "source": source, "tag": tag, "attribute": attr, "title": more.get("title"), "alt": more.get("alt")}

    for n in root.elements():
        a = n.attrs
        if n.tag == "img":
            for attr in ("src", "data-src", "data-original"):
                if a.get(attr):
                    add(a[attr], "image", "dom", "img", attr, alt=a.get("alt"), title=a.get("title"))
            for u in srcset(a.get("srcset")):
                add(u, "image", "dom", "img", "srcset", alt=a.get("alt"))
        elif n.tag in ("video", "audio"):
            if a.get("src"):
                add(a["src"], n.tag, "dom", n.tag, "src", title=a.get("title"))
            if a.get("poster"):
                add(a["poster"], "image", "dom", n.tag, "poster")
        elif n.tag == "source":
            kind = media_kind(a.get("src"), a.get("type")) or ("image" if n.parent.tag == "picture" else n.parent.tag if n.parent.tag in ("video", "audio") else None)
            for u in ([a["src"]] if a.get("src") else []) + srcset(a.get("srcset")):
                add(u, kind, "dom", "source", "src")
        elif n.tag == "a" and a.get("href"):
            add(a["href"], None, "dom", "a", "href", title=re.sub(r"\s+", " ", n.text()).strip() or None)
        if "url(" in (a.get("style") or ""):
            for u in re.findall(r"url\([\"']?([^\"')]+)", a["style"]):
                add(u, "image", "dom", n.tag, "style")
    for n in root.elements():
        a = n.attrs
        if n.tag == "meta" and (m := re.match(r"(?:og|twitter):(image|video|audio)", a.get("property") or a.get("name") or "")):
            add(a.get("content"), m[1], "meta", "meta", "content")
        elif n.tag == "link" and (a.get("rel") == "image_src" or a.get("rel") == "preload" and a.get("as") in ("image", "video", "audio")):
            add(a.get("href"), a["as"] if a.get("as") else "image", "meta", "link", "href")
    for block in json_ld(root):
        stack = [(block, None)]
        while stack:
            x, kind = stack.pop(0)
            if isinstance(x, list):
                stack = [(y, kind) for y in x] + stack
            elif isinstance(x, dict):
                own = media_kind(None, None, str(x.get("@type", ""))) or kind
                for key in ("contentUrl", "url", "embedUrl", "image", "thumbnailUrl"):
                    if isinstance(x.get(key), str):
                        add(x[key], "image" if "image" in key or "thumb" in key else own, "json-ld", "script", key, title=x.get("name"))
                stack = [(y, own) for y in x.values() if isinstance(y, (dict, list))] + stack
    del json
    return list(found.values())[:limit]


def json_ld(root: Node) -> list:
    import json

    out = []
    for n in select(root, 'script[type="application/ld+json"]'):
        try:
            out.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
        except ValueError:
            continue
    return out


# ---------------------------------------------------------------- robots, sitemaps, feeds, manifests


def parse_robots(text: str | None) -> dict:
    """groups of (agents, rules, delay) and sitemaps."""
    groups, sitemaps, now, fresh = [], [], None, False
    for line in (text or "").replace("\r", "\n").split("\n"):
        line = line.split("#")[0].strip()
        key, _, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if now is None or not fresh:
                now = {"agents": [], "rules": [], "delay": None}
                groups.append(now)
            now["agents"].append(value.lower())
            fresh = True
        elif key == "sitemap":
            sitemaps.append(value)
        elif now is not None and key in ("allow", "disallow", "crawl-delay"):
            fresh = False
            if key == "crawl-delay":
                try:
                    now["delay"] = float(value)
                except ValueError:
                    pass
            elif value:
                now["rules"].append((key == "allow", value))
    return {"groups": groups, "sitemaps": sitemaps}


def robots_allowed(robots: str | None, link: str, agent: str = "*") -> bool:
    """Longest matching prefix wins, allow before disallow of the same length; no match is allowed. Groups that name the agent replace the general ones."""
    groups = parse_robots(robots)["groups"]
    own = [g for g in groups if any(a != "*" and a in agent.lower() for a in g["agents"])] or [g for g in groups if "*" in g["agents"]]
    parts = urlsplit(link)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    best = max(((len(p.split("*")[0]), allow) for g in own for allow, p in g["rules"] if path.startswith(p.split("*")[0])), default=(0, True))
    return best[1]


def crawl_delay_ms(robots: str | None, agent: str = "*", cap_ms: int = 60_000) -> int:
    groups = parse_robots(robots)["groups"]
    own = [g for g in groups if any(a != "*" and a in agent.lower() for a in g["agents"])] or [g for g in groups if "*" in g["agents"]]
    return min(cap_ms, int(1000 * max((g["delay"] or 0 for g in own), default=0)))


def hls_variants(text: str | None, base: str) -> list[dict]:
    """Variants of a master playlist, best bandwidth first; or segments of a media playlist, initialisation first."""
    lines, out, band = [x.strip() for x in (text or "").split("\n")], [], None
    for i, line in enumerate(lines):
        if line.startswith("#EXT-X-STREAM-INF"):
            m = re.search(r"BANDWIDTH=(\d+)", line)
            band = int(m[1]) if m else 0
        elif line.startswith("#EXT-X-MAP") and (m := re.search(r'URI="([^"]+)"', line)):
            out.insert(0, {"url": resolve(m[1], base), "bandwidth": None})
        elif line and not line.startswith("#"):
            out.append({"url": resolve(line, base), "bandwidth": band})
            band = None
    return sorted(out, key=lambda x: -(x["bandwidth"] or 0)) if any(x["bandwidth"] is not None for x in out) else out


def feed_items(xml: str | None) -> list[dict]:
    """Items of RSS, then entries of Atom."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    local = lambda n: n.tag.rpartition("}")[2]
    out = []
    for kind in ("item", "entry"):
        for n in root.iter():
            if local(n) == kind:
                f = {local(c): (c.text or c.attrib.get("href") or "").strip() for c in reversed(list(n))}
                out.append({"title": f.get("title"), "link": f.get("link"), "description": f.get("description") or f.get("summary"), "published": f.get("pubDate") or f.get("published") or f.get("updated")})
    return out


# ---------------------------------------------------------------- links to follow

LINKS = 'a[href], link[rel="next"][href], link[rel="canonical"][href], link[rel="alternate"][hreflang][href]'


def xml_source(body: str | None, link: str | None = None, content_type: str | None = None) -> str | None:
    """feed or sitemap, by content type, address and first elements."""
    b, u, c = (body or "").lstrip().lower(), (link or "").lower(), (content_type or "").lower()
    if "rss" in c or "atom" in c or b.startswith("<rss") or "<feed" in b:
        return "feed"
    return "sitemap" if "xml" in c or "sitemap" in u or "<urlset" in b or "<sitemapindex" in b else None


def link_candidates(body: str | None, base: str, content_type: str | None = None) -> dict:
    """source, next page and all links of a response, distinct by URL, in order of the page; the next page leads."""
    source, rows, after = xml_source(body, base, content_type), [], None
    if source:
        found = re.findall(r"<item\b[\s\S]*?<link\b[^>]*>([\s\S]*?)</link>", body or "", re.I) + re.findall(r"<entry\b[\s\S]*?<link\b[^>]*href=[\"']([^\"']+)", body or "", re.I)
        if source == "sitemap":
            found = re.findall(r"<(?:url|sitemap)\b[^>]*>[\s\S]*?<loc\b[^>]*>([\s\S]*?)</loc>", body or "", re.I)
        rows = [{"url": resolve(html_text(x).strip(), base), "tag": None} for x in found]
    else:
        root = parse_html(body)
        after = next_page(root, base)
        if after:
            rows.append({"url": after, "tag": "link", "rel": "next"})
        for n in select(root, LINKS):
            a = n.attrs
            rel = (a.get("rel") or "").strip() or None
            row = {"url": resolve(a.get("href"), base), "tag": n.tag, "rel": rel, "text": re.sub(r"\s+", " ", n.text()).strip() or None, "hreflang": (a.get("hreflang") or "").strip().lower() or None, "media_type": (a.get("type") or "").strip().lower() or None}
            rows.append(row)
        if after and any(r["url"] == after for r in rows[1:]):
            rows = rows[1:]  # the page's own element stands for the next page, at its own place
    keep = {}
    for r in rows:
        if r["url"]:
            keep.setdefault(r["url"], {k: r.get(k) for k in ("url", "tag", "rel", "text", "hreflang", "media_type")} | {"nofollow": "nofollow" in (r.get("rel") or "").lower().split()})
    return {"source": source, "next": after, "links": list(keep.values())}


def html_text(raw: str) -> str:
    """Text between tags with a CDATA wrapper and entities undone."""
    import html

    return html.unescape(re.sub(r"^\s*<!\[CDATA\[([\s\S]*?)\]\]>\s*$", r"\1", raw))


def next_page(html: str | Node | None, base: str) -> str | None:
    """Target of the first next-page link that leads elsewhere."""
    root = parse_html(html)
    for s in ('link[rel~="next"]', 'a[rel~="next"]', 'a[aria-label*="Next"]', 'a[aria-label*="next"]', "a.next", ".next a", ".pagination-next a", "a.pagination-next", 'a[class*="next"]'):
        for n in select(root, s):
            u = resolve(n.attrs.get("href"), base)
            if u and u != base:
                return u
    return None
