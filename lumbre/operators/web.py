"""Addresses, crawl policies, and the content of HTML pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib import robotparser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes of addresses that aren't pages, and schemes that are fetched.
EXCLUDED = [r"\.pdf$", r"\.jpg$", r"\.jpeg$", r"\.png$", r"\.gif$", r"\.svg$", r"\.webp$", r"\.zip$", r"\.rar$", r"\.mp4$", r"\.mp3$"]
SCHEMES = ["http", "https"]
#: How links that aren't addresses begin.
NO_ADDRESS = ("javascript:", "mailto:", "tel:")
#: Where JSON-LD records hold each field of a document, in the order of preference.
LINKED = {
    "entity_name": ["name"],
    "review_author": ["author.name", "author"],
    "review_date": ["datePublished"],
    "rating": ["aggregateRating.ratingValue", "reviewRating.ratingValue", "ratingValue"],
    "location": ["address.addressLocality", "address.addressRegion", "address.addressCountry", "location"],
    "content_type": ["@type"],
}
#: Elements that end an open paragraph, and elements without an end.
_BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = {"script", "style", "template"}


def normalise_url(base: str | None, href: str | None) -> str | None:
    """The absolute address of a link without fragment and parameters; null for a blank one, for other kinds of links and without a host."""
    target = (href or "").strip()
    try:
        to = urlsplit(urljoin(base or "", target)) if target and not target.startswith(NO_ADDRESS) else None
    except ValueError:
        to = None
    if to is None or not to.netloc:
        return None
    folder, slash, name = to.path.rpartition("/")
    return urlunsplit((to.scheme, to.netloc, folder + slash + name.partition(";")[0], to.query, ""))


@F.pandas_udf(StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else normalise_url(b, h) for b, h in zip(base, href)], dtype=object)


def normalised_url(base: Column, href: Column) -> Column:
    """``normalise_url`` as a column. An address that is plain and absolute only loses its fragment; the others, and only they, are resolved in Python."""
    target = F.trim(href)
    plain = target.rlike(r"^https?://[A-Za-z0-9.:-]+(/[^;#?]*)?(\?[^#;]*)?(#.*)?$") & ~target.rlike(r"^[^?#]*/\.{1,2}(/|$|[?#])|\s")
    return F.when(plain, F.regexp_replace(target, "[?]?(#.*)?$", "")).otherwise(_resolved(F.when(plain, None).otherwise(base), F.when(plain, None).otherwise(href)))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def doc_id(url: Column) -> Column:
    return F.sha1(F.encode(url, "utf-8"))


def clean_domain(value: str) -> str:
    """Host of an address or domain as written."""
    text = value.strip().lower()
    named = urlsplit(text).hostname if "://" in text else None
    return (named or text).split("/")[0]


def in_domains(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one; any host where there are none."""
    if not domains:
        return F.lit(True)
    own, out = host(url), F.lit(False)
    for d in domains:
        out = out | (own == d.lower()) | own.endswith("." + d.lower())
    return out


def allowed(url: Column, domains: list[str], include: list[str] = (), exclude: list[str] = tuple(EXCLUDED)) -> Column:
    """Scheme, domain and patterns (searched without case) let the address through."""
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit(""))).isin(SCHEMES)
    match = lambda patterns: url.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    wanted = match(include) if include else F.lit(True)
    return F.coalesce(scheme & in_domains(url, list(domains)) & wanted & (~match(exclude) if exclude else F.lit(True)), F.lit(False))


def robots_allow(rules: str | None, agent: str, url: str) -> bool:
    """What a host's robots file says; a file that couldn't be fetched (null) disallows."""
    parser = robotparser.RobotFileParser()
    if rules is not None:
        parser.parse(rules.splitlines())
    try:
        return parser.can_fetch(agent, url)
    except Exception:
        return True


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def find(self, *tags: str) -> Iterator[_Node]:
        """Nodes below with one of the tags, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, _Node):
                if x.tag in tags:
                    yield x
                stack.extend(reversed(x.children))

    def text(self, separator: str = " ") -> str:
        """Stripped pieces of visible text."""
        out, stack = [], list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            elif x.tag not in _SILENT:
                stack.extend(reversed(x.children))
        return separator.join(out)


class _Tree(HTMLParser):
    """A tree that mends what is usually left open: paragraphs, list items, cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, {"td", "th", "li", "div", "article", "section"} - {tag})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            return
        self._close({tag}, set())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> _Node:
    tree = _Tree()
    try:
        tree.feed(html)
        tree.close()
    except Exception:  # a page cut within a declaration keeps what was read
        pass
    return tree.root


def html_text(html: str) -> str:
    return parse(html).text()


def _text(value: object) -> str | None:
    return (str(value).strip() or None) if value is not None else None


def linked_data(root: _Node) -> list[dict]:
    """The records of all JSON-LD scripts in document order, those of a graph in its place; malformed scripts are skipped."""
    waiting: list[object] = []
    for script in root.find("script"):
        if script.attrs.get("type") == "application/ld+json":
            try:
                waiting.append(json.loads("".join(x for x in script.children if isinstance(x, str)).strip() or "null"))
            except json.JSONDecodeError:
                continue
    out, waiting = [], waiting[::-1]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict) and "@graph" in node:
            waiting.append(node["@graph"])
        elif isinstance(node, dict):
            out.append(node)
        elif isinstance(node, list):
            waiting += node[::-1]
    return out


def _reach(record: object, path: str) -> str | None:
    """The text at a path of keys; a list of texts is joined by commas."""
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return _text(",".join(map(str, record)) if path == "@type" and isinstance(record, list) else record)


def linked_fields(records: list[dict]) -> dict[str, object]:
    """Of each field of LINKED the first value over the records; all their keywords, sorted."""
    found = {field: next((v for r in records for p in paths if (v := _reach(r, p))), None) for field, paths in LINKED.items()}
    keywords = ",".join(r["keywords"] for r in records if isinstance(r.get("keywords"), str))
    return found | {"tags": sorted({word.strip() for word in keywords.split(",")} - {""})}


def page_fields(html: str) -> dict[str, object]:
    """What a page says of itself: title, summary, content, images, language and its linked data."""
    root = parse(html)
    meta: dict[str, str] = {}
    for m in root.find("meta"):
        for k in (m.attrs.get("property"), m.attrs.get("name")):
            if k:
                meta.setdefault(k, m.attrs.get("content", ""))
    title = next(root.find("title"), None)
    article = next(root.find("article"), None)
    blocks = [n.text() for n in article.find("p", "li")] if article else []
    blocks = blocks or [n.text() for n in root.find("p")]
    text = "\n".join(b for b in blocks if b)
    images = list(dict.fromkeys(i.attrs["src"].strip() for i in root.find("img") if i.attrs.get("src", "").strip()))[:10]
    page = next(root.find("html"), None)
    linked = linked_fields(linked_data(root))
    name = _text(meta.get("og:title")) or (_text("".join(x.strip() for x in title.children if isinstance(x, str))) if title else None)
    return {
        "title": name,
        "summary": _text(meta.get("description")) or _text(meta.get("og:description")),
        "content_text": text,
        "word_count": len(text.split()),
        "language": _text(page.attrs.get("lang")) if page else None,
        "images": images,
        **linked,
        "content_type": linked["content_type"] or "web_page",
        "entity_name": linked["entity_name"] or name,
    }


_PAGE = "title string, summary string, content_text string, word_count int, language string, images array<string>, entity_name string, review_author string, review_date string, rating string, location string, content_type string, tags array<string>"


def documents(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, fields of the page): one document for each page; null pages give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{key: k} | page_fields(h) for k, h in zip(rows[key], rows[html])], columns=[key, *[c.split()[0] for c in _PAGE.split(", ")]])

    return pages.select(key, html).where(F.col(html).isNotNull()).mapInPandas(run, f"{key} string, {_PAGE}")


def links(pages: DataFrame, domains: list[str], include: list[str] = (), exclude: list[str] = tuple(EXCLUDED), url: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """(url, link): the distinct allowed links of each page, relative to ``base`` (by default its address)."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\s[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"), F.lit(0))
    raw = pages.select(url, F.col(base or url).alias("_base"), F.explode(F.array_distinct(hrefs)).alias("tag"))
    href = F.regexp_replace(F.regexp_replace("tag", r"(?is)^.*?\bhref\s*=\s*", ""), "^[\"']|[\"']$", "")
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    found = raw.select(url, normalised_url(F.col("_base"), href).alias("link")).where(F.col("link").isNotNull()).distinct()
    return found.where(allowed(F.col("link"), list(domains), include, exclude))


def raw_file_name(url: Column) -> Column:
    return F.concat(F.regexp_replace(host(url), r"[^A-Za-z0-9_-]", "_"), F.lit("_"), doc_id(url), F.lit(".html"))


