"""Sections and links out of web pages, by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: a section number; ids and classes of section containers; containers of a chapter's content.
NUMBER = re.compile(r"\b(\d{3,4}\.\d+(?:\.\d+)*)\b")
SECTION_ID, SECTION_CLASS = re.compile(r"^sec_\d+"), re.compile(r"section|code-section|content-section")
CONTENT = ({"class": "content-section"}, {"class": "code-content"}, {"class": "chapter-content"}, {"id": "content-body"}, {"tag": "article"}, {"tag": "main"}, {"class": "v-main__wrap"})
LEAST_CONTAINER = 500
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = ("h1", "h2", "h3", "h4")


class Node:
    """An element; its children are elements and strings."""

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self):
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            else:
                todo += reversed(c.children)

    def text(self) -> str:
        """All strings, stripped, with nothing between them."""
        return "".join(s.strip() for s in self.strings())

    def following(self):
        """The elements after this one under the same parent."""
        all_ = self.parent.children if self.parent else []
        return [c for c in all_[next((i for i, c in enumerate(all_) if c is self), len(all_)) + 1 :] if isinstance(c, Node)]

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def html_length(self) -> int:
        return sum(map(len, self.strings())) + sum(2 * len(n.tag) + 5 for n in self.walk())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def content_of(root: Node) -> Node:
    """The longest of the known containers if it is long enough, else the whole page."""
    fits = lambda n, want: all(n.tag == v if k == "tag" else v in n.classes() if k == "class" else n.attrs.get("id") == v for k, v in want.items())
    firsts = [next((n for n in root.walk() if fits(n, want)), None) for want in CONTENT]
    best = max((n for n in firsts if n), key=Node.html_length, default=None)
    return best if best and best.html_length() > LEAST_CONTAINER else root


def table_text(table: Node) -> str:
    rows = [" | ".join(c.text() for c in r.walk() if c.tag in ("td", "th")) for r in table.walk() if r.tag == "tr" and any(c.tag in ("td", "th") for c in r.walk())]
    return "\n".join(["TABLE:", *rows, "END TABLE"]) if rows else ""


def _title(text: str, number: str) -> str:
    return text.replace(number, "", 1).strip().strip(".")


def _by_id(root: Node):
    for n in root.walk():
        head = next((c for c in n.walk() if c.tag in _HEADINGS[1:]), None) if SECTION_ID.match(n.attrs.get("id") or "") else None
        m = head and NUMBER.search(head.text())
        if not m:
            continue
        own = [c for c in n.children if isinstance(c, str) or c.tag not in ("script", "style") and not SECTION_ID.match(c.attrs.get("id") or "")]
        body = " ".join(filter(None, (c.strip() if isinstance(c, str) else c.text() for c in own)))
        if len(body) < 20:
            continue
        if any(c.tag == "table" for c in n.walk()):
            body = "\n".join(filter(None, (c.strip() if isinstance(c, str) else table_text(c) if c.tag == "table" else c.text() for c in n.children)))
        yield m[1], _title(head.text(), m[1]), body


def _by_class(root: Node):
    for n in root.walk():
        if any(SECTION_CLASS.search(c) for c in n.classes()):
            text = n.text()
            m = NUMBER.search(text[:200])
            if m and len(text) >= 30:
                yield m[1], _title(text.split("\n")[0] if "\n" in text else text[:200], m[1])[:200], text


def _until(n: Node, stop) -> str:
    parts = []
    for c in n.following():
        if stop(c):
            break
        parts.append(c.text())
    return " ".join(filter(None, parts))


def _by_heading(root: Node):
    for n in root.walk():
        m = NUMBER.search(n.text()) if n.tag in _HEADINGS else None
        if m:
            body = _until(n, lambda c, level=int(n.tag[1]): re.fullmatch(r"h\d", c.tag) and int(c.tag[1]) <= level)
            if len(body) >= 30:
                yield m[1], _title(n.text(), m[1]), f"{n.text()}\n{body}"


def _by_bold(root: Node):
    for n in root.walk():
        m = NUMBER.search(n.text()) if n.tag in ("b", "strong") else None
        if m and len(n.text()) < 300:
            body = _until(n, lambda c: c.tag in ("b", "strong", *_HEADINGS) and NUMBER.search(c.text()))
            if len(body) > 30:
                yield m[1], _title(n.text(), m[1]), f"{n.text()}\n{body}"


def _by_paragraph(root: Node):
    for n in root.walk():
        text = n.text() if n.tag in ("p", "div") else ""
        m = re.match(r"(\d{3,4}\.\d+(?:\.\d+)*)\s+(.+)", text) if 50 < len(text) < 5000 else None
        if m:
            yield m[1], re.match(r"(?:[^.]+\.|.{0,100})", m[2])[0].strip(), text


WAYS = (_by_id, _by_class, _by_heading, _by_bold, _by_paragraph)


def sections_of(html: str | None) -> list[tuple[str, str, str]]:
    """(number, title, body) of a page's sections, by the first way that finds any."""
    root = parse(html)
    for way in WAYS:
        if found := list(way(root)):
            return [(n, t or f"Section {n}", b) for n, t, b in found]
    return []


_SECTION = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("number", "title", "body")]))


@F.pandas_udf(_SECTION)
def web_sections(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [dict(zip(("number", "title", "body"), s, strict=True)) for s in sections_of(h)])


@F.pandas_udf(T.StringType())
def web_text(html: pd.Series) -> pd.Series:
    """The text of a page's content container."""
    return html.map(lambda h: content_of(parse(h)).text())


# Classes of entries of a contents list; where side navigation stands; the words that tell chapters.
ENTRY_CLASSES, ENTRY_PARENT = ("chapter-link", "nav-link"), "toc-item"
SIDE = ({"id": "sidebar"}, {"class": "sidebar"}, {"tag": "nav"}, {"class": "navigation"}, {"class": "v-list-item"})
_CHAPTER, _NUMBERED = re.compile(r"chapter\s*\d+", re.IGNORECASE), re.compile(r"^\d+\.")


def _shown(n: Node) -> str:
    """An element's text as it is shown: white space as one space."""
    return " ".join("".join(n.strings()).split())


def links_of(html: str | None) -> list[tuple[str, str]]:
    """(title, href) of a page's chapters, by the first way that finds any: links whose address and text name a chapter; entries of a contents list; links of the side navigation that name a chapter or begin with a number."""
    found: list[list[tuple[str, str]]] = [[], [], []]
    # each element with what its ancestors are: whether one is an entry of a contents list or a side navigation
    todo = [(c, False, False) for c in reversed(parse(html).children) if isinstance(c, Node)]
    while todo:
        n, entry, side = todo.pop()
        classes, href = n.classes(), n.attrs.get("href") or ""
        title = _shown(n) if href else ""
        if title:
            if n.tag == "a" and "chapter" in href and _CHAPTER.search(title):
                found[0].append((title, href))
            if n.tag == "a" and entry or any(c in classes for c in ENTRY_CLASSES):
                found[1].append((title, href))
            if n.tag == "a" and side and ("chapter" in title.lower() or _NUMBERED.match(title)):
                found[2].append((title, href))
        entry = entry or ENTRY_PARENT in classes
        side = side or any(n.tag == v if k == "tag" else v in classes if k == "class" else n.attrs.get("id") == v for want in SIDE for k, v in want.items())
        todo += [(c, entry, side) for c in reversed(n.children) if isinstance(c, Node)]
    return next((x for x in found if x), [])


_LINK = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "href")]))


@F.pandas_udf(_LINK)
def web_links(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{"title": t, "href": u} for t, u in links_of(h)])


def chapter_links(pages: DataFrame, host: str = "https://codes.iccsafe.org") -> DataFrame:
    """(page_id, title, url): the chapters of each page (page_id, html), addresses made whole, each address once, where it first stands."""
    flat = pages.select("page_id", F.posexplode(web_links("html")).alias("at", "l"))
    url = F.when(F.col("l.href").startswith("http"), F.col("l.href")).otherwise(F.concat(F.lit(host), F.col("l.href")))
    return flat.select("page_id", url.alias("url"), "at", F.col("l.title").alias("title")).groupBy("page_id", "url").agg(F.min(F.struct("at", "title"))["title"].alias("title"))


def number_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"\b\d{3,4}\.\d+(?:\.\d+)*\b"))
