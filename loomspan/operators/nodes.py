"""HTML to the interval-encoded nodes table: one row a node, in pre-order.

A descendant d of a has the same page and a.node_id < d.node_id <= a.subtree_end, so that no query recurses. Parsing
is the one step that needs Python; it runs in Arrow batches over (page_id, html) and everything after it is relational.
Unclosed blocks are closed as browsers do (implied_end_tags) or nest (False, for structural comparison).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that are not part of the visible tree, and elements without an end tag.
NON_VISUAL = frozenset("script style meta noscript link title head iframe object embed applet".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("table td th ul ol dl body html button object".split())
_URI_ATTRIBUTES = ("href", "src", "action", "formaction")
_SCHEME = re.compile(r"\s*([a-zA-Z][a-zA-Z0-9+.-]*):")
_SAFE = ("http", "https", "mailto", "tel")

SCHEMA = (
    "page_id long, node_id int, parent_id int, depth int, subtree_end int, child_idx int, type_idx int, top_idx int, tag string, path string, css_path string, "
    "attrs array<struct<k:string,v:string>>, text_content string"
)


class Element:
    __slots__ = ("tag", "attrs", "children", "text")

    def __init__(self, tag: str, attrs: list[tuple[str, str]] = (), text: str | None = None):
        self.tag, self.attrs, self.children, self.text = tag, list(attrs), [], text


class _Builder(HTMLParser):
    def __init__(self, implied_end_tags: bool):
        super().__init__(convert_charrefs=True)
        self.implied, self.root = implied_end_tags, Element("[document]")
        self.open = [self.root]

    def _close(self, tags: set[str]) -> None:
        """End the nearest open element of these tags, unless another scope begins after it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in _SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if self.implied:
            if tag in _CLOSES_P:
                self._close({"p"})
            if tag in _CLOSES_SAME:
                self._close(_CLOSES_SAME[tag])
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        element = Element(tag, seen.items())
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(Element("#text", text=data))


def parse(page: str, implied_end_tags: bool = True) -> Element:
    builder = _Builder(implied_end_tags)
    builder.feed(page or "")
    builder.close()
    return builder.root


def find(element: Element, tag: str) -> Element | None:
    todo = [element]
    while todo:
        e = todo.pop()
        if e.tag == tag:
            return e
        todo += reversed(e.children)
    return None


def _kept(element: Element) -> list[Element]:
    return [c for c in element.children if (c.tag == "#text" and c.text.strip()) or (c.tag != "#text" and c.tag not in NON_VISUAL)]


def _safe_attrs(attrs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    def fine(k: str, v: str) -> bool:
        scheme = _SCHEME.match(v)
        return not k.startswith("on") and (k not in _URI_ATTRIBUTES or scheme is None or scheme[1].lower() in _SAFE)

    return [(k, " ".join(v.split()) if k == "class" else v) for k, v in attrs if fine(k.lower(), v)]


def rows(page_id: int, page: str, implied_end_tags: bool = True) -> list[list]:
    """The rows of a page's visible tree, without recursion."""
    document = parse(page, implied_end_tags)
    root = find(document, "body") or find(document, "html") or document
    out: list[list] = []
    # (element, parent, depth, child_idx, type_idx, top_idx, path, css_path) or the id of a node whose subtree ends here
    todo: list = [(root, None, 0, 1, 1, 0, "root", "body:nth-of-type(1)" if root.tag == "body" else "")]
    while todo:
        item = todo.pop()
        if isinstance(item, int):
            out[item][4] = len(out) - 1
            continue
        e, parent, depth, child_idx, type_idx, top_idx, path, css_path = item
        attrs = [] if e.tag == "#text" else _safe_attrs(e.attrs)
        own_id = dict(e.attrs).get("id") if e.tag != "#text" else None
        css_path = f"#{own_id}" if own_id else css_path
        node_id = len(out)
        tag = "div" if e.tag == "[document]" else e.tag
        out.append([page_id, node_id, parent, depth, node_id, child_idx, type_idx, top_idx, tag, path, css_path, attrs, e.text.strip() if e.tag == "#text" else None])
        todo.append(node_id)
        seen: dict[str, int] = {}
        inner = []
        for i, c in enumerate(_kept(e), 1):
            seen[c.tag] = seen.get(c.tag, 0) + 1
            step = f"{c.tag}:nth-of-type({seen[c.tag]})"
            # A path restarts at the nearest id only for the element itself; below it the chain goes on from the body.
            base = css_path if not css_path.startswith("#") else item[7]
            inner.append((c, node_id, depth + 1, i, seen[c.tag], i if depth == 0 else top_idx, f"{path} > {c.tag}:nth-child({i})", f"{base} > {step}" if base else step))
        todo += reversed(inner)
    return out


def portions(batch: pa.RecordBatch, most: int = 64, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of pages(page_id, html, ...), of so many rows and some so many bytes of markup at most, in order:
    what is parsed at a time, and what leaves at a time, doesn't grow with the batch."""
    at, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and (i - at >= most or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


def parse_html(pages: DataFrame, implied_end_tags: bool = True) -> DataFrame:
    """nodes of pages(page_id, html); a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int32()] * 7, *[pa.string()] * 3, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])), pa.string()]
        names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", SCHEMA)]
        for batch in batches:
            for part in portions(batch):
                found = [r for page_id, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows(page_id, page or "", implied_end_tags)]
                columns = list(zip(*found)) if found else [[]] * len(kinds)
                columns[11] = [[{"k": k, "v": v} for k, v in a] for a in columns[11]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)


def attribute(name: str) -> F.Column:
    """The value of an attribute of a node, or null."""
    return F.get(F.filter("attrs", lambda a: a["k"] == name), F.lit(0))["v"]


def located(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """The nodes at removed(page_id, path), with no other attribute than their id. Where removed has been located already,
    so that it has their columns, it is taken as it is: a path is long, and nodes dealt by it are shuffled with it."""
    if "subtree_end" in removed.columns:
        return removed
    return only_id(nodes).join(removed.select("page_id", "path"), ["page_id", "path"])


def only_id(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("attrs", F.filter("attrs", lambda a: a["k"] == "id"))
