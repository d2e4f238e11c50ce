"""Stylesheets: rules, selector matches, the cascade, inheritance and design tokens.

Parsing css and matching selectors need Python (one pass a page, in Arrow batches); which declaration wins, what is
inherited and how tokens rank is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import colors
from loomspan.operators.nodes import NON_VISUAL, Element, find, parse, portions, rows

# Properties that flow to descendants, and those that are dropped.
INHERITED = ("color", "font-family", "font-size", "font-weight", "line-height", "text-align", "visibility", "cursor", "white-space", "word-break")
DENIED = (
    "behavior", "-moz-binding", "will-change", "pointer-events", "user-select", "-webkit-user-select", "-webkit-tap-highlight-color", "-webkit-touch-callout", "touch-action", "scroll-behavior", "content",
)
SPACING = tuple(f"{kind}{side}" for kind in ("margin", "padding") for side in ("", "-top", "-right", "-bottom", "-left")) + ("gap",)

RULES = "page_id long, rule_no int, kind string, media string, selector string, decl_ord int, prop string, value string"
_VERBATIM = ("font-face", "keyframes", "-webkit-keyframes", "-moz-keyframes")


def _pieces(css: str) -> Iterator[tuple[str, str | None]]:
    """(prelude, body) of each rule at one level; body is None for statements that end with a semicolon."""
    i, start, depth, body = 0, 0, 0, 0
    while i < len(css):
        c = css[i]
        if c in "\"'":
            end = css.find(c, i + 1)
            i = len(css) if end < 0 else end
        elif c == "{":
            depth += 1
            if depth == 1:
                body = i + 1
        elif c == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                yield css[start : body - 1].strip(), css[body:i]
                start = i + 1
        elif c == ";" and depth == 0:
            yield css[start:i].strip(), None
            start = i + 1
        i += 1


def declarations(body: str) -> list[tuple[str, str]]:
    """(property, value) of each declaration; semicolons within brackets or quotes end none."""
    out = []
    for part in re.findall(r"(?:[^;\"'(]|\"[^\"]*\"|'[^']*'|\([^)]*\)|\()+", body):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
        if colon and re.fullmatch(r"-{0,2}[a-z_][\w-]*", name) and value:
            out.append((name, value))
    return out


def rules_of(css: str) -> list[tuple]:
    """(rule_no, kind, media, selector, decl_ord, prop, value); kind: style, media or global (at-rules as they stand)."""
    css = re.sub(r"/\*.*?(?:\*/|$)", "", css, flags=re.S)
    out, number = [], 0

    def add(kind: str, media: str | None, prelude: str, body: str) -> None:
        nonlocal number
        number += 1
        found = [(p, v) for p, v in declarations(body) if p.startswith("--") or p not in DENIED]
        for selector in (s.strip() for s in prelude.split(",")):
            out.extend((number, kind, media, selector, i, p, v) for i, (p, v) in enumerate(found) if selector)

    for prelude, body in _pieces(css):
        if body is None:
            continue
        at = re.match(r"@([\w-]+)\s*(.*)$", prelude, re.S)
        if not at:
            add("style", None, prelude, body)
        elif at[1].lower() == "media":
            for inner, inner_body in _pieces(body):
                if inner_body is not None and not inner.startswith("@"):
                    add("media", "@media " + at[2].strip(), inner, inner_body)
        elif at[1].lower() in _VERBATIM:
            number += 1
            out.append((number, "global", None, prelude, 0, at[1].lower(), f"{prelude}{{{body}}}"))
    return out


def parse_css(sheets: DataFrame) -> DataFrame:
    """Rules of sheets(page_id, css), a row a declaration."""

    def run(batches):
        for pdf in batches:
            found = [(page, *r) for page, css in zip(pdf["page_id"], pdf["css"]) for r in rules_of(css or "")]
            yield pd.DataFrame(found, columns=[c.strip().split(" ")[0] for c in RULES.split(",")])

    return sheets.select("page_id", "css").mapInPandas(run, RULES)


_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\s*\]|:(first-child|last-child|nth-child\(\s*(\d+|odd|even)\s*\)|root)")


class _Place:
    """An element with what selectors ask about it."""

    __slots__ = ("tag", "attrs", "classes", "parent", "before", "index", "last", "node_id")

    def __init__(self, element: Element, parent: _Place | None, before: _Place | None, index: int, last: bool):
        self.tag, self.attrs, self.parent, self.before, self.index, self.last, self.node_id = element.tag, dict(element.attrs), parent, before, index, last, None
        self.classes = self.attrs.get("class", "").split()


@lru_cache(maxsize=4096)
def _tests(compound: str) -> tuple[tuple, ...] | None:
    """What a compound asks for: (tag, id, class, attribute, operator, value, pseudo, nth) of each part; None if it can't be
    read."""
    at, out = 0, []
    for m in _COMPOUND.finditer(compound):
        if m.start() != at:
            return None
        at = m.end()
        tag, id_, cls, attr, op, *values = m.groups()[:8]
        out.append((tag, id_, cls, attr, op, next((v for v in values if v is not None), None), m[9], m[10]))
    return tuple(out) if at == len(compound) else None


_COMPARE = {
    None: lambda have, value: True, "=": lambda have, value: have == value, "~=": lambda have, value: value in have.split(), "^=": lambda have, value: have.startswith(value), "$=": lambda have, value: have.endswith(value),
    "*=": lambda have, value: value in have, "|=": lambda have, value: have == value or have.startswith(value + "-"),
}


def _fits(place: _Place, compound: str) -> bool:
    tests = _tests(compound)
    if tests is None:
        return False
    for tag, id_, cls, attr, op, value, pseudo, nth in tests:
        if tag and tag not in ("*", place.tag) or id_ and place.attrs.get("id") != id_ or cls and cls not in place.classes:
            return False
        if attr and (attr not in place.attrs or not _COMPARE[op](place.attrs[attr], value)):
            return False
        if pseudo:
            wanted = {"first-child": place.index == 1, "last-child": place.last, "root": place.tag == "html"}.get(pseudo)
            if wanted is None:
                wanted = place.index % 2 == (nth == "odd") if nth in ("odd", "even") else place.index == int(nth)
            if not wanted:
                return False
    return True


def _key(compound: str) -> str | None:
    """What an element must have to fit a compound: an id, else a class, else a tag, else nothing (""); None if nothing
    fits it."""
    tests = _tests(compound)
    if tests is None:
        return None
    ids, classes, tags = ([mark + t[i] for t in tests if t[i] and t[i] != "*"] for mark, i in (("#", 1), (".", 2), ("", 0)))
    return next(iter(ids + classes + tags), "")


def _keys(place: _Place) -> list[str]:
    """The keys under which rules are found that may fit an element."""
    own = place.attrs.get("id")
    return [*(["#" + own] if own else []), *("." + c for c in dict.fromkeys(place.classes)), place.tag, ""]


def selector_fits(place: _Place, steps: list[str]) -> bool:
    """steps: compounds and combinators in turn, the last compound being the element's own."""
    if not _fits(place, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    combinator, rest = steps[-2], steps[:-2]
    if combinator in (">", "+"):
        other = place.parent if combinator == ">" else place.before
        return other is not None and selector_fits(other, rest)
    other = place.parent if combinator == " " else place.before
    while other is not None:
        if selector_fits(other, rest):
            return True
        other = other.parent if combinator == " " else other.before
    return False


def split_selector(selector: str) -> list[str]:
    parts = re.split(r"\s*([>+~])\s*|\s+", selector.strip())
    return [(p or " ") for p in parts] if "" not in parts else []


def _places(page: str) -> list[_Place]:
    """Elements of a page in pre-order; those of the visible tree carry the node_id of the nodes table."""
    document = parse(page)
    root = find(document, "body") or find(document, "html") or document
    out: list[_Place] = []
    todo: list = [(document, None, None, 1, True, False)]
    n = -1
    while todo:
        e, parent, before, index, last, visible = todo.pop()
        if e.tag == "#text":
            n += bool(visible and e.text.strip())
            continue
        place = _Place(e, parent, before, index, last) if e is not document else None
        visible = (visible or e is root) and e.tag not in NON_VISUAL
        if visible:
            n += 1
        if place:
            place.node_id = n if visible else None
            out.append(place)
        elements = [c for c in e.children if c.tag != "#text"]
        order = {id(c): i for i, c in enumerate(elements, 1)}
        todo += [(c, place, None, order.get(id(c), 0), order.get(id(c)) == len(elements), visible) for c in reversed(e.children)]
    # The sibling before each element.
    last_child: dict[int, _Place] = {}
    for p in out:
        p.before = last_child.get(id(p.parent))
        last_child[id(p.parent)] = p
    return out


_STATES = (":hover", ":focus", ":active")
_SKIPPED = ("::before", "::after", ":visited", ":focus-within")
MATCHES = "page_id long, node_id int, kind string, media string, state string, inline int, selector string, rule_no int, decl_ord int, prop string, value string"


def match(pages: DataFrame) -> DataFrame:
    """Declarations of pages(page_id, html, css) with the nodes they fall on, before the cascade."""

    def matches(page_id, html, css):
        places = _places(html or "")
        sheet = "\n".join([css or "", *re.findall(r"(?is)<style[^>]*>(.*?)</style>", html or "")])
        by_rule: dict[tuple, list] = {}
        for number, kind, media, selector, i, p, v in rules_of(sheet):
            if kind != "global":
                by_rule.setdefault((number, kind, media, selector), []).append((i, p, v))
        # Rules by the key of their last compound: an element meets those of its own id, classes and tag alone.
        index: dict[str, list] = {}
        for (number, kind, media, selector), found in by_rule.items():
            if any(x in selector for x in _SKIPPED) or kind == "media" and "::" in selector:
                continue
            state = next((s for s in _STATES if s in selector), None)
            steps = split_selector(re.sub(r"::?[\w-]+(?:\([^)]*\))?", "", selector) if state else selector)
            if steps and (key := _key(steps[-1])) is not None:
                index.setdefault(key, []).append((number, kind, media, state, selector, steps, found))
        for place in places:
            if place.node_id is not None:
                for number, kind, media, state, selector, steps, found in (rule for key in _keys(place) for rule in index.get(key, ())):
                    if selector_fits(place, steps):
                        yield from ((page_id, place.node_id, kind, media, state, 0, selector, number, i, p, v) for i, p, v in found)
        for place in places:
            if place.node_id is not None and place.attrs.get("style"):
                yield from ((page_id, place.node_id, "style", None, None, 1, "", 0, i, p, v) for i, (p, v) in enumerate(declarations(place.attrs["style"])) if p.startswith("--") or p not in DENIED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(c.strip().split(" ") for c in MATCHES.split(",")))
        kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t] for t in types]
        for batch in batches:
            for part in portions(batch):
                found = [r for x in zip(*(c.to_pylist() for c in part.columns)) for r in matches(*x)]
                columns = list(zip(*found)) if found else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pages.select("page_id", "html", "css").mapInArrow(run, MATCHES)


def cascade(matched: DataFrame) -> DataFrame:
    """(page_id, node_id, prop, value): the winner of each property. Inline beats ids, classes, tags and order."""
    s = colors.specificity(F.col("selector"))
    rank = F.struct("inline", s["ids"].alias("ids"), s["classes"].alias("classes"), s["tags"].alias("tags"), "rule_no", "decl_ord")
    own = matched.where("kind = 'style' and state is null")
    return own.groupBy("page_id", "node_id", "prop").agg(F.max_by("value", rank).alias("value"))


def states(matched: DataFrame) -> DataFrame:
    """(page_id, node_id, state, prop, value) of :hover, :focus and :active rules; the last rule wins."""
    return matched.where("state is not null").groupBy("page_id", "node_id", "state", "prop").agg(F.max_by("value", F.struct("rule_no", "decl_ord")).alias("value"))


def responsive(matched: DataFrame) -> DataFrame:
    """(page_id, node_id, media, prop, value) of media rules; the last rule wins."""
    return matched.where("kind = 'media'").groupBy("page_id", "node_id", "media", "prop").agg(F.max_by("value", F.struct("rule_no", "decl_ord")).alias("value"))


def resolve_var(value: str, scope: dict[str, str]) -> str:
    """var(--name, fallback) replaced from the scope, five times at most."""
    for _ in range(5):
        if "var(" not in value:
            break
        value = re.sub(r"var\(([^)]+)\)", lambda m: scope.get(m[1].split(",")[0].strip(), (m[1].split(",") + [""])[1].strip()), value)
    return value


def _flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of nodes in pre-order, each followed by its declarations (page_id, node_id, subtree_end or null, prop, value) ->
    (page_id, node_id, prop, value, own).

    One pass with a stack of the open elements; what is in hand is the declarations along one path. A page need not be in
    one batch."""
    names = ["page_id", "node_id", "prop", "value", "own"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    page, node, own = None, None, {}
    open_: list[tuple[int, list[str]]] = []  # where an element's subtree ends, and what flows from it
    flowing: dict[str, list[tuple[str, int]]] = {}  # of what flows, values and their elements, the nearest last
    variables: dict[str, list[tuple[str, int]]] = {}
    out: list[tuple] = []

    def settle() -> None:
        """The declarations of the element at hand take effect, and its values are known."""
        for p, v in own.items():
            if p.startswith("--"):
                variables.setdefault(p, []).append((v, node))
                open_[-1][1].append(p)
        scope = {p: values[-1][0] for p, values in variables.items() if values} if any("var(" in v for v in own.values()) else {}
        for p, v in own.items():
            if not p.startswith("--"):
                value = resolve_var(v, scope)
                if p in INHERITED:
                    flowing.setdefault(p, []).append((value, node))
                    open_[-1][1].append(p)
                elif value:
                    out.append((page, node, p, value, True))
        out.extend((page, node, p, values[-1][0], values[-1][1] == node) for p, values in flowing.items() if values and values[-1][0])

    def close(until: int | None) -> None:
        """End the elements that end before a node, or all."""
        while open_ and (until is None or open_[-1][0] < until):
            for p in open_.pop()[1]:
                (variables if p.startswith("--") else flowing)[p].pop()

    for batch in batches:
        for at, n, end, p, v in zip(*(c.to_pylist() for c in batch.columns)):
            if end is None:
                own[p] = v
                continue
            if node is not None:
                settle()
            if at != page:
                close(None)
                page = at
            close(n)
            open_.append((end, []))
            node, own = n, {}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
    if node is not None:
        settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def inherit(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """(page_id, node_id, prop, value, own): own declarations of styles(page_id, node_id, prop, value) and, for what flows,
    the nearest ancestor's; var() resolved in the scope of the declaring element. Elements and declarations are dealt by
    page once and read in order."""
    none = F.lit(None).cast("string")
    x = nodes.where("tag <> '#text'").select("page_id", "node_id", "subtree_end", none.alias("prop"), none.alias("value"))
    x = x.unionByName(styles.select("page_id", "node_id", F.lit(None).cast("int").alias("subtree_end"), "prop", "value"))
    ordered = x.repartition("page_id").sortWithinPartitions("page_id", "node_id", F.asc_nulls_last("subtree_end"), "prop")
    return ordered.mapInArrow(_flow, "page_id long, node_id int, prop string, value string, own boolean")


def ranked(values: DataFrame, of: list[str]) -> DataFrame:
    """values(..., value, ord) by frequency, first seen first among equals."""
    counts = values.groupBy(*of, "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("n"), "first")))


def tokens(rules: DataFrame) -> DataFrame:
    """(page_id, category, key, value): colours, fonts, sizes and spacing of each page's declarations."""
    x = rules.where("kind <> 'global'").dropDuplicates(["page_id", "rule_no", "decl_ord"]).select("page_id", "prop", "value", (F.col("rule_no") * 10_000 + F.col("decl_ord")).alias("ord"))
    colour = x.where(F.col("prop").isin("color", "border-color", "background-color", "background")).withColumn("value", colors.normalize(F.col("value"))).where("value is not null")
    front, back = colour.where(F.col("prop").isin("color", "border-color")), colour.where(F.col("prop").isin("background-color", "background"))
    fg, bg = ranked(front, ["page_id"]), ranked(back, ["page_id"])
    names = F.element_at(F.array(F.lit("primary"), F.lit("secondary"), F.lit("accent")), F.col("rank"))
    named = fg.where("rank <= 3").select("page_id", names.alias("key"), "value").unionByName(bg.where("rank = 1").select("page_id", F.lit("background").alias("key"), "value"))
    rest = fg.select("page_id", "value", F.lit(0).alias("side"), "rank").unionByName(bg.select("page_id", "value", F.lit(1).alias("side"), "rank"))
    rest = rest.groupBy("page_id", "value").agg(F.min(F.struct("side", "rank")).alias("at")).join(named.select("page_id", "value"), ["page_id", "value"], "left_anti")
    rest = rest.select("page_id", F.concat(F.lit("color-"), F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("string")).alias("key"), "value")
    family = ranked(x.where("prop = 'font-family'").withColumn("value", F.regexp_replace("value", "^[\"' ]+|[\"' ]+$", "")), ["page_id"])
    font = F.when(F.col("rank") == 1, "base").when(F.col("rank") == 2, "heading").otherwise(F.concat(F.lit("font-"), (F.col("rank") - 2).cast("string")))

    def scale(df: DataFrame, names: tuple[str, ...], rest_name: str) -> DataFrame:
        px = df.select("page_id", F.round(colors.to_px(F.col("value")), 2).alias("px")).where("px is not null").distinct()
        px = px.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("px")))
        key = F.when(F.col("rank") <= len(names), F.try_element_at(F.array(*map(F.lit, names or ("",))), F.col("rank"))).otherwise(F.concat(F.lit(rest_name), (F.col("rank") - len(names)).cast("string")))
        return px.select("page_id", key.alias("key"), F.concat(F.regexp_replace(F.col("px").cast("string"), r"\.0$", ""), F.lit("px")).alias("value"))

    sizes = scale(x.where("prop = 'font-size'"), (), "size-")
    steps = x.where(F.col("prop").isin(*SPACING)).withColumn("value", F.explode(F.split("value", r"\s+"))).where(colors.to_px(F.col("value")) > 0)
    spacing = scale(steps, ("xs", "sm", "md", "lg", "xl"), "space-")
    found = [("colors", named.unionByName(rest)), ("typography", family.select("page_id", font.alias("key"), "value").unionByName(sizes)), ("spacing", spacing)]
    out = None
    # Tokens of a page that has none of a category.
    defaults = {"colors": (("primary", "#000000"), ("background", "#ffffff")), "typography": (("base", "Arial, sans-serif"),), "spacing": (("sm", "8px"), ("md", "16px"))}
    pages = rules.select("page_id").distinct()
    for category, df in found:
        fallback = F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in defaults[category])))
        df = df.unionByName(pages.join(df.select("page_id").distinct(), "page_id", "left_anti").select("page_id", fallback))
        df = df.select("page_id", F.lit(category).alias("category"), "key", "value")
        out = df if out is None else out.unionByName(df)
    return out


def own_declarations(styles: DataFrame) -> DataFrame:
    """(page_id, node_id, style): the safe declarations of styles(page_id, node_id, prop, value, ord) as one text."""
    safe = _safe_values(styles)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "prop", "value"))), lambda d: F.concat(d["prop"], F.lit(": "), d["value"]))
    return safe.groupBy("page_id", "node_id").agg(F.array_join(listed, "; ").alias("style"))


def _safe_values(styles: DataFrame) -> DataFrame:
    from loomspan.operators.markup import safe_style

    clean = F.pandas_udf(lambda s: pd.Series([safe_style(x or "") for x in s]), "string")
    return styles.withColumn("value", clean("value")).where("value <> ''")


def localized(rule: Column) -> Column:
    """A global rule whose bare file names in url() are looked for in assets/; other references stay."""
    return F.regexp_replace(rule, r"""url\(\s*(["']?)\s*([^"'()/:#\s][^"'()/:]*?)\s*["']?\s*\)""", "url($1assets/$2$1)")


def generated_styles(media: DataFrame, states: DataFrame, rules: DataFrame, prefix: str = "gen-r") -> tuple[DataFrame, DataFrame]:
    """Classes for what an inline style can't say: (page_id, node_id, class) and each page's sheet (page_id, css).

    media(page_id, node_id, media, prop, value, ord) and states(page_id, node_id, state, prop, value, ord) are styles of
    nodes, rules(page_id, ord, rule) global at-rules. Nodes with any get a class, numbered in page order. The sheet has
    the global rules, then the states, then a block for each media query, in order of its first node."""
    of = ["page_id", "node_id"]
    media, states = _safe_values(media), _safe_values(states)
    nodes = media.select(*of).unionByName(states.select(*of)).distinct()
    classes = nodes.withColumn("class", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).cast("string")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "prop", "value"))), lambda d: F.concat(d["prop"], F.lit(": "), d["value"])), "; ")
    said = lambda df, key: df.groupBy(*of, key).agg(listed.alias("body")).join(classes, of)
    joined = lambda order, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda p: p["piece"]), sep)
    bad = F.lower("rule").rlike(r"javascript:|expression\(|</|<script")
    first = rules.where(~bad).select("page_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("at"), localized(F.trim("rule")).alias("piece"))
    second = said(states, "state").select("page_id", F.lit(1).alias("part"), F.col("node_id").cast("long").alias("at"), F.concat(F.lit("."), "class", "state", F.lit(" { "), "body", F.lit(" }")).alias("piece"))
    lines = said(media, "media").select("page_id", "media", "node_id", F.concat(F.lit("  ."), "class", F.lit(" { "), "body", F.lit(" }")).alias("piece"))
    blocks = lines.groupBy("page_id", "media").agg(F.min("node_id").alias("at"), joined(["node_id"], "\n").alias("lines"))
    third = blocks.select("page_id", F.lit(2).alias("part"), F.col("at").cast("long").alias("at"), F.concat("media", F.lit(" {\n"), "lines", F.lit("\n}")).alias("piece"))
    sheets = first.unionByName(second).unionByName(third).groupBy("page_id").agg(joined(["part", "at"], "\n").alias("css"))
    return classes, sheets
