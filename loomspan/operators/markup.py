"""Writing and rewriting markup: compiling nodes, structural comparison, sanitizing, removing trackers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.urls import LOCAL_NAMES, PIXEL_PATTERNS, SAFE_SCHEMES, TRACKER_DOMAINS  # noqa: F401
from loomspan.operators.nodes import VOID, Element, attribute, find, parse

# Elements that sanitized markup never has.
UNSAFE = frozenset("script style meta noscript link title head iframe object embed applet".split())
_VERIFICATION = frozenset(("google-site-verification", "facebook-domain-verification", "msvalidate.01", "yandex-verification", "p:domain_verify", "pinterest-site-verification"))
_HINTS = frozenset("preconnect dns-prefetch preload prefetch".split())


def open_tag(tag: str, attrs: list[tuple[str, str]]) -> str:
    return "<" + tag + "".join(f' {k}="{v.replace(chr(38), "&amp;").replace(chr(34), "&quot;")}"' for k, v in attrs) + ">"


def _quoted(a: F.Column) -> F.Column:
    """An attribute as markup has it."""
    return F.concat(F.lit(" "), a["k"], F.lit('="'), F.replace(F.replace(a["v"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))


def _serialised(nodes: DataFrame, by: list[str], attribute_text=_quoted, within: DataFrame | None = None, inner: bool = False) -> DataFrame:
    """(by..., html): the trees of nodes as markup, from their nodes in order.

    Every node yields its opening text; the end tags that fall due after it are those of the nodes whose subtree ends
    there. Both are pieces with a place, and a tree's pieces are joined in order: no function sees a whole table.
    within(by..., at, piece) is put right after the opening text of a node; inner leaves the root itself out."""
    attrs = F.array_join(F.transform("attrs", attribute_text), "")
    opening = F.when(F.col("tag") == "#text", F.col("text_content")).otherwise(F.concat(F.lit("<"), "tag", attrs, F.lit(">")))
    if inner:  # a root without anything in it still has a text, an empty one
        opening = F.when(F.col("parent_id").isNull(), "").otherwise(opening)
    shown = nodes.where("parent_id is not null") if inner else nodes
    starts = nodes.select(*by, F.col("node_id").alias("at"), F.lit(1).alias("phase"), F.lit(0).alias("inner"), opening.alias("piece"))
    ends = shown.where((F.col("tag") != "#text") & ~F.col("tag").isin(*sorted(VOID))).select(*by, F.col("subtree_end").alias("at"), F.lit(2).alias("phase"), (-F.col("node_id")).alias("inner"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("piece"))
    pieces = starts.unionByName(ends)
    if within is not None:
        pieces = pieces.unionByName(within.select(*by, "at", F.lit(1).alias("phase"), F.lit(1).alias("inner"), "piece"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "phase", "inner", "piece")))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("html"))


def _own_and_shadows(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pages' own trees, and (page_id, at, html) of the shadow trees that sections.attach_shadows put below hosts."""
    if "host_id" not in nodes.columns:
        return nodes, None
    inner = _serialised(nodes.where("host_id is not null"), ["page_id", "host_id"], inner=True)
    return nodes.where("host_id is null"), inner.select("page_id", F.col("host_id").alias("at"), "html")


def compile_html(nodes: DataFrame, inner: bool = False) -> DataFrame:
    """(page_id, html): each page's tree as markup, or what is in its root. Shadow trees become declarative shadow roots,
    templates that come first in their hosts."""
    own, shadows = _own_and_shadows(nodes)
    if shadows is not None:
        shadows = shadows.select("page_id", "at", F.concat(F.lit('<template shadowrootmode="open">'), "html", F.lit("</template>")).alias("piece"))
    return _serialised(own, ["page_id"], within=shadows, inner=inner)


def inject(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """nodes with values(page_id, slot_id, value) in their slots: in the place of the first text, or of a picture's address.
    Slots are those that nodes carry (versions.with_slots), else those that they would be given."""
    from loomspan.operators import sections, versions

    carried = versions.slot_ids(nodes)
    numbered = sections.slots(nodes).select("page_id", "path", "slot_id").join(carried.select("page_id").distinct(), "page_id", "left_anti")
    paths = carried.select("page_id", "path", "slot_id").unionByName(numbered)
    return sections.substitute(nodes, values.join(paths, ["page_id", "slot_id"]).select("page_id", "path", "value"))


def compile_document(nodes: DataFrame, pages: DataFrame, media: DataFrame | None = None, states: DataFrame | None = None, rules: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """(page_id, html): standalone documents of pages(page_id, title).

    What inline styles can't say (media, states, rules: see styles.generated_styles) is a sheet in the head, for classes
    that the nodes wear; inline styles that a page has twice or more become classes that come before it. values(page_id,
    slot_id, value) are injected."""
    from loomspan.operators import styles, workflows

    tree = nodes if values is None else inject(nodes, values)
    minted = workflows.minted_classes(tree)
    sheets = minted.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("."), "class", F.lit(" { "), "style", F.lit(" }")))), "\n").alias("css")).select("page_id", F.lit(0).alias("part"), "css")
    worn = tree.select("page_id", "node_id", attribute("style").alias("style")).join(minted, ["page_id", "style"]).select("page_id", "node_id", F.lit(1).alias("part"), "class")
    if media is not None:
        classes, generated = styles.generated_styles(media, states, rules)
        sheets = sheets.unionByName(generated.select("page_id", F.lit(1).alias("part"), "css"))
        worn = worn.unionByName(classes.select("page_id", "node_id", F.lit(0).alias("part"), "class"))
    css = sheets.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "css"))), lambda p: p["css"]), "\n").alias("css"))
    x = compile_html(wear(tree, worn), inner=True).join(pages.select("page_id", "title"), "page_id").join(css, "page_id", "left")
    style = F.when(F.col("css").isNotNull(), F.concat(F.lit("<style>\n"), "css", F.lit("\n</style>\n"))).otherwise("")
    head = F.concat(F.lit('<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'), F.coalesce("title", F.lit("")), F.lit("</title>\n"), style)
    return x.select("page_id", F.concat(F.lit('<!doctype html>\n<html lang="en">\n<head>\n'), head, F.lit("</head>\n<body>\n"), "html", F.lit("\n</body>\n</html>\n")).alias("html"))


def wear(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """nodes that wear classes(page_id, node_id, part, class) besides their own, in order of part. Part 1 stands for the
    inline style, which goes."""
    more = classes.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("part", "class"))).alias("more"))
    x = nodes.join(more, ["page_id", "node_id"], "left")
    names = F.concat_ws(" ", attribute("class"), F.transform("more", lambda m: m["class"]))
    rest = F.filter("attrs", lambda a: (a["k"] != "class") & ~((a["k"] == "style") & F.exists("more", lambda m: m["part"] == 1)))
    return x.withColumn("attrs", F.when(F.col("more").isNull(), F.col("attrs")).otherwise(F.concat(rest, F.array(F.struct(F.lit("class").alias("k"), names.alias("v")))))).select(*nodes.columns)


# Attribute names that a component notation spells otherwise.
JSX_NAMES = {"class": "className", "for": "htmlFor", "tabindex": "tabIndex"}


def camel_case(prop: F.Column) -> F.Column:
    """A style property as a component notation spells it; custom properties keep their name."""
    parts = F.split(prop, "-")
    name = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), ""))
    return F.when(prop.startswith("--"), prop).otherwise(name)


def _harmless(declaration: F.Column) -> F.Column:
    """What safe_style keeps, in the JVM."""
    low = F.lower(declaration)
    fine = lambda u: F.when(u.startswith("data:"), F.exists(F.array(*map(F.lit, _DATA)), lambda d: u.startswith(d)) & ~u.rlike("javascript|html")).otherwise(
        ~u.rlike(r"bad url|about:|invalid|[()\[\]]") & F.regexp_extract(u, "^([a-z][a-z0-9+.-]*):", 1).isin(*SAFE_SCHEMES)
    )
    return ~low.rlike("expression|javascript:|behavior:") & F.forall(F.regexp_extract_all(low, F.lit(r"""url\(\s*['"]?(.*?)['"]?\s*\)"""), F.lit(1)), lambda u: fine(F.trim(u)))


def style_object(style: F.Column) -> F.Column:
    """The text of a style attribute as an object of camel-case names: what React takes instead. Unsafe values go."""
    from loomspan.operators import versions

    text = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kept = F.filter(versions.declared(style), lambda d: (d["value"] != "") & _harmless(F.concat(d["prop"], F.lit(":"), d["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda d: F.concat(text(camel_case(d["prop"])), F.lit(": "), text(d["value"]))), ", "), F.lit("}"))


def compile_jsx(nodes: DataFrame, name: str = "Page") -> DataFrame:
    """(page_id, jsx): a function component for each page. Styles are objects; shadow roots are static templates."""
    spelled = F.create_map(*(F.lit(x) for kv in JSX_NAMES.items() for x in kv))
    attribute_text = lambda a: F.when(a["k"] == "style", F.concat(F.lit(" style={"), style_object(a["v"]), F.lit("}"))).otherwise(
        _quoted(F.struct(F.coalesce(F.try_element_at(spelled, a["k"]), a["k"]).alias("k"), a["v"].alias("v")))
    )
    own, shadows = _own_and_shadows(nodes)
    quoted = F.to_json(F.struct(F.col("text_content").alias("t")))
    own = own.withColumn("text_content", F.when(F.col("tag") == "#text", F.concat(F.lit("{"), F.substr(quoted, F.lit(6), F.length(quoted) - 6), F.lit("}"))))
    if shadows is not None:
        escaped = F.replace(F.replace(F.replace("html", F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`")), F.lit("${"), F.lit("\\${"))
        shadows = shadows.select("page_id", "at", F.concat(F.lit('<template shadowrootmode="open" dangerouslySetInnerHTML={{ __html: `'), escaped, F.lit("` }} />")).alias("piece"))
    closed = F.regexp_replace("html", r"(<(?:" + "|".join(sorted(VOID)) + r")(?: [^>]*)?)>", "$1 />")
    html = _serialised(own, ["page_id"], attribute_text, shadows)
    return html.select("page_id", F.concat(F.lit(f"export default function {name}() {{\n  return (\n    "), closed, F.lit("\n  );\n}\n")).alias("jsx"))


def compile_vue(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(page_id, vue): a single-file component with the page's tokens as variables."""
    variables = tokens.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  --"), "category", F.lit("-"), "key", F.lit(": "), "value", F.lit(";")))), "\n").alias("variables"))
    html = compile_html(nodes).join(variables, "page_id", "left")
    return html.select("page_id", F.concat(F.lit("<template>\n"), "html", F.lit("\n</template>\n\n<script setup>\n</script>\n\n<style scoped>\n:root {\n"), F.coalesce("variables", F.lit("")), F.lit("\n}\n</style>\n")).alias("vue"))


def _signature(e: Element) -> tuple:
    attrs = dict(e.attrs)
    return e.tag, attrs.get("id"), tuple(sorted(attrs.get("class", "").split()))


def _elements(e: Element) -> list[Element]:
    return [c for c in e.children if c.tag != "#text"]


def _mask(places: list[int]) -> int:
    """A number with these bits set."""
    bits = bytearray(places[-1] // 8 + 1)
    for k in places:
        bits[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(bits, "little")


def align(a: list[tuple], b: list[tuple]) -> list[tuple[int | None, int | None]]:
    """Pairs of places of a longest common subsequence; what is in one alone pairs with None. Equal heads always pair; of
    equal choices the first list's element is passed over first.

    With L(i, j) the length of what a[i:] and b[j:] have in common, row i is held as one number: bit k is clear where
    L(i, .) grows from the last k elements of b to the last k + 1, so that L is a count of clear bits and a row follows
    from the next by a few operations on whole numbers. Rows are kept a block apart, and those of one block at a time are
    made again on the way down: some 2 sqrt(n) rows of m bits, not n rows of m lengths."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(start)]
    a, b = a[start:], b[start:]
    n, m = len(a), len(b)
    full = (1 << m) - 1
    places: dict[tuple, list[int]] = {}
    for k, x in enumerate(reversed(b)):
        places.setdefault(x, []).append(k)
    mask = lru_cache(maxsize=64)(lambda x: _mask(places[x]) if x in places else 0)  # noqa: B019

    def above(row: int, x: tuple) -> int:
        """The row of x and what follows it, from the row of what follows."""
        hit = row & mask(x)
        return (row + hit | row - hit) & full

    def common(row: int, j: int) -> int:
        return m - j - (row & ((1 << m - j) - 1)).bit_count()

    block = max(1, isqrt(n))
    kept = {n: full}
    row = full
    for i in reversed(range(n)):
        row = above(row, a[i])
        if i % block == 0:
            kept[i] = row
    i = j = 0
    rows: dict[int, int] = {}
    while i < n or j < m:
        if i < n and j < m and a[i] != b[j] and i + 1 not in rows:
            end = min(n, i - i % block + block)
            rows = {end: kept[end]}
            for k in reversed(range(i, end)):
                rows[k] = above(rows[k + 1], a[k])
        if i < n and j < m and a[i] == b[j]:
            out.append((start + i, start + j))
            i, j = i + 1, j + 1
        elif j == m or i < n and common(rows[i + 1], j) == common(rows[i], j):
            out.append((start + i, None))
            i += 1
        else:
            out.append((None, start + j))
            j += 1
    return out


def structural_counts(original: str, other: str) -> tuple[int, float]:
    """Nodes compared and their summed likeness: 0.6 for the tag, 0.2 each for id and classes; an unmatched subtree is one miss."""
    a, b = (parse(x or "", implied_end_tags=False) for x in (original, other))
    nodes, matches = 0, 0.0
    todo: list = [(find(a, "body") or a, find(b, "body") or b)]
    while todo:
        x, y = todo.pop()
        nodes += 1
        if x is None or y is None:
            continue
        p, q = _signature(x), _signature(y)
        if p[0] == q[0]:
            matches += 0.6 + 0.2 * (p[1] == q[1]) + 0.2 * (set(p[2]) == set(q[2]))
        mine, theirs = _elements(x), _elements(y)
        todo += [(None if i is None else mine[i], None if j is None else theirs[j]) for i, j in align([*map(_signature, mine)], [*map(_signature, theirs)])]
    return nodes, matches


def structural_score(pairs: DataFrame) -> DataFrame:
    """(page_id, nodes, structural_score) of pairs(page_id, original, other)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [structural_counts(a, b) for a, b in zip(pdf["original"], pdf["other"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "nodes": [n for n, _ in found], "matches": [m for _, m in found]})

    counted = pairs.select("page_id", "original", "other").mapInPandas(run, "page_id long, nodes int, matches double")
    return counted.select("page_id", "nodes", F.round(F.col("matches") / F.greatest("nodes", F.lit(1)) * 100, 2).alias("structural_score"))


_DATA = ("data:image/png", "data:image/jpeg", "data:image/jpg", "data:image/gif", "data:image/webp", "data:image/svg+xml", "data:font/", "data:application/font-woff", "data:application/x-font-woff", "data:application/font-sfnt")


def safe_style(style: str) -> str:
    """Declarations without script, behaviour and unsafe url()."""
    kept = []
    for part in (p.strip() for p in (style or "").split(";")):
        low = part.lower()
        if not part or part in (")", "(", "()") or any(x in low for x in ("expression", "javascript:", "behavior:")):
            continue
        urls = [u.strip() for u in re.findall(r"url\(\s*['\"]?(.*?)['\"]?\s*\)", low)]
        if all(_safe_url(u) for u in urls if u):
            kept.append(part)
    return "; ".join(kept)


def _safe_url(url: str) -> bool:
    if url.startswith("data:"):
        return url.startswith(_DATA) and "javascript" not in url and "html" not in url
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", url)
    return not any(x in url for x in ("bad url", "about:", "invalid")) and not set(url) & set("()[]") and (scheme is None or scheme[1] in SAFE_SCHEMES)


def _rewrite(page: str, drop, attrs) -> str:
    """The page with elements left out where drop(element) holds, and attributes by attrs(element)."""
    out: list[str] = []
    todo: list = [parse(page or "", implied_end_tags=False)]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(e)
        elif e.tag == "#text":
            out.append(e.text)
        elif e.tag == "[document]" or not drop(e):
            if e.tag != "[document]":
                out.append(open_tag(e.tag, attrs(e)))
                if e.tag not in VOID:
                    todo.append(f"</{e.tag}>")
            todo += reversed(e.children)
    return "".join(out)


def sanitize(page: str) -> str:
    """Markup without unsafe elements, event handlers, unsafe references and unsafe style declarations."""

    def attrs(e: Element) -> list[tuple[str, str]]:
        kept = []
        for k, v in e.attrs:
            if k.startswith("on") or k in ("href", "src", "action", "formaction") and (m := re.match(r"\s*([a-zA-Z][\w+.-]*):", v)) and m[1].lower() not in SAFE_SCHEMES:
                continue
            v = safe_style(v) if k == "style" else v
            if v or k != "style":
                kept.append((k, v))
        return kept

    return _rewrite(page, lambda e: e.tag in UNSAFE, attrs)


def is_tracker(url: str) -> bool:
    low = url.lower()
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#:]*)", low)
    return any(p in low for p in PIXEL_PATTERNS) or bool(m and any(m[1] == d or m[1].endswith("." + d) for d in TRACKER_DOMAINS))


def strip_trackers(page: str, signatures: str) -> tuple[str, dict[str, int], list[str]]:
    """The page without trackers, how many of each kind went, and their addresses."""
    kinds = {"script": "external_scripts", "img": "pixels", "iframe": "iframes"}
    counts = dict.fromkeys(("external_scripts", "inline_scripts", "pixels", "iframes", "resource_hints", "verification_meta", "ping_attributes"), 0)
    urls: set[str] = set()
    inline = re.compile(signatures)

    def drop(e: Element) -> bool:
        a = dict(e.attrs)
        if e.tag in kinds and is_tracker(a.get("src", "")):
            counts[kinds[e.tag]] += 1
            urls.add(a["src"])
            return True
        if e.tag == "script" and "src" not in a and inline.search("".join(c.text or "" for c in e.children)):
            counts["inline_scripts"] += 1
            return True
        if e.tag == "link" and _HINTS & set(a.get("rel", "").lower().split()) and is_tracker(a.get("href", "")):
            counts["resource_hints"] += 1
            urls.add(a["href"])
            return True
        if e.tag == "meta" and a.get("name", "").lower() in _VERIFICATION:
            counts["verification_meta"] += 1
            return True
        return False

    def attrs(e: Element) -> list[tuple[str, str]]:
        counts["ping_attributes"] += sum(k == "ping" for k, _ in e.attrs)
        return [(k, v) for k, v in e.attrs if k != "ping"]

    html = _rewrite(page, drop, attrs)
    return re.sub(r"<noscript[^>]*>\s*</noscript>", "", html), counts, sorted(urls)


def strip(pages: DataFrame, signatures: str) -> DataFrame:
    """(page_id, html, removed, urls) of pages(page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [strip_trackers(h or "", signatures) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "html": [h for h, _, _ in found], "removed": [sum(c.values()) for _, c, _ in found], "urls": [u for _, _, u in found]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, html string, removed int, urls array<string>")
