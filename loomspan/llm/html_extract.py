"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of tokens: words score positive, tags negative, and a single linear scan finds the contiguous run
with the largest sum. What a token scores is learned from labelled pages, which say themselves where their content is
(exactly one `article` or `main` element): the log-odds, inside against outside, of each tag, of link words, and of each
class, id and role that words stand under. A name that says so itself (`cookie-notice`, `related-posts`) starts low,
where it is made of nothing but such words (`has-sidebar`, `long-form` or `social-science` say nothing).

All evidence is in the scores, and the run decides. A low name lowers the words under it, as do the tags and ARIA roles
of menus, headers, footers and asides, and standing outside the one article that holds the page's prose; the name of an
element with most of the prose is never held against it. The text is that of the run, without the dips between its ends, stretches of
words that score below zero. Only what is no text is left out of the sequence itself: scripts, styles, form controls and
what is hidden. Reader comments are known by names, by an article inside an article, by a heading that says so, or by
links to reply. Elements know their parent alone, so that a page costs time and memory in proportion to its length,
however deep it is nested.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import discard, keep

#: Labelled pages that the weights are learned from, at most; a class counts that so many of them have (a share, and a number).
SAMPLE = 2000
SHARE, PAGES = 0.01, 3
#: Share of a page's prose from which an element is the page rather than a part.
MOST = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg|math|xmp|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>.*?(?:</(?P=raw)\s*>|$)|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"](?=[^'\"]*(?:>|$)))*)(?:>|$)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that hold no text of a page's own; those and roles that are parts of a page.
_NEVER = frozenset("head button select option datalist fieldset dialog object canvas audio video map".split())
_ASIDE = frozenset("nav footer aside menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words that name a part by themselves, and words that such names are made of besides.
_PART = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner promo promos promotion promotions sponsor sponsors sponsored sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin "
    "login share sharing social related recommended recommendations pagination pager skiplink search form copyright disclaimer".split()
)
_COMMENT = frozenset("comment comments commentlist commentary respond reply replies disqus".split())
_NEUTRAL = frozenset(
    "site page main global top bottom left right primary secondary inner outer wrapper wrap container box block area section list item items row col column content body text title heading post posts article articles "
    "entry story blog news link links button buttons bar panel group holder unit slot module media user users reader readers email mail count thread feed view skip to up sign on-page success info warning danger".split()
)
#: Parts of an article may be named like those of a page: `entry-header`.
_OWN = frozenset("entry post article story section".split())
_REPLY = re.compile(r"\W*(?:reply|reply to \S+|antworten|répondre|responder)\W*", re.I)
_COMMENTS_HEAD = re.compile(
    r"\W*(?:reader |user |latest |recent |top |all )?(?:comments?|kommentare?|commentaires?|comentarios?)[\W\d]*|\W*\d+\s+(?:responses?|replies|thoughts|comments?|kommentare?|commentaires?|comentarios?)\b.*"
    r"|\W*(?:leave|post|write|add|submit) (?:a|your) (?:reply|comment|response)\b.*",
    re.I,
)
#: Closed by the start of another block.
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@functools.lru_cache(50_000)
def judge_name(name: str, in_article: bool) -> str:
    """What a class, id or role says of its element: "part", "comment" or nothing."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if len(w) > 1]
    known = set(words)
    if not known or not known <= _PART | _COMMENT | _NEUTRAL:
        return ""
    if known & _COMMENT:
        return "comment"
    if "header" in known and (known & _OWN or in_article) and not known & (_PART - {"header"}):
        return ""
    return "part" if known & _PART else ""


@dataclass
class Element:
    """An open element that may say something of what is in it."""

    tag: str
    parent: int  # number of the element around it, -1 for none
    names: tuple[str, ...] = ()
    judged: str = ""
    new: tuple[str, ...] = ()  # names that no element around it has


@dataclass
class Block:
    """A run of text between block-level tags, with the token classes that lead to and through it."""

    text: str
    words: int
    link_words: int
    before: list[str]  # classes of the tags before it
    banned: bool
    at: int  # number of the innermost element around it, -1 for none

    @property
    def heading(self) -> bool:
        return bool(self.before) and self.before[-1] in _HEADINGS

    @property
    def prose(self) -> int:
        return self.words - self.link_words


@dataclass
class _Open:
    tag: str
    banned: bool = False
    at: int = -1
    article: bool = False
    nested: bool = False  # in an element `article`
    names: tuple[str, ...] = ()  # that are open by it alone
    comments: tuple[int, int] | None = None  # element that a heading began, and the heading's rank


def _attributes(raw: str) -> dict[str, str]:
    return {n.lower(): a or b or c for n, a, b, c in reversed(_ATTR.findall(raw))}


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and the elements that they name."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[_Open] = [_Open("")]
    named: set[str] = set()  # names of open elements
    open_tags: Counter = Counter()
    parts: list[str] = []
    before: list[str] = []
    n_words = n_links = links = at = 0

    def element(tag: str, parent: int, names: tuple[str, ...] = (), judged: str = "") -> int:
        new = tuple(x for x in names if x not in named)
        named.update(new)
        elements.append(Element(tag, parent, names, judged, new))
        return len(elements) - 1

    def flush() -> None:
        nonlocal n_words, n_links, before
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            top, around = stack[-1], stack[-2] if len(stack) > 1 else None
            if around and top.tag in _HEADINGS and _COMMENTS_HEAD.fullmatch(text):
                around.comments = (element("", around.at, (), "comment"), int(top.tag[1]))
            inner = top.at
            if top.comments:
                inner = top.comments[0]
            elif around and around.comments and inner == around.at:
                inner = around.comments[0]
            out.append(Block(text, n_words, n_links, before, top.banned, inner))
            before = []
        parts.clear()
        n_words = n_links = 0

    def say(raw: str) -> None:
        nonlocal n_words, n_links
        if raw:
            parts.append(raw)
            n = len(raw.split())
            n_words += n
            n_links += n if links else 0

    def close(depth: int) -> None:
        for o in stack[depth:]:
            named.difference_update(o.names)
            open_tags[o.tag] -= 1
        del stack[depth:]

    def pop(tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                close(i)
                return
            if stack[i].tag in ("article", "main", "td", "table", "body") and tag in ("p", "li", "b", "i"):
                return

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in _INLINE:
                continue
            flush()
            before.append("/" + tag)
            if tag not in _VOID and open_tags[tag]:
                pop(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _INLINE:
            links += tag == "a"
            continue
        flush()
        links = 0
        before.append(tag)
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and stack[-1].tag == "p" or tag in ("li", "option", "tr", "td", "th", "dt", "dd") and stack[-1].tag == tag:
            close(len(stack) - 1)
        if tag == "body":  # whatever the head left open
            close(1)
        over = stack[-1]
        if over.comments and tag in _HEADINGS and int(tag[1]) <= over.comments[1]:  # the next section begins
            over.comments = None
        said = _attributes(m["attrs"]) if "=" in m["attrs"] or "hidden" in m["attrs"].lower() else {}
        role = said.get("role", "").lower()
        banned = (
            over.banned or tag in _NEVER
            or "hidden" in said and said["hidden"].lower() != "until-found" or said.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(said.get("style", "")))
        )
        part = tag in _ASIDE or role in _ROLES or tag == "header" and not over.article
        article = over.article or tag in ("article", "main") or role in ("article", "main")
        names = tuple(dict.fromkeys(re.sub(r"\d+", "#", x) for x in (*said.get("class", "").split(), *said.get("id", "").split(), *role.split())))
        inner = over.comments[0] if over.comments else over.at
        opened = _Open(tag, banned, inner, article, over.nested or tag == "article")
        if names or part or tag in ("article", "main", "form", "section", "ol", "ul", "div"):
            judged = ""
            if tag not in (*_HEADINGS, "html", "body", "main"):
                verdicts = {judge_name(x, over.article) for x in names}
                judged = "aside" if part else "comment" if "comment" in verdicts else "part" if "part" in verdicts or tag == "form" else ""
                if tag == "article" and over.nested:
                    judged = "comment"
            opened.at = element("main" if role == "main" else tag, inner, () if tag in ("html", "body") else names, judged)
            opened.names = elements[-1].new
        stack.append(opened)
        open_tags[tag] += 1
    say(page[at:])
    flush()
    return out, elements


@dataclass
class Weights:
    """Scores of token classes: of tags (never above -least), of words and link words, and what a class, id or role
    adds to the words under it (between -3 and 1)."""

    tags: dict[str, float]
    link: float = 0.2
    names: dict[str, float] = field(default_factory=dict)
    least: float = 0.05

    def tag(self, kind: str) -> float:
        return min(-self.least, self.tags.get(kind, -0.2))

    def name(self, name: str) -> float:
        return self.names.get(name, 0.0)


#: Used where no page is labelled.
DEFAULT = Weights({"p": -0.1, "/p": -0.1, "li": -0.5, "/li": -0.5, "div": -0.2, "/div": -0.2})
#: What words score under a name that says it is a part, besides what is learned of it.
_LOW = -2.0


def _prose(found: list[Block], elements: list[Element], words: Callable[[Block], int]) -> tuple[int, list[int]]:
    """Words outside banned parts: of the page, and under each element."""
    under = [0] * len(elements)
    total = 0
    for b in found:
        if not b.banned:
            total += words(b)
            if b.at >= 0:
                under[b.at] += words(b)
    for i in range(len(elements) - 1, -1, -1):  # an element comes after those around it
        if elements[i].parent >= 0:
            under[elements[i].parent] += under[i]
    return total, under


def _inside(elements: list[Element], of: set[int]) -> list[bool]:
    """Whether each element is one of a set or in one of them."""
    out: list[bool] = []
    for i, e in enumerate(elements):
        out.append(i in of or e.parent >= 0 and out[e.parent])
    return out


def _comments(found: list[Block], elements: list[Element], total: int, under: list[int]) -> list[bool]:
    """Elements that hold reader comments; none if the page has no other prose."""
    out = {i for i, e in enumerate(elements) if e.judged == "comment"}
    holds: list[int] = []  # the largest section or list around each element that isn't the page, -1 for none
    for i, e in enumerate(elements):
        above = holds[e.parent] if e.parent >= 0 else -1
        if e.tag in ("main", "article") and e.judged != "comment" or under[i] > MOST * total:
            holds.append(-1)
        else:
            holds.append(above if above >= 0 else i if e.tag in ("section", "ol", "ul", "div") else -1)
    out |= {holds[b.at] for b in found if b.at >= 0 and b.words <= 4 and not b.banned and _REPLY.fullmatch(b.text)} - {-1}
    inside = _inside(elements, out)
    left = sum(b.prose for b in found if not b.banned and not (b.at >= 0 and inside[b.at]))
    return inside if left > 0 else [False] * len(elements)


def _holder(found: list[Block], scores: list[float], elements: list[Element]) -> int | None:
    """The article or main element that the page is about: the smallest with most of the words that score above zero."""
    words = [b.words if score > 0 else 0 for b, score in zip(found, scores)]
    total, under = sum(words), [0] * len(elements)
    for b, n in zip(found, words):
        if b.at >= 0:
            under[b.at] += n
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            under[elements[i].parent] += under[i]
    in_main, in_article = [], []  # the main element around each, and whether an article is
    own: dict[int, list[int]] = {}
    for i, e in enumerate(elements):
        main = in_main[e.parent] if e.parent >= 0 else -1
        article = e.parent >= 0 and (in_article[e.parent] or elements[e.parent].tag == "article")
        if e.tag == "article" and main >= 0 and not article and under[i]:
            own.setdefault(main, []).append(i)
        in_main.append(i if e.tag == "main" else main)
        in_article.append(article)
    for main, articles in own.items():  # one article in it is what it is about, whatever stands beside
        if len(articles) == 1 and under[articles[0]] >= 0.25 * under[main] and under[main] >= 0.7 * total:
            return articles[0]
    large = [i for i, e in enumerate(elements) if e.tag in ("article", "main") and total and under[i] >= 0.7 * total]
    return min(large, key=lambda i: (under[i], -i)) if large else None


def block_scores(found: list[Block], elements: list[Element], weights: Weights) -> tuple[list[float], list[bool], bool]:
    """What a word of each block scores (a link word less), which blocks are of a known part of a page, and whether one
    article holds the page."""
    total, under = _prose(found, elements, lambda b: b.prose)
    comments = _comments(found, elements, total, under)
    sums: list[float] = []
    low: list[bool] = []
    for i, e in enumerate(elements):
        part = 0.0
        lowered = comments[i] and not (e.parent >= 0 and comments[e.parent])
        if lowered or e.judged == "aside":  # by its tag or role
            part, lowered = _LOW, True
        elif under[i] < total or total == 0:  # what holds all or most is the page rather than a part of it, whatever its name says
            lowered = e.judged == "part" and under[i] <= MOST * total
            part = max(-3.0, min(1.0, sum(map(weights.name, e.names)))) + (_LOW if lowered else 0.0)
        sums.append(part + (sums[e.parent] if e.parent >= 0 else 0.0))
        low.append(lowered or e.parent >= 0 and low[e.parent])
    scores = [max(-2.0, min(2.0, 1.0 + (sums[b.at] if b.at >= 0 else 0.0))) for b in found]
    scores = [-1.0 if b.banned else s for b, s in zip(found, scores)]
    holder = _holder(found, scores, elements)
    if holder is not None:
        held = _inside(elements, {holder})
        scores = [s if s <= 0 or b.at >= 0 and held[b.at] else s + _LOW for b, s in zip(found, scores)]
    return scores, [b.banned or b.at >= 0 and low[b.at] for b in found], holder is not None


def best_run(found: list[Block], scores: list[float], known: list[bool], weights: Weights) -> tuple[int, int]:
    """First and last block of the run of tokens with the largest sum (the first of equal ones); (0, -1) if empty. A known
    part that scores below zero is passed over, so that a long one in an article does not cut it in two."""
    best, run, total, start = 0.0, (0, -1), 0.0, 0
    for i, (b, score) in enumerate(zip(found, scores)):
        if known[i] and score <= 0:
            continue
        total += sum(map(weights.tag, b.before))
        if total <= 0:
            total, start = 0.0, i
        # The words of a block follow each other: its first word opens a run, its last one ends it.
        total += b.prose * score + b.link_words * (min(score, weights.link) if score > 0 else score)
        if total > best:
            best, run = total, (start, i)
    return run


def run_text(found: list[Block], scores: list[float], first: int, last: int) -> str:
    """The text of a run without the dips between its ends."""
    out: list[str] = []
    dip: list[str] = []
    above = False
    for b, score in zip(found[first : last + 1], scores[first : last + 1]):
        if b.banned:
            continue
        if score > 0:
            out += [b.text] if above else [*dip, b.text]
            dip, above = [], True
        else:
            dip.append(b.text)
    return " ".join(out + dip)


def main_text(page: str | None, weights: Weights = DEFAULT) -> str:
    """Main text of a page; empty if it has none."""
    if not page:
        return ""
    found, elements = parse(page)
    scores, known, held = block_scores(found, elements, weights)
    first, last = best_run(found, scores, known, weights)
    if last < first:
        return ""
    while first and found[first - 1].heading and scores[first - 1] > 0:  # few words, many tags: yet they belong
        first -= 1
    if not held:
        title = next((i for i in range(first, last + 1) if found[i].before and found[i].before[-1] == "h1"), first)
        if sum(b.words for b in found[first:title]) < 0.1 * sum(b.words for b in found[first : last + 1]):
            first = title  # what little stands above the title isn't of the article
    return run_text(found, scores, first, last)


def count_classes(page: str) -> tuple[Counter, Counter] | None:
    """Token classes ("tag p", "name ad", "link", "word") inside and outside the content of a page that marks it, else None."""
    found, elements = parse(page)
    held: list[bool] = []  # in an article or main element
    tops = []
    for i, e in enumerate(elements):
        around = e.parent >= 0 and (held[e.parent] or elements[e.parent].tag in ("article", "main"))
        held.append(around)
        if e.tag in ("article", "main") and not around:
            tops.append(i)
    if len(tops) != 1:
        return None
    within = _inside(elements, {tops[0]})
    inside, outside = Counter(), Counter()
    for b in found:
        if not b.banned:
            side = inside if b.at >= 0 and within[b.at] else outside
            side.update(f"tag {t}" for t in b.before)
            side.update({"word": b.prose, "link": b.link_words})
    # Words under a name, on either side: those under each element that opens it.
    _, of_both = _prose(found, elements, lambda b: b.words)
    _, of_inside = _prose(found, elements, lambda b: b.words if b.at >= 0 and within[b.at] else 0)
    for e, both, own in zip(elements, of_both, of_inside):
        inside.update({f"name {x}": own for x in e.new if own})
        outside.update({f"name {x}": both - own for x in e.new if both > own})
    return inside, outside


def learn_weights(inside: Counter, outside: Counter) -> Weights:
    """Log-odds of each token class, scaled so that a word scores one."""
    words, tokens = ([c["word"] + c["link"] + 1 for c in (inside, outside)], [sum(n for x, n in c.items() if x.startswith("tag ")) + 1 for c in (inside, outside)])

    def odds(kind: str, of: list[int]) -> float:
        """One more of the class is shared out as all are, so that what was never seen says nothing."""
        a, b = (c[kind] + n / sum(of) for c, n in zip((inside, outside), of))
        return math.log(a / of[0]) - math.log(b / of[1])

    tags, names = {}, {}
    for kind in {*inside, *outside}:
        group, _, name = kind.partition(" ")
        if group == "tag":
            tags[name] = max(-2.0, 0.25 * odds(kind, tokens) - 0.2)
        elif group == "name":
            names[name] = max(-3.0, min(1.0, odds(kind, words)))
    return Weights(tags, max(0.05, min(1.0, 0.5 + 0.25 * (odds("link", words) - odds("word", words)))), names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        for page in batch.column(0).to_pylist():
            if page and (found := count_classes(page)):
                for kind in {*found[0], *found[1], "pages"}:
                    x = sums[kind]
                    x[0] += found[0][kind]
                    x[1] += found[1][kind]
                    x[2] += 1
    kinds = sorted(sums)
    columns = [pa.array(kinds, pa.string()), *(pa.array([sums[k][i] for k in kinds], pa.int64()) for i in range(3))]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "inside", "outside", "pages"])


def learn(pages: DataFrame, html_column: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from the labelled ones of a bounded sample of pages: those with the smallest hashes. Only hashes are
    sorted; the pages themselves stay where they are read. A class counts if one labelled page in a hundred has it (and
    three have), so that what comes to the driver is bounded by a hundred pages' classes."""
    known = pages.where(F.col(html_column).rlike("(?i)<(article|main)[\\s>]")).select(html_column, F.xxhash64(html_column).alias("hash"))
    last = known.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if last is None:
        return DEFAULT
    counts = known.where(F.col("hash") <= last).dropDuplicates(["hash"]).select(html_column).mapInArrow(_count, "kind string, inside long, outside long, pages long")
    counts = counts.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages")))
    counts = keep(counts)
    labelled = counts.where("kind = 'pages'").first()
    rows = counts.where(F.col("pages") >= max(PAGES, SHARE * labelled.pages)).collect() if labelled else []
    discard(counts)
    found = {r.kind: r for r in rows}
    if "word" not in found or not found["word"].inside:
        return DEFAULT
    return learn_weights(Counter({k: r.inside for k, r in found.items() if k != "pages"}), Counter({k: r.outside for k, r in found.items() if k != "pages"}))


def _extract(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], ["row", "text"])

    return run


def extract(pages: DataFrame, weights: Weights | None = None, html_column: str = "html") -> DataFrame:
    """Each row of pages, without its html, with text (its main text) and n_chars (code points).

    A null or empty page has an empty text, as has one without words outside menus and the like. Repeated rows give
    equal texts; columns of these names are replaced. An empty table gives an empty table."""
    weights = weights or learn(pages, html_column)
    others = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html_column]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = pages.select(F.col(html_column).alias("html"), row.alias("row"))
    out = rows.mapInArrow(_extract(weights), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), "text", F.length("text").cast("long").alias("n_chars"))
