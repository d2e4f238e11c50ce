"""Crawling order, asset references, submissions, layout changes and job state, as joins, windows and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.operators import versions
from loomspan.operators.nodes import attribute, located, only_id
from loomspan.session import checkpointed


def crawl(links: DataFrame, starts: DataFrame, most_pages: int = 25, most_depth: int = 2, disallowed: DataFrame | None = None) -> DataFrame:
    """(root, url, depth, place): pages within reach of starts(root, url), each root a crawl of its own over links(url,
    href, pos), on its start's site alone, breadth first.

    All crawls go one level at a time: a level is one join and one anti-join on normalised URLs, and there are most_depth
    of them, whatever the number of roots. Pages of a level are in the order in which their links are found: that of the
    linking page, then of the link on it. The cap on pages is each crawl's own limit. disallowed(site, prefix), site a
    scheme and host, leaves out what robots rules forbid; a URL is looked up by each of its path's prefixes, so that rules
    may be many."""
    site = lambda c: F.regexp_extract(c, "^([a-zA-Z]+://[^/?#]+)", 1)
    edges = links.select(urls.normalize(F.col("url")).alias("source"), urls.normalize(urls.resolve(F.col("url"), F.col("href"))).alias("target"), "pos")
    edges = edges.where((site("source") == site("target")) & (site("target") != ""))
    if disallowed is not None:
        path = F.substr("target", F.length(site("target")) + 1)
        heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(path))), lambda i: F.substr(path, F.lit(1), i))
        targets = edges.select("target").distinct().select("target", site("target").alias("site"), F.explode(heads).alias("prefix"))
        forbidden = targets.join(disallowed.select("site", "prefix").distinct(), ["site", "prefix"]).select("target").distinct()
        edges = edges.join(forbidden, "target", "left_anti")
    none = F.array().cast("array<int>")
    seen = starts.select("root", urls.normalize(F.col("url")).alias("url"), F.lit(0).alias("depth"), none.alias("found"))
    frontier = seen
    for depth in range(1, most_depth + 1):
        at = F.concat("found", F.array(F.col("pos").cast("int")))
        reached = frontier.join(edges, F.col("url") == F.col("source")).groupBy("root", F.col("target").alias("url")).agg(F.min(at).alias("found"))
        frontier = checkpointed(reached.join(seen, ["root", "url"], "left_anti").select("root", "url", F.lit(depth).alias("depth"), "found"))
        seen = seen.unionByName(frontier)
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "found", "url"))
    return seen.withColumn("place", place).where(F.col("place") <= most_pages).select("root", "url", "depth", "place")


def start_tags(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, attrs): start tags of pages(page_id, html) in page order; JVM only."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*(?:\s[^>]*)?)>"), F.lit(1))).alias("pos", "raw")
    raw = pages.select("page_id", found)
    return raw.select("page_id", "pos", F.lower(F.regexp_extract("raw", "^([a-zA-Z0-9]+)", 1)).alias("tag"), F.regexp_extract("raw", r"^[a-zA-Z0-9]+\s*(.*)$", 1).alias("attrs"))


def tag_attribute(name: str) -> F.Column:
    """The value of an attribute in attrs, quoted or not; empty if absent."""
    return F.regexp_extract("attrs", rf"""(?i)(?:^|\s){name}\s*=\s*["']?([^"'>]*?)(?:["']|\s|$)""", 1)


# Which attribute of which element refers to a file, and of what kind.
ASSETS = (
    ("script", "src", "script"), ("img", "src", "img"), ("img", "data-src", "img"), ("img", "data-original", "img"), ("img", "data-lazy-src", "img"), ("img", "data-fallback", "img"),
    ("source", "src", "media"), ("video", "src", "media"), ("audio", "src", "media"), ("video", "poster", "img"), ("audio", "poster", "img"), ("track", "src", "media"),
)
ICON_RELS = ("icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon", "manifest")
PRELOADED = {"style": "link", "script": "script", "image": "img", "font": "font"}
META_IMAGES = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src", "msapplication-tileimage", "image")


def asset_refs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, ref): files that pages(page_id, html) refer to by attribute."""
    rel, as_ = F.lower(tag_attribute("rel")), F.lower(tag_attribute("as"))
    item = lambda when, kind, ref: F.when(when & (ref != ""), F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), ref.alias("ref")))
    tag = F.col("tag")
    one = [item(tag == t, kind, tag_attribute(a)) for t, a, kind in ASSETS]
    href, link = tag_attribute("href"), tag == "link"
    preload = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRELOADED.items() for x in kv)), as_), F.lit("media"))
    key = F.lower(F.coalesce(*(F.nullif(tag_attribute(a), F.lit("")) for a in ("property", "name", "itemprop")), F.lit("")))
    one += [
        item(link & rel.contains("stylesheet"), "link", href), item(link & rel.isin(*ICON_RELS), "icon", href), item(link & rel.contains("modulepreload"), "script", href),
        item(link & rel.isin("preload", "prefetch"), preload, href), item((tag == "meta") & key.isin(*META_IMAGES), "img", tag_attribute("content")),
        item((tag == "use") & ~href.startswith("#"), "img", F.regexp_replace(href, "#.*$", "")),
    ]
    srcset = F.when(tag.isin("img", "source"), F.transform(F.filter(F.split(F.regexp_extract("attrs", r"""(?i)srcset\s*=\s*["']([^"']*)""", 1), ","), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit("img").alias("kind"), F.regexp_extract(F.trim(x), r"^(\S+)", 1).alias("ref"))))
    found = F.concat(F.array_compact(F.array(*one)), F.coalesce(srcset, F.array().cast("array<struct<kind:string,ref:string>>")))
    return start_tags(pages).select("page_id", "pos", F.inline(found)).where(~urls.is_unfetchable(F.col("ref")) & ~F.lower("ref").startswith("data:"))


def css_closure(imports: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, sheet): stylesheets reached from entries(root, sheet) over imports(sheet, imported), each once; the loop
    ends where nothing new is found. Each level is a checkpoint, so that plans don't grow with the depth."""
    seen, frontier = entries, entries
    while True:
        found = frontier.join(imports, "sheet").select("root", F.col("imported").alias("sheet")).distinct()
        frontier = checkpointed(found.join(seen, ["root", "sheet"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


# What a field of each type may be given, and how it is substituted.
ACCEPTED = {"text": ("text", "document"), "textarea": ("text", "document"), "image": ("image",), "url": ("url", "text"), "video": ("video",), "audio": ("audio",)}
SUBSTITUTED = {"image": ("image_replace", "image"), "video": ("media_replace", "video"), "audio": ("media_replace", "audio"), "document": ("document_replace", "document"), "url": ("text_replace", "url")}


def validate(fields: DataFrame, given: DataFrame) -> DataFrame:
    """(page_id, field_id, severity, message) of given(page_id, field_id, type, value) against fields: a full outer join.

    Unknown fields fail, required ones must be there, types must fit; lengths and placeholders are warnings."""
    f = fields.select("page_id", "field_id", "field_type", "required", "max_length", F.lit(True).alias("known"))
    g = given.select("page_id", "field_id", F.col("type").alias("given_type"), "value", F.lit(True).alias("sent"))
    x = f.join(g, ["page_id", "field_id"], "full_outer")
    accepted = F.create_map(*(v for k, ts in ACCEPTED.items() for v in (F.lit(k), F.array(*map(F.lit, ts)))))
    fits = F.array_contains(F.try_element_at(accepted, F.col("field_type")), F.col("given_type"))
    verdict = lambda s, m: F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))
    blank = F.trim("value") == ""
    rule = (
        F.when(F.col("known").isNull(), verdict("hard", "unknown field"))
        .when(F.col("sent").isNull() & F.col("required"), verdict("hard", "required field is missing"))
        .when(F.col("sent").isNull(), verdict("success", "optional field is absent"))
        .when(~F.coalesce(fits, F.lit(False)), verdict("hard", "type does not fit"))
        .when(F.col("required") & blank, verdict("hard", "required field is empty"))
        .when(F.length("value") > F.col("max_length"), verdict("soft", "longer than the slot"))
        .when(F.lower("value").contains("lorem ipsum"), verdict("soft", "placeholder text"))
        .otherwise(verdict("success", "accepted"))
    )
    return x.select("page_id", "field_id", rule.alias("v")).select("page_id", "field_id", "v.*")


def substitutions(fields: DataFrame, given: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(page_id, field_id, path, original_value, value, kind) of given(page_id, field_id, value, instance, group_id).

    Rows without a group replace their field; rows of a group's instance shift the last index of the path, and are
    additions where the page has fewer instances (groups(page_id, group_id, instances))."""
    kinds = F.create_map(*(v for k, (s, _) in SUBSTITUTED.items() for v in (F.lit(k), F.lit(s))))
    f = fields.select("page_id", "field_id", "path", "original_value", F.coalesce(F.try_element_at(kinds, F.col("field_type")), F.lit("text_replace")).alias("kind"))
    plain = given.where("group_id is null").join(f, ["page_id", "field_id"]).select("page_id", "field_id", "path", "original_value", "value", "kind")
    if groups is None:
        return plain
    n = F.regexp_extract("path", r"^.*nth-child\(([0-9]+)\)", 1).try_cast("int")
    shifted = F.concat(F.regexp_extract("path", r"^(.*nth-child\()[0-9]+\)", 1), (n + F.col("instance")).cast("string"), F.regexp_extract("path", r"^.*nth-child\([0-9]+(\).*)$", 1))
    new = F.col("instance") >= F.col("instances")
    many = given.where("group_id is not null").join(groups, ["page_id", "group_id"]).join(f, ["page_id", "field_id"])
    many = many.select(
        "page_id", F.format_string("%s[%d].%s", "group_id", "instance", "field_id").alias("field_id"), F.coalesce(F.when(n.isNotNull(), shifted), "path").alias("path"),
        F.when(~new, F.col("original_value")).alias("original_value"), "value", F.when(new, "repeatable_instance_add").otherwise(F.col("kind")).alias("kind"),
    )
    return plain.unionByName(many)


def portfolio(fields: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(page_id, category, n_fields, is_applicable): every category for every page."""
    to = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    counts = fields.withColumn("category", F.try_element_at(to, F.col("role"))).where("category is not null").groupBy("page_id", "category").agg(F.count("*").alias("n"))
    every = fields.select("page_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, sorted(set(mapping.values()))))))
    x = every.join(counts, ["page_id", "category"], "left").withColumn("n_fields", F.coalesce("n", F.lit(0)).cast("long"))
    return x.select("page_id", "category", "n_fields", (F.col("n_fields") > 0).alias("is_applicable"))


# The order in which kinds of layout changes are carried out.
ACTION_ORDER = {"remove_nav_entry": 0, "recompute_flex_basis": 1, "close_spacing_gap": 2, "renumber_order": 3}


def removal_plan(nodes: DataFrame, styles: DataFrame, removed: DataFrame) -> DataFrame:
    """(page_id, step, action, path, prop, before, after): what changes when the nodes at removed(page_id, path) go.

    styles(page_id, node_id, prop, value). Menu entries of the section's id go; percent widths of the siblings in a
    flex container are shared out anew; a margin moves to the sibling before; sections are numbered anew."""
    gone = located(nodes, removed).where("depth > 0").select("page_id", F.col("node_id").alias("gone"), F.col("parent_id").alias("parent"), F.col("child_idx").alias("at"), attribute("id").alias("section_id"))
    s = lambda p, name: styles.where(F.col("prop") == p).select("page_id", "node_id", F.col("value").alias(name))
    layout = s("display", "display").join(s("flex-direction", "direction"), ["page_id", "node_id"], "full_outer").select("page_id", F.col("node_id").alias("parent"), "display", "direction")
    gone = gone.join(layout, ["page_id", "parent"], "left")
    display, direction = F.coalesce("display", F.lit("")), F.coalesce("direction", F.lit(""))
    container = F.when(display.contains("grid"), "grid").when(display.contains("flex"), F.when(direction.contains("column"), "flex_column").otherwise("flex_row")).otherwise("stack")
    siblings = nodes.select("page_id", F.col("parent_id").alias("parent"), "node_id", "path", "child_idx", attribute("data-section-index").alias("section_index"))
    x = gone.withColumn("container", container).join(siblings, ["page_id", "parent"]).where("node_id <> gone")
    for prop, name in (("width", "width"), ("flex-basis", "basis"), ("margin-bottom", "margin"), ("order", "ordering")):
        x = x.join(s(prop, name), ["page_id", "node_id"], "left")
    x = x.join(s("margin-bottom", "gone_margin").withColumnRenamed("node_id", "gone"), ["page_id", "gone"], "left")
    group = Window.partitionBy("page_id", "gone")
    x = x.withColumns({"left": F.count("*").over(group), "last": F.max("child_idx").over(group)})
    share = F.concat(F.round(100 / F.col("left"), 2).cast("string"), F.lit("%"))
    flex = F.col("container").startswith("flex")
    moved = F.coalesce("gone_margin", F.lit("0px"))
    numbered = F.col("section_index").isNotNull() | F.col("ordering").isNotNull()
    place = F.sum(F.when(numbered, 1).otherwise(0)).over(group.orderBy("child_idx").rowsBetween(Window.unboundedPreceding, 0)).cast("string")
    action = lambda when, kind, prop, before, after: F.when(when, F.struct(F.lit(kind).alias("action"), F.lit(prop).alias("prop"), before.alias("before"), after.alias("after")))
    changes = F.array_compact(F.array(
        action(flex & F.col("width").contains("%"), "recompute_flex_basis", "width", F.col("width"), share),
        action(flex & ~F.coalesce(F.col("width").contains("%"), F.lit(False)) & F.col("basis").contains("%"), "recompute_flex_basis", "flex-basis", F.col("basis"), share),
        action(F.col("container").isin("stack", "flex_column") & (F.col("child_idx") == F.col("at") - 1) & (F.col("last") > F.col("at")) & (moved != "0px") & (F.coalesce("margin", F.lit("0px")) == "0px"), "close_spacing_gap", "margin-bottom", F.lit("0px"), moved),
        action(F.col("section_index").isNotNull(), "renumber_order", "data-section-index", F.col("section_index"), F.col("place")),
        action(F.col("ordering").isNotNull(), "renumber_order", "order", F.col("ordering"), F.col("place")),
    ))
    own = x.withColumn("place", place).select("page_id", "path", "child_idx", F.inline(changes))
    menu = nodes.where("tag = 'a'").select("page_id", "path", "node_id", F.regexp_extract(attribute("href"), "^#([^/]+)", 1).alias("section_id")).where("section_id <> ''")
    nothing = F.lit(None).cast("string")
    menu = menu.join(gone.select("page_id", "section_id"), ["page_id", "section_id"]).select("page_id", "path", F.col("node_id").alias("child_idx"), F.lit("remove_nav_entry").alias("action"), nothing.alias("prop"), nothing.alias("before"), nothing.alias("after"))
    order = F.create_map(*(F.lit(v) for kv in ACTION_ORDER.items() for v in kv))
    step = F.row_number().over(Window.partitionBy("page_id").orderBy(order[F.col("action")], "child_idx", "prop"))
    return own.unionByName(menu).withColumn("step", step).select("page_id", "step", "action", "path", "prop", "before", "after")


def minted_classes(nodes: DataFrame, prefix: str = "style") -> DataFrame:
    """(page_id, style, n, class): inline styles found twice or more in a page and the class that replaces each."""
    n = nodes.select("page_id", attribute("style").alias("style")).where("style is not null").groupBy("page_id", "style").agg(F.count("*").alias("n")).where("n >= 2")
    return n.withColumn("class", F.concat(F.lit(f"{prefix}-"), F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "style")).cast("string")))


STALE = 1800.0


def reopened(state: dict, t: float, stale: float = STALE) -> dict:
    """A state at time t: a claim without a beat for more than `stale` seconds is open again."""
    return state | {"status": "pending", "token": ""} if state["status"] == "running" and t - state["beat"] > stale else state


def job_step(state: dict, kind: str, token: str | None, t: float, most_attempts: int = 3, stale: float = STALE) -> dict:
    """The state of a job after an event. Results and beats of a worker that lost its claim are discarded."""
    s = dict(reopened(state, t, stale))
    if kind == "enqueue" and s["status"] == "new":
        s["status"] = "pending"
    elif kind == "claim":
        if s["status"] == "pending":
            s |= {"status": "running", "token": token or "", "attempts": s["attempts"] + 1, "beat": t}
    elif s["status"] != "running" or (token or "") != s["token"]:
        s["discarded"] += kind in ("heartbeat", "complete", "fail", "fail_permanent")
    elif kind == "heartbeat":
        s["beat"] = t
    elif kind == "complete":
        s["status"] = "completed"
    elif kind == "fail_permanent" or kind == "fail" and s["attempts"] >= most_attempts:
        s |= {"status": "failed", "token": ""}
    elif kind == "fail":
        s |= {"status": "pending", "token": ""}
    if s["status"] in ("completed", "failed") and state["status"] not in ("completed", "failed"):
        s["ended"] = t
    return s


NEW_JOB = {"status": "new", "token": "", "attempts": 0, "beat": 0.0, "discarded": 0, "ended": None}
JOB_STATE = "status string, token string, attempts int, beat double, discarded int, ended double"
_SHOWN = ("status", "attempts", "discarded", "ended")
JOBS = "job_id long, status string, attempts int, discarded int, ended double"


def job_states(events: DataFrame, until: float | None = None, stale: float = STALE) -> DataFrame:
    """(job_id, status, attempts, discarded, ended) after events(job_id, seq, t, kind, token): an ordered fold for each job
    over sorted, streamed batches; one state is held at a time. `ended` is when a job was completed or failed. With until,
    the states are those of that time: claims that have been silent for too long by then are open again."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state = None, None

        def row() -> tuple:
            last = state if until is None else reopened(state, until, stale)
            return (job, *(last[k] for k in _SHOWN))

        for pdf in batches:
            done = []
            for j, t, kind, token in zip(pdf["job_id"], pdf["t"], pdf["kind"], pdf["token"]):
                if j != job:
                    if state:
                        done.append(row())
                    job, state = j, dict(NEW_JOB)
                state = job_step(state, kind, token, t, stale=stale)
            yield pd.DataFrame(done, columns=["job_id", *_SHOWN])
        if state:
            yield pd.DataFrame([row()], columns=["job_id", *_SHOWN])

    x = events.select("job_id", "seq", "t", "kind", "token").repartition("job_id").sortWithinPartitions("job_id", "t", "seq")
    return x.mapInPandas(fold, JOBS)


def job_state_stream(events: DataFrame, late: str = "1 minute", stale: float = STALE) -> DataFrame:
    """The same states from a stream of events(job_id, seq, t, kind, token), t in seconds, updated as events come.

    A claimed job has a timer `stale` seconds after its last beat. When the watermark, `late` behind the latest event of
    any job, passes it, the job is open again and its row is given anew, though no event of its own has come. What comes
    after the watermark has passed it is dropped."""

    def update(key, batches, state):
        s = dict(zip(NEW_JOB, state.get)) if state.exists else dict(NEW_JOB)
        if state.hasTimedOut:
            s = reopened(s, float("inf"), stale)
        else:
            rows = pd.concat(list(batches)).sort_values(["t", "seq"])
            for t, kind, token in zip(rows["t"], rows["kind"], rows["token"]):
                s = job_step(s, kind, token, float(t), stale=stale)
        state.update(tuple(s.values()))
        if s["status"] == "running":
            state.setTimeoutTimestamp(max(int((s["beat"] + stale) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *(s[k] for k in _SHOWN))], columns=["job_id", *_SHOWN])

    timed = events.withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).withWatermark("at", late)
    return timed.groupBy("job_id").applyInPandasWithState(update, JOBS, JOB_STATE, "update", "EventTimeTimeout")


def project_updates(jobs: DataFrame) -> DataFrame:
    """(project_id, status, fidelity, completed_at, at) of finished jobs(job_id, project_id, status, fidelity, ended): what
    they make of their project. The job that ended last sets the status; fidelity and time are those of the last that was
    completed, null if none was."""
    order = F.struct("ended", "job_id")
    ended = jobs.where(F.col("status").isin("completed", "failed") & F.col("ended").isNotNull())
    best = F.max_by(F.struct("fidelity", "ended"), F.when(F.col("status") == "completed", order))
    x = ended.groupBy("project_id").agg(F.max_by("status", order).alias("status"), best.alias("c"), F.max(order).alias("at"))
    return x.select("project_id", "status", "c.fidelity", F.col("c.ended").alias("completed_at"), "at")


def apply_updates(projects: DataFrame, updates: DataFrame) -> DataFrame:
    """projects(project_id, status, fidelity, completed_at, at, ...) after updates (see project_updates). An update that is
    not later than what a project has (at) changes nothing, so that one that comes twice does no harm; a failure leaves
    fidelity and time as they were. Updates of projects that aren't there fall away."""
    u = updates.select("project_id", *(F.col(c).alias(f"__{c}") for c in ("status", "fidelity", "completed_at", "at")))
    x = projects.join(u, "project_id", "left")
    later = F.col("__at").isNotNull() & (F.col("at").isNull() | (F.col("__at") > F.col("at")))
    done = later & F.col("__completed_at").isNotNull()
    new = {"status": F.when(later, F.col("__status")).otherwise(F.col("status")), "at": F.when(later, F.col("__at")).otherwise(F.col("at"))}
    new |= {c: F.when(done, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("fidelity", "completed_at")}
    return x.withColumns(new).select(*projects.columns)


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(site, prefix): what robots(site, text) forbids an agent: the Disallow lines that follow its User-agent line, up to
    the next group's. Agents named one after the other share a group; empty rules forbid nothing."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    x = robots.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).select("site", "at", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"))
    x = x.where("key in ('user-agent', 'disallow', 'allow', 'crawl-delay')").withColumn("names", F.col("key") == "user-agent")
    site = Window.partitionBy("site").orderBy("at")
    begins = F.col("names") & ~F.coalesce(F.lag("names").over(site), F.lit(False))
    x = x.withColumn("group", F.sum(begins.cast("int")).over(site))
    ours = x.where(F.col("names") & (F.lower("value") == agent.lower())).select("site", "group").distinct()
    return x.where("key = 'disallow' and value <> ''").join(ours, ["site", "group"], "left_semi").select("site", F.col("value").alias("prefix")).distinct()


def remove_sections(nodes: DataFrame, removals: DataFrame, broken) -> tuple[DataFrame, DataFrame]:
    """Sections removed one after the other: removals(page_id, step, path), steps from 1 on -> the trees that are left, and
    (page_id, applied, passed). With the node_id of each path, the nodes need not be dealt by path to find it.

    A step is planned (removal_plan), carried out (versions.reflow, then the subtrees go) and compared with the tree before
    it: broken(before, after, removed) -> (page_id, ...) names what is wrong, and a page where anything is takes no further
    step. Pages go through their steps together; a page leaves the rounds when it is done or broken, and the rounds end
    with the last page. A plan and its check read the tree of the round before as it is, with pages that ended there, as
    they have no removals any more; the tree itself is dealt by page once a round, and what goes is located once."""
    if "node_id" not in removals.columns:
        removals = checkpointed(removals.join(nodes.select("page_id", "path", "node_id"), ["page_id", "path"], "left"))
    last = removals.groupBy("page_id").agg(F.max("step").alias("last"))
    state = checkpointed(last.select("page_id", "last", F.lit(0).alias("applied"), F.lit(True).alias("passed")))
    left = nodes.join(last, "page_id", "left_anti")
    open_ = nodes
    done, step = None, 0
    while not state.isEmpty():
        step += 1
        before = open_
        places = only_id(before).select("page_id", "node_id", "parent_id", "depth", "subtree_end", "child_idx", "attrs")
        taken = removals.where(F.col("step") == step).join(state, "page_id", "left_semi").select("page_id", "path", "node_id")
        taken = checkpointed(taken.join(places, ["page_id", "node_id"], "left"))
        now = taken.where("subtree_end is not null")
        plan = removal_plan(before, versions.inline_styles(before).drop("path"), now)
        still = before.join(state.select("page_id"), "page_id", "left_semi")
        open_ = checkpointed(_without(versions.reflow(still, plan), now, before))
        wrong = broken(before, open_, now).select("page_id").distinct().withColumn("wrong", F.lit(True))
        turned = taken.select("page_id").distinct().withColumn("turned", F.lit(1))
        state = state.join(turned, "page_id", "left").join(wrong, "page_id", "left").select(
            "page_id", "last", (F.col("applied") + F.coalesce("turned", F.lit(0))).alias("applied"), (F.col("turned").isNull() | F.col("wrong").isNull()).alias("passed")
        )
        state = checkpointed(state)
        ends = ~F.col("passed") | (F.col("last") <= step)
        finished = state.where(ends)
        done = finished if done is None else done.unionByName(finished)
        left = left.unionByName(open_.join(finished, "page_id", "left_semi"))
        state = state.where(~ends)
    # A union is joined by sorting, too, as the kept tables in it are.
    return left.hint("merge"), (state if done is None else done).select("page_id", "applied", "passed").hint("merge")


def _without(nodes: DataFrame, removed: DataFrame, of: DataFrame) -> DataFrame:
    from loomspan.operators.sections import without_sections

    return without_sections(nodes, removed, of).select(*nodes.columns)


def template_step(designs: DataFrame, preview) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What follows an extraction: designs(template_id, url, at, tokens map) -> the catalogue (template_id, url, tags), the
    token store (template_id, tokens: the latest) and versions (template_id, version, tokens, preview)."""
    latest = F.max_by(F.struct("url", "tokens"), "at")
    newest = designs.groupBy("template_id").agg(latest.alias("d"))
    catalogue = newest.select("template_id", "d.url", F.array(F.lit("auto-extracted"), F.lit("web-reconstruction")).alias("tags"))
    version = F.row_number().over(Window.partitionBy("template_id").orderBy("at"))
    shown = preview(F.concat(F.lit('<div id="root">Preview of '), "url", F.lit("</div>")), F.col("tokens"))
    return catalogue, newest.select("template_id", "d.tokens"), designs.select("template_id", version.alias("version"), "tokens", shown.alias("preview"))
