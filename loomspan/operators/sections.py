"""Sections, slots and form fields of pages, from the nodes table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import placeholder
from loomspan.operators.nodes import attribute, located
from loomspan.session import checkpointed

# Elements that can be sections, and those whose text or picture can be replaced.
SECTION_TAGS = ("div", "section", "header", "footer", "nav", "main", "aside", "article", "form")
TEXT_TAGS = (
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "span", "a", "button", "li", "blockquote", "figcaption", "label", "strong", "em", "small", "td", "th", "dt", "dd", "summary", "cite", "q", "b", "i", "caption",
)
MOST_SLOTS = 300
LEAST_LENGTH = 80
REPEATABLE = ("portfolio", "team", "testimonials", "pricing", "feature_grid")

# Substrings of a class or id that show a section's role, with its confidence, in the order tried.
ROLE_PATTERNS = (
    (("contact", "contact-us", "get-in-touch", "contact_us", "contactus"), "contact", 0.85),
    (("testimonial", "review", "client-say", "client_say", "reviews", "testimonials"), "testimonials", 0.85),
    (("pricing", "price", "plan", "plans", "pricing-table", "pricing_table"), "pricing", 0.85),
    (("team", "our-team", "staff", "our_team", "members"), "team", 0.85),
    (("faq", "frequently-asked", "faqs", "frequently_asked"), "faq", 0.85),
    (("blog", "news", "articles", "posts", "blog-feed", "blog_feed"), "blog_feed", 0.80),
    (("portfolio", "work", "projects", "gallery", "our-work", "our_work", "showcase"), "portfolio", 0.80),
    (("service", "services", "what-we-do", "what_we_do", "offerings"), "services", 0.80),
    (("about", "about-us", "who-we-are", "about_us", "who_we_are"), "about", 0.80),
    (("feature", "features", "feature-grid", "feature_grid"), "feature_grid", 0.80),
    (("cta", "call-to-action", "call_to_action"), "cta", 0.80),
    (("social", "social-media", "social-links", "social_links", "social_media"), "social_links", 0.80),
    (("hero", "banner", "jumbotron", "hero-section", "hero_section", "masthead"), "hero", 0.90),
    (("media-gallery", "media_gallery", "image-gallery", "photo-gallery"), "media_gallery", 0.80),
    (("sidebar", "side-bar", "side_bar"), "sidebar", 0.85),
)
ROLE_TAGS = {"nav": ("navigation", 0.95), "footer": ("footer", 0.95), "aside": ("sidebar", 0.85)}
ROLE_ARIA = {"navigation": ("navigation", 0.90), "contentinfo": ("footer", 0.85), "banner": ("hero", 0.85), "complementary": ("sidebar", 0.80)}
HERO_WORDS = ("hero", "banner", "jumbotron", "masthead")


def classify(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, top_idx, path, role, confidence, n_children): the section-level children of each root."""
    top = nodes.where((F.col("depth") == 1) & F.col("tag").isin(*SECTION_TAGS))
    names = F.filter(F.concat(F.split(F.lower(F.coalesce(attribute("class"), F.lit(""))), r"\s+"), F.array(F.lower(F.coalesce(attribute("id"), F.lit(""))))), lambda x: x != "")
    top = top.withColumns({"names": names, "aria": F.lower(F.coalesce(attribute("role"), F.lit("")))})
    found = lambda role, confidence: F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))
    has = lambda words: F.exists("names", lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: x.contains(w)))
    rule = F
    for tag, (role, confidence) in ROLE_TAGS.items():
        rule = rule.when(F.col("tag") == tag, found(role, confidence))
    rule = rule.when((F.col("tag") == "header") & has(HERO_WORDS), found("hero", 0.90)).when(F.col("tag") == "header", found("hero", 0.80))
    for aria, (role, confidence) in ROLE_ARIA.items():
        rule = rule.when(F.col("aria") == aria, found(role, confidence))
    for words, role, confidence in ROLE_PATTERNS:
        rule = rule.when(has(words), found(role, confidence))
    children = nodes.where("depth = 2").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    top = top.select("page_id", "node_id", "top_idx", "path", rule.otherwise(found("unknown", 0.0)).alias("r"))
    return top.join(children, ["page_id", "node_id"], "left").select("page_id", "node_id", "top_idx", "path", "r.role", "r.confidence", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def direct_text(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, text): each element's first text child with two characters and a letter or digit."""
    fit = nodes.where((F.col("tag") == "#text") & (F.length(F.trim("text_content")) >= 2) & F.col("text_content").rlike(r"[\p{L}\p{N}]"))
    return fit.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.min_by(F.trim("text_content"), "child_idx").alias("text"))


def slots(nodes: DataFrame, most: int | None = MOST_SLOTS) -> DataFrame:
    """(page_id, node_id, tag, top_idx, path, slot_id, slot_type, max_length, text): what can be replaced, numbered in page
    order; the first so many of each page, or all of them."""
    candidates = nodes.where((F.col("tag") == "img") | F.col("tag").isin(*TEXT_TAGS)).select("page_id", "node_id", "tag", "top_idx", "path", F.when(F.col("tag") == "img", attribute("src")).alias("src"))
    candidates = candidates.join(direct_text(nodes), ["page_id", "node_id"], "left")
    picture = (F.col("tag") == "img") & (F.coalesce("src", F.lit("")) != "")
    candidates = candidates.where(picture | ((F.col("tag") != "img") & F.col("text").isNotNull()))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    x = candidates.withColumn("n", n)
    x = x if most is None else x.where(F.col("n") <= most)
    return x.select(
        "page_id", "node_id", "tag", "top_idx", "path", F.format_string("slot_%s_%d", "tag", "n").alias("slot_id"), F.when(F.col("tag") == "img", "image").otherwise("text").alias("slot_type"),
        F.when(F.col("tag") != "img", F.greatest(F.lit(LEAST_LENGTH), F.length("text") * 2)).alias("max_length"),
        F.when(F.col("tag") == "img", F.col("src")).otherwise(F.col("text")).alias("text"),
    )


# What a slot is called by its element.
KINDS = {
    "h1": "Heading", "h2": "Heading", "h3": "Subheading", "h4": "Subheading", "h5": "Subheading", "h6": "Subheading", "p": "Text", "span": "Text", "a": "Link", "button": "Button", "li": "List Item",
    "img": "Image", "blockquote": "Quote", "figcaption": "Caption", "caption": "Caption", "label": "Label", "td": "Cell", "th": "Header Cell", "summary": "Summary", "cite": "Citation", "strong": "Text", "em": "Text",
}


def fields(nodes: DataFrame, most: int | None = MOST_SLOTS) -> DataFrame:
    """Form fields: each slot (of the first so many, or all) with its section's role, a label, a type and the state of its present content."""
    sections = classify(nodes).select("page_id", "top_idx", "role", "confidence")
    only = sections.groupBy("page_id").agg(F.count("*").alias("n"), F.first("role").alias("only_role"), F.first("confidence").alias("only_confidence")).where("n = 1").drop("n")
    x = slots(nodes, most).join(sections, ["page_id", "top_idx"], "left").join(only, "page_id", "left")
    role = F.coalesce("role", "only_role", F.lit("unknown"))
    kind = F.try_element_at(F.create_map(*(F.lit(v) for kv in KINDS.items() for v in kv)), F.col("tag"))
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    field_type = F.when(F.col("slot_type") == "image", "image").when(F.col("max_length") > 200, "textarea").otherwise("text")
    label = F.when(kind.isNotNull(), F.trim(F.concat(F.when(role == "unknown", "").otherwise(title(role)), F.lit(" "), kind))).otherwise(
        F.when(role == "unknown", title(F.col("slot_id"))).otherwise(F.concat(title(role), F.lit(" — "), title(F.col("slot_id"))))
    )
    x = x.select(
        "page_id", "node_id", "slot_id", "path", F.concat(role, F.lit("_"), "slot_id").alias("field_id"), label.alias("label"), field_type.alias("field_type"), role.alias("role"),
        F.coalesce("confidence", "only_confidence", F.lit(0.0)).alias("confidence"), F.col("text").alias("original_value"), "max_length",
    )
    return x.withColumn("p", placeholder.detect(F.col("original_value"), F.col("field_type"))).select(*x.columns, F.col("p.state").alias("content_state"), F.col("p.confidence").alias("placeholder_confidence"))


def shapes(nodes: DataFrame, top: int, levels: int) -> DataFrame:
    """(page_id, node_id, parent_id, shape) of the elements at depth top: the tags of their subtrees, so many levels deep.

    From the lowest level up: an element's shape is its tag and the shapes of its children in order, so that each level is
    one grouping by parent and one join by element, whatever the number of elements of a page."""
    elements = nodes.where("tag <> '#text'").select("page_id", "node_id", "parent_id", "depth", "tag")
    below = None
    for depth in reversed(range(top, top + levels)):
        here = elements.where(F.col("depth") == depth).drop("depth")
        if below is None:
            below = here.select("page_id", "node_id", "parent_id", F.col("tag").alias("shape"))
            continue
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "shape"))), lambda s: s["shape"]), ",")
        inner = below.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(ordered.alias("inner"))
        below = here.join(inner, ["page_id", "node_id"], "left").select("page_id", "node_id", "parent_id", F.concat("tag", F.coalesce(F.concat(F.lit("("), "inner", F.lit(")")), F.lit(""))).alias("shape"))
    return below


def repeats(nodes: DataFrame) -> DataFrame:
    """(page_id, top_idx, role, instances): children of repeatable sections that have the most frequent skeleton, the tags
    of a subtree, four levels deep."""
    sections = classify(nodes).where(F.col("role").isin(*REPEATABLE)).select("page_id", F.col("node_id").alias("section"), "top_idx", "role", "n_children")
    counts = shapes(nodes, 2, 4).groupBy("page_id", F.col("parent_id").alias("section"), "shape").agg(F.count("*").alias("n"))
    counts = counts.groupBy("page_id", "section").agg(F.max("n").alias("most"), F.sum("n").alias("items"))
    instances = F.when(F.col("n_children") < 2, F.col("n_children")).when(F.col("most") >= 2, F.col("most")).otherwise(F.coalesce("items", F.lit(0)))
    return sections.join(counts, ["page_id", "section"], "left").select("page_id", "top_idx", "role", instances.alias("instances"))


def orphaned_anchors(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, target): links to an id that the page doesn't have."""
    links = nodes.where("tag = 'a'").select("page_id", "node_id", F.regexp_extract(attribute("href"), "^#([^/]+)", 1).alias("target")).where("target <> ''")
    ids = nodes.select("page_id", attribute("id").alias("target")).where("target is not null").distinct()
    return links.join(ids, ["page_id", "target"], "left_anti").select("page_id", "node_id", "target")


# Hints in class names.
DROPDOWN, SUBMENU, CAROUSEL = ("dropdown", "has-submenu", "menu-item-has-children", "has-children"), ("dropdown-menu", "sub-menu", "submenu"), ("carousel", "slider", "swiper", "slideshow", "glide", "splide")


def interactive(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, kind): disclosures, dropdowns, tab groups and carousels that need no script to be restored."""
    x = nodes.withColumns({"class": F.lower(F.coalesce(attribute("class"), F.lit(""))), "role": F.lower(F.coalesce(attribute("role"), F.lit(""))), "id": attribute("id"), "controls": attribute("aria-controls")})
    x = checkpointed(x.select("page_id", "node_id", "parent_id", "subtree_end", "tag", "class", "role", "id", "controls", attribute("aria-expanded").alias("expanded")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("class").contains(w))
    out = lambda df, kind: df.select("page_id", "node_id", F.lit(kind).alias("kind"))
    triggers = x.where(F.col("expanded").isin("true", "false") & F.col("controls").isNotNull())
    siblings = x.where("id is not null").select("page_id", "parent_id", F.col("id").alias("controls"), F.col("node_id").alias("other"))
    disclosures = triggers.join(siblings, ["page_id", "parent_id", "controls"]).where("node_id <> other").select("page_id", "node_id").distinct()
    menus = x.where(F.col("tag").isin("ul", "ol") | (F.col("role") == "menu") | any_of(SUBMENU)).select("page_id", F.col("parent_id").alias("node_id")).distinct()
    dropdowns = x.where(any_of(DROPDOWN)).join(menus, ["page_id", "node_id"], "left_semi")
    lists = x.where("role = 'tablist'").select("page_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("list"), F.col("subtree_end").alias("list_end"))
    groups = lists.join(x.select("page_id", "node_id", "subtree_end"), ["page_id", "node_id"])
    tabs = groups.join(x.where("role = 'tab'").select("page_id", F.col("node_id").alias("tab"), "controls"), "page_id").where("tab > list and tab <= list_end")
    panels = x.where("role = 'tabpanel'").select("page_id", F.col("node_id").alias("panel"), F.col("id").alias("controls"))
    linked = tabs.join(panels, ["page_id", "controls"]).where("panel > node_id and panel <= subtree_end").groupBy("page_id", "node_id").agg(F.countDistinct("tab").alias("n")).where("n >= 2")
    children = x.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n >= 2")
    carousels = x.where(any_of(CAROUSEL)).join(children, ["page_id", "node_id"], "left_semi")
    return out(disclosures, "disclosure").unionByName(out(dropdowns, "dropdown")).unionByName(out(linked, "tabs")).unionByName(out(carousels, "carousel"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"), F.count_if(F.col("tag") == "#text").alias("n_texts"))


def flatten(nodes: DataFrame) -> DataFrame:
    """(page_id, path, value) of every tag, attribute and text, for comparing versions."""
    entries = F.concat(
        F.array(F.struct(F.concat("path", F.lit(":tag")).alias("path"), F.col("tag").alias("value"))),
        F.transform("attrs", lambda a: F.struct(F.concat(F.col("path"), F.lit(".attributes."), a["k"]).alias("path"), a["v"].alias("value"))),
        F.when(F.col("text_content").isNotNull(), F.array(F.struct(F.concat("path", F.lit(".text")).alias("path"), F.col("text_content").alias("value")))).otherwise(F.array().cast("array<struct<path:string,value:string>>")),
    )
    return nodes.select("page_id", F.inline(entries))


def substitute(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """nodes with changes(page_id, path, value) applied: to the first text below an element, or to a picture's src."""
    tree = [c for c in ("page_id", "host_id") if c in nodes.columns]
    after = Window.partitionBy(*tree).orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)
    next_text = F.last(F.when(F.col("tag") == "#text", F.col("node_id")), ignorenulls=True).over(after)
    places = nodes.select("page_id", "path", F.col("node_id").alias("t"), F.col("subtree_end").alias("e"), F.col("tag").alias("target_tag"), next_text.alias("node_id"))
    targets = changes.join(places, ["page_id", "path"])
    first = targets.where("target_tag <> 'img' and node_id <= e").select("page_id", "t", "node_id", F.col("value").alias("new_text")).distinct().drop("t")
    pictures = targets.where("target_tag = 'img'").select("page_id", F.col("t").alias("node_id"), F.col("value").alias("new_src"))
    x = nodes.join(first, ["page_id", "node_id"], "left").join(pictures, ["page_id", "node_id"], "left")
    src = lambda a: F.when(F.col("new_src").isNotNull() & (a["k"] == "src"), F.struct(a["k"].alias("k"), F.col("new_src").alias("v"))).otherwise(a)
    return x.withColumns({"text_content": F.coalesce("new_text", "text_content"), "attrs": F.transform("attrs", src)}).select(*nodes.columns)


def without_sections(nodes: DataFrame, removed: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """nodes without the subtrees at removed(page_id, path), and without menu entries that lead to an id in them; the
    children that stay are numbered anew (child_idx). What goes is looked up in `of`, nodes themselves or a table at hand
    with the same paths, ids and links."""
    of = nodes if of is None else of
    gone = located(of, removed).where("depth > 0").select("page_id", F.col("node_id").alias("a"), F.col("subtree_end").alias("b"))
    ids = of.select("page_id", "node_id", F.concat(F.lit("#"), attribute("id")).alias("href")).where("href is not null").join(gone, "page_id").where("node_id between a and b").select("page_id", "href")
    entries = of.where("tag = 'a'").select("page_id", "parent_id", attribute("href").alias("href")).join(ids, ["page_id", "href"], "left_semi").select("page_id", F.col("parent_id").alias("node_id"))
    menus = of.where("tag = 'li'").join(entries, ["page_id", "node_id"], "left_semi").select("page_id", F.col("node_id").alias("a"), F.col("subtree_end").alias("b"))
    out = nodes.alias("n").join(gone.unionByName(menus).alias("g"), (F.col("n.page_id") == F.col("g.page_id")) & (F.col("n.node_id") >= F.col("g.a")) & (F.col("n.node_id") <= F.col("g.b")), "left_anti")
    order = F.row_number().over(Window.partitionBy("page_id", "parent_id").orderBy("node_id"))
    return out.withColumn("child_idx", order)


def read_only(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """(page_id, path): sections of a known role that no field of their page has."""
    roles = fields.select("page_id", "role").distinct()
    return classify(nodes).where("role <> 'unknown'").join(roles, ["page_id", "role"], "left_anti").select("page_id", "path")


def to_confirm(fields: DataFrame) -> DataFrame:
    """(page_id, field_id): fields of which nobody knows whether their content is real."""
    return fields.where(F.col("content_state") == placeholder.STATES[2]).select("page_id", "field_id")


def names(nodes: DataFrame) -> DataFrame:
    """(page_id, kind, name): ids, trimmed, and class tokens, in lower case, of each page; each once."""
    ids = nodes.select("page_id", F.lit("id").alias("kind"), F.trim(attribute("id")).alias("name"))
    classes = nodes.select("page_id", F.lit("class").alias("kind"), F.explode(F.split(F.lower(attribute("class")), r"\s+")).alias("name"))
    return ids.unionByName(classes).where("name <> ''").distinct()


def attach_shadows(nodes: DataFrame, shadows: DataFrame) -> DataFrame:
    """nodes with the trees of shadows(page_id, host, ...nodes of the shadow tree), each below the node at that css_path,
    and host_id: the node that a shadow node belongs to (null in the page's own tree). Depths go on from the host; the
    shadow's own numbers stay, as they name nodes within it."""
    hosts = nodes.select("page_id", F.col("css_path").alias("host"), F.col("node_id").alias("host_id"), F.col("depth").alias("host_depth"))
    inner = shadows.join(hosts, ["page_id", "host"]).withColumn("depth", F.col("depth") + F.col("host_depth") + 1)
    return nodes.withColumn("host_id", F.lit(None).cast("int")).unionByName(inner.select(*nodes.columns, "host_id"))


def with_interactions(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(page_id, node_id, tag, change) of records(page_id, css_path, change): what was recorded, at the node it was recorded
    on. Where a path is recorded twice the last of its changes, in order of their text, counts."""
    last = records.groupBy("page_id", "css_path").agg(F.max("change").alias("change"))
    return nodes.join(last, ["page_id", "css_path"]).select("page_id", "node_id", "tag", "change")


# What can be clicked.
CLICKABLE_TAGS, CLICKABLE_ROLES = ("a", "button", "summary", "select", "input"), ("button", "link", "tab", "menuitem")


def clickable(nodes: DataFrame) -> DataFrame:
    """Nodes that a visitor can act on, by element, role or handler."""
    return nodes.where(F.col("tag").isin(*CLICKABLE_TAGS) | F.coalesce(attribute("role").isin(*CLICKABLE_ROLES), F.lit(False)) | attribute("tabindex").isNotNull())
