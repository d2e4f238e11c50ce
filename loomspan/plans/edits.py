"""Queries over submissions, edits and what follows them: files, prompts, generated styles, templates, robots, telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import prompts
from loomspan.operators import ingest, markup, nodes, sections, styles, versions, workflows
from loomspan.plans.rasters import TOLERANCE
from loomspan.plans.registry import query
from loomspan.plans.workflows import _DUCK_SITE, duck_crawl
from loomspan.session import checkpointed, table
from loomspan.streaming.telemetry import queued

#: Each document as one of six kinds of submission, by its number; every seventh isn't base64.
_KINDS = "case doc_id % 6 when 0 then 'text' when 1 then 'document' when 2 then 'image' when 3 then 'video' when 4 then 'audio' else 'document' end"


@query("submission_files", f"""select doc_id as id, kind, case when kind = 'text' then null when doc_id % 7 = 0 then 'not base64' when kind = 'document' and strlen(t) = 0 then 'empty' when kind = 'video' and doc_id % 2 = 0 then 'unsupported format' end as problem,
  case when kind = 'text' or doc_id % 7 = 0 or (kind = 'document' and strlen(t) = 0) then null when kind = 'image' then 'png' when kind = 'video' then 'mp4' when kind = 'audio' then 'wav' when doc_id % 6 = 1 then 'md' else 'txt' end as ext,
  case when kind = 'text' or doc_id % 7 = 0 or (kind = 'document' and strlen(t) = 0) then null when kind = 'image' then 24 when kind = 'video' or kind = 'audio' then 12 else strlen(t) end::int as file_size,
  case when kind = 'image' and doc_id % 7 > 0 then (1 + doc_id % 50)::int end as width, case when kind = 'image' and doc_id % 7 > 0 then case when (1 + doc_id % 50) / 20.0 > 1.05 then 'landscape' when (1 + doc_id % 50) / 20.0 < 0.95 then 'portrait' else 'square' end end as orientation,
  case when kind = 'document' and doc_id % 7 > 0 and strlen(t) > 0 then least(length(t), {ingest.MOST_TEXT}) end::int as n_chars from (select doc_id, coalesce(text, '') as t, {_KINDS} as kind from documents)""")
def submission_files(spark, sf_dir):
    """Submitted values of all kinds, dispatched by kind: what each file is, and what is wrong with those that can't be taken."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.expr(_KINDS).alias("kind"))
    width = F.lpad(F.hex(1 + F.col("doc_id") % 50), 8, "0")
    data = (
        F.when(F.col("kind") == "image", F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), width, F.lit("00000014")))).when(F.col("kind") == "video", F.unhex(F.lit("000000186674797069736F6D")))
        .when(F.col("kind") == "audio", F.unhex(F.lit("524946460000000057415645"))).otherwise(F.col("t").cast("binary"))
    )
    payload = F.when(F.col("kind") == "text", F.col("t")).when(F.col("doc_id") % 7 == 0, F.lit("?!")).when(F.col("doc_id") % 6 == 1, F.concat(F.lit("data:text/plain;base64,"), F.base64(data))).otherwise(F.base64(data))
    name = F.concat(F.lit("my_file-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 6 == 1, ".md").otherwise(""))
    out = ingest.ingest(x.select(F.col("doc_id").alias("id"), "kind", payload.alias("payload"), name.alias("filename")))
    chars = F.when(F.col("kind") == "document", F.length("text"))
    return out.select("id", "kind", "problem", "ext", "file_size", "width", "orientation", chars.alias("n_chars"))


def _put(*pieces: str, page: str = "html") -> str:
    """Pieces of markup, some of them expressions over page_id, put at the end of a page's body."""
    return f"concat(replace(replace({page}, '</body>', ''), '</html>', ''), {', '.join(pieces)}, '</body></html>')"


#: A row of boxes after the article: numbered, spaced, in a grid, with a link to the second. Some pages have broken ones.
_BOXES = _put(
    """'<div class="row" style="display:grid;grid-template-columns:repeat(3, 1fr);padding:', page_id % 7, 'px">'""",
    """'<section id="a" data-section-index="1" style="margin-bottom:8px">one</section><section id="b" data-section-index="2" style="order:1">two</section><section data-section-index="3" style="order:2">three</section></div>'""",
    """'<ul><li><a href="#b">to two</a></li></ul>'""",
    page="""replace(html, '<p>', '<p data-slot-id="text">')""",
)
#: The same as an editor might leave it: on some pages the second box is gone but what depended on it is not put right.
_EDITED = _put(
    """'<div class="row" style="display:grid;grid-template-columns:repeat(', case when page_id % 6 = 5 then 0 else 3 end, ', 1fr);padding:', case when page_id % 5 = 1 then page_id % 7 + 1 else page_id % 7 end, 'px">'""",
    """'<section id="a" data-section-index="1" style="margin-bottom:8px">one</section><section data-section-index="', case when page_id % 3 = 0 then 2 else 3 end, '" style="order:', case when page_id % 4 = 0 then 2 else 1 end, '">three</section></div>'""",
    """repeat('<p><a href="#b">to two</a></p>', cast(page_id % 3 as int)), '<div style="display:inline-grid">', case when page_id % 2 = 0 then 'x' else '' end, '</div>'""",
    page="""replace(html, '<p>', '<p data-slot-id="text">')""",
)


@query("page_edit_violations", r"""with p as (select page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>')) as paragraphs from pages)
  select * from (select page_id, unnest(['no_orphaned_nav_entries', 'no_empty_grid_cells', 'contiguous_section_ordering', 'spacing_scale_invariance', 'no_dangling_slot_references']) as rule,
  unnest([page_id % 3, page_id % 2 + (page_id % 6 = 5)::bigint, (page_id % 3 > 0)::bigint + (page_id % 4 = 0)::bigint, (page_id % 5 = 1)::bigint, case when page_id % 2 = 1 then paragraphs else 0 end::bigint]) as n from p) where n > 0""")
def page_edit_violations(spark, sf_dir):
    """What careless edits of each page broke, by rule: a box that went without its menu entry and numbers, new spacing,
    grids left empty, and articles that were to go but, on every other page, stay with their slots."""
    pages = table(spark, sf_dir, "pages")
    before = checkpointed(nodes.parse_html(pages.select("page_id", F.expr(_BOXES).alias("html"))))
    after = nodes.parse_html(pages.select("page_id", F.expr(_EDITED).alias("html")))
    after = checkpointed(after.where("page_id % 2 = 1 or path not like 'root > article:%'"))
    removed = before.where("depth = 1 and tag = 'article'").select("page_id", "path")
    return versions.violations(before, after, removed).groupBy("page_id", "rule").agg(F.count("*").alias("n"))


#: What stops a page from losing more: a link outside a menu, a box that empties its grid, or spacing that is moved from an
#: element whose own is another. The menu goes first, then the one box of the grid, then the footer.
_CHAIN = _put(
    """'<div style="display:grid">', case when page_id % 4 = 0 then '' else '<b>x</b>' end, '<section id="box"></section></div>', case when page_id % 5 = 0 then '<p><a href="#box">x</a></p>' else '<ul><li><a href="#box">x</a></li></ul>' end""",
    """'<i style="margin-bottom:0px">i</i><form style="margin-bottom:', page_id % 3, 'px">f</form><u>u</u>'""",
)


@query("page_sections_removed", """select page_id, case when page_id % 4 = 0 or page_id % 5 = 0 then 2 else 3 end as applied, page_id % 4 > 0 and page_id % 5 > 0 as passed,
  (page_id % 5 = 0)::bigint as links, case when page_id % 4 = 0 or page_id % 5 = 0 then '0px' else case when page_id % 3 = 0 then '0px' else (page_id % 3) || 'px' end end as margin from pages""")
def page_sections_removed(spark, sf_dir):
    """Menu, box and form removed in turn: a page stops where a link to the box is left over or its grid is left empty; where
    the form goes its margin moves to the element before it."""
    tree = checkpointed(nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(_CHAIN).alias("html"))))
    tree = checkpointed(versions.with_slots(tree).select("page_id", "node_id", "parent_id", "depth", "subtree_end", "child_idx", "tag", "path", "attrs"))
    step = F.when((F.col("tag") == "nav") & (F.col("depth") == 1), 1).when(nodes.attribute("id") == "box", 2).when(F.col("tag") == "form", 3)
    removals = tree.select("page_id", step.alias("step"), "path", "node_id").where("step is not null")
    left, done = workflows.remove_sections(tree, removals, versions.violations)
    links = left.where("tag = 'a'").where(nodes.attribute("href") == "#box").groupBy("page_id").agg(F.count("*").alias("links"))
    margins = versions.inline_styles(left.where("tag = 'i'")).where("prop = 'margin-bottom'").select("page_id", F.col("value").alias("margin"))
    return done.join(links, "page_id", "left").join(margins, "page_id", "left").select("page_id", "applied", "passed", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "margin")


#: Boxes of one inline style, some of them, a text to be replaced, and a part with a style for its hover.
_COMPILED = _put("""repeat('<div style="color:red">a</div>', cast(page_id % 4 as int)), '<p data-slot-id="greeting">old words</p><a id="more" class="own">more</a>'""")
_HAS_SHADOW = "(page_id % 3 = 0 and contains(html, '<footer>'))::bigint"


@query("page_compiled_document", rf"""select page_id, {_HAS_SHADOW} as templates, {_HAS_SHADOW} * (page_id % 4) as shadow_parts, 1::bigint as injected, case when page_id % 4 > 1 then page_id % 4 else 0 end as minted,
  1 + len(regexp_extract_all(html, '<p[\s>]'))::bigint as paragraphs, concat(case when page_id % 4 > 1 then '.style-1 {{ color:red }}' || chr(10) else '' end, '.gen-r1:hover {{ top: ', page_id % 7, 'px }}') as css, concat('Page ', page_id) as title from pages""")
def page_compiled_document(spark, sf_dir):
    """Standalone documents: shadow roots as templates, a value in its slot, and classes for styles that repeat or can't be
    inline. What each holds is counted in the markup."""
    pages = table(spark, sf_dir, "pages")
    tree = nodes.parse_html(pages.select("page_id", F.expr(_COMPILED).alias("html")))
    inner = nodes.parse_html(pages.where("page_id % 3 = 0").select("page_id", F.expr("concat('<body>', repeat('<b>s</b>', cast(page_id % 4 as int)), '</body>')").alias("html")))
    tree = checkpointed(sections.attach_shadows(tree, inner.withColumn("host", F.lit("body:nth-of-type(1) > footer:nth-of-type(1)"))))
    values = pages.select("page_id", F.lit("greeting").alias("slot_id"), F.concat(F.lit("Hello "), F.col("page_id").cast("string")).alias("value"))
    more = tree.where(nodes.attribute("id") == "more").select("page_id", "node_id", F.lit(":hover").alias("state"), F.lit("top").alias("prop"), F.concat((F.col("page_id") % 7).cast("string"), F.lit("px")).alias("value"), F.lit(1).alias("ord"))
    nothing = more.where("false").withColumn("media", F.lit("")).drop("state")
    documents = markup.compile_document(tree, pages.select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title")), nothing, more, pages.where("false").select("page_id", F.lit(1).alias("ord"), F.lit("").alias("rule")), values)
    count = lambda pattern: F.regexp_count("html", pattern).cast("long")
    return documents.select(
        "page_id", count(F.lit('<template shadowrootmode="open">')).alias("templates"), count(F.lit("<b>s</b>")).alias("shadow_parts"), count(F.concat(F.lit('<p data-slot-id="greeting">Hello '), F.col("page_id").cast("string"), F.lit("</p>"))).alias("injected"),
        count(F.lit('<div class="style-1">a</div>')).alias("minted"), count(F.lit("</p>")).alias("paragraphs"), F.regexp_extract("html", "(?s)<style>\n(.*)\n</style>", 1).alias("css"), F.regexp_extract("html", "<title>(.*)</title>", 1).alias("title"),
    )


_JSX = _put("""repeat(concat('<p style="margin-top: ', page_id % 9, 'px; color:red; width: expression(1); -webkit-box-flex: 1; --gap: 2px; background: url(javascript:x)">x<br></p>'), cast(page_id % 3 as int)), '<label for="a" class="k">l</label>'""")


@query("page_jsx_styles", """select page_id, array_to_string(list_transform(range(page_id % 3), lambda i: concat('{"marginTop": "', page_id % 9, 'px", "color": "red", "WebkitBoxFlex": "1", "--gap": "2px"}')), ' ') as styles, 1::bigint as labels, page_id % 3 + len(regexp_extract_all(html, '<br'))::bigint as breaks from pages""")
def page_jsx_styles(spark, sf_dir):
    """Component text of each page: its style objects, renamed attributes and closed void elements."""
    jsx = markup.compile_jsx(nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(_JSX).alias("html"))))
    found = F.array_join(F.regexp_extract_all("jsx", F.lit(r"style=\{(\{[^}]*\})\}"), F.lit(1)), " ")
    return jsx.select("page_id", found.alias("styles"), F.regexp_count("jsx", F.lit('<label htmlFor="a" className="k">')).cast("long").alias("labels"), F.regexp_count("jsx", F.lit("<br />")).cast("long").alias("breaks"))


@query("page_read_only_sections", "select page_id, 'footer' as tag from pages where contains(html, '<footer>')")
def page_read_only_sections(spark, sf_dir):
    """Sections of a known role that have nothing to fill in."""
    tree = checkpointed(nodes.parse_html(table(spark, sf_dir, "pages")))
    found = sections.read_only(tree, sections.fields(tree))
    return found.join(tree.select("page_id", "path", "tag"), ["page_id", "path"]).select("page_id", "tag")


@query("page_fields_to_confirm")
def page_fields_to_confirm(spark, sf_dir):
    return sections.to_confirm(sections.fields(checkpointed(nodes.parse_html(table(spark, sf_dir, "pages")))))


_NAMED = """replace(html, '<footer>', concat('<footer id=" i', page_id % 5, ' " class="Foot b', page_id % 3, '  Foot">'))"""


@query("page_names", """select page_id, 'id' as kind, concat('i', page_id % 5) as name from pages where contains(html, '<footer>') union all select page_id, 'class', unnest(['foot', concat('b', page_id % 3)]) from pages where contains(html, '<footer>')
  union all select page_id, 'class', 'ad' from pages where contains(html, 'class="ad"')""")
def page_names(spark, sf_dir):
    """Ids and class tokens of each page."""
    return sections.names(nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(_NAMED).alias("html"))))


_HOVERED = "concat('<style>h1:hover{color:blue;width:expression(1)}@media (max-width:', 400 + page_id % 3, 'px){h1{color:red;margin:', page_id % 4, 'px}footer{top:0}}</style>', html)"


@query("page_generated_styles", """select page_id, concat('@font-face{src:url("assets/f', page_id % 2, '.woff")}', chr(10), '.gen-r1:hover { color: blue }', chr(10), '@media (max-width:', 400 + page_id % 3, 'px) {', chr(10), '  .gen-r1 { color: red; margin: ', page_id % 4, 'px }', chr(10), '  .gen-r2 { top: 0 }', chr(10), '}') as css from pages""")
def page_generated_styles(spark, sf_dir):
    """The sheet of classes that stand for hover and media rules of nodes, with a global rule whose file is in assets/."""
    pages = table(spark, sf_dir, "pages")
    matched = checkpointed(styles.match(pages.select("page_id", F.expr(_HOVERED).alias("html"), F.lit("").alias("css"))))
    ordered = lambda df: df.withColumn("ord", F.col("prop"))
    media = ordered(styles.responsive(matched)).withColumn("media", F.regexp_replace("media", r"^@?media\s*|^", "@media "))
    rules = pages.select("page_id", F.lit(1).alias("ord"), F.concat(F.lit('@font-face{src:url("f'), (F.col("page_id") % 2).cast("string"), F.lit('.woff")}')).alias("rule"))
    return styles.generated_styles(media, ordered(styles.states(matched)), rules)[1]


@query("page_transformation_prompt", f"""select page_id, url as source_url, case when page_id % 4 = 0 then 'Calm and wide.' else '{prompts.NO_MODEL}' end as design_summary, case when page_id % 2 > 0 then '{prompts.NO_CHANGES}' else '{prompts.NO_MODEL}' end as substitution_summary,
  case when page_id % 2 = 0 then 2 else 0 end as n_substitutions, case when page_id % 2 = 0 then least(4000, 40 * (page_id % 200)) else 0 end as n_document, 5 as n_notes from pages""")
def page_transformation_prompt(spark, sf_dir):
    """What a model would be asked for each page: its changes, cut documents, and fixed texts where no model has answered."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    text = F.repeat(F.lit("forty characters of a document's text.\n "), (F.col("page_id") % 200).cast("int"))
    two = F.array(F.struct(F.lit("a").alias("field_id"), F.lit("text").alias("kind"), F.lit("").alias("extracted_text")), F.struct(F.lit("b").alias("field_id"), F.lit("document").alias("kind"), text.alias("extracted_text")))
    changes = pages.where("page_id % 2 = 0").select("page_id", F.inline(two)).select("page_id", "field_id", F.lit("hero").alias("role"), F.lit("old").alias("original_value"), F.lit("new").alias("value"), "kind", "extracted_text", F.array(F.lit("h")).alias("headings"))
    answers = pages.where("page_id % 4 = 0").select("page_id", F.lit("design").alias("topic"), F.lit("Calm and wide.").alias("answer"))
    x = prompts.transformation_prompts(pages, changes, answers)
    longest = F.coalesce(F.array_max(F.transform("substitutions", lambda s: F.length(s["document_text"]))), F.lit(0))
    return x.select("page_id", "source_url", "design_summary", "substitution_summary", F.size("substitutions").alias("n_substitutions"), longest.cast("long").alias("n_document"), F.size("notes").alias("n_notes"))


@query("page_interactions", "select page_id, 'nav' as tag, concat('color:', page_id % 3) as change from pages where page_id % 2 = 0 and contains(html, '<nav>')")
def page_interactions(spark, sf_dir):
    """Recorded style changes at the nodes that they were recorded on; records of paths that aren't there fall away."""
    pages = table(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 2 == 0, "body:nth-of-type(1) > nav:nth-of-type(1)").otherwise("#none")
    records = pages.select("page_id", path.alias("css_path"), F.concat(F.lit("color:"), (F.col("page_id") % 3).cast("string")).alias("change"))
    return sections.with_interactions(nodes.parse_html(pages), records).select("page_id", "tag", "change")


@query("page_shadow_trees", "select page_id, 'footer' as host, (1 + 2 * (page_id % 4)) as n_nodes, (case when page_id % 4 > 0 then 4 else 2 end) as deepest from pages where page_id % 3 = 0 and contains(html, '<footer>')")
def page_shadow_trees(spark, sf_dir):
    """Shadow trees below their hosts: nodes and depth of each."""
    pages = table(spark, sf_dir, "pages")
    tree = nodes.parse_html(pages)
    inner = nodes.parse_html(pages.where("page_id % 3 = 0").select("page_id", F.expr("concat('<body>', repeat('<b>s</b>', cast(page_id % 4 as int)), '</body>')").alias("html")))
    all_ = sections.attach_shadows(tree, inner.withColumn("host", F.lit("body:nth-of-type(1) > footer:nth-of-type(1)")))
    hosts = tree.select("page_id", F.col("node_id").alias("host_id"), F.col("tag").alias("host"))
    return all_.where("host_id is not null").join(hosts, ["page_id", "host_id"]).groupBy("page_id", "host").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("deepest"))


@query("page_clickable", r"select page_id, len(regexp_extract_all(html, '<(a|button|summary|select|input)[\s>]'))::bigint as n from pages")
def page_clickable(spark, sf_dir):
    """How much of each page can be clicked."""
    found = sections.clickable(nodes.parse_html(table(spark, sf_dir, "pages"))).groupBy("page_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("robots_rules", "select page_id as site, unnest(['/p', concat('/x', page_id % 3)]) as prefix from pages where page_id % 2 = 0 union all select page_id, '/y' from pages where page_id % 2 = 1")
def robots_rules(spark, sf_dir):
    """What robots files forbid every agent; rules for others, comments and empty rules don't count."""
    even = F.concat(F.lit("# all\nUser-agent: a\nUser-agent: *\nDisallow: /p # private\nDisallow: /x"), (F.col("page_id") % 3).cast("string"), F.lit("\n\nUser-agent: b\nDisallow: /"))
    odd = F.lit("User-agent: b\r\nDisallow: /\r\nuser-agent: *\r\nAllow: /\r\nDISALLOW: /y\r\nDisallow:\r\n")
    return workflows.robots_rules(table(spark, sf_dir, "pages").select(F.col("page_id").alias("site"), F.when(F.col("page_id") % 2 == 0, even).otherwise(odd).alias("text")))


#: The robots file of each page's site, by the page's number: some paths are closed to all, or only to others.
_ROBOTS_TEXT = "case page_id % 3 when 0 then concat('User-agent: *', chr(10), 'Disallow: /a', chr(10), 'Disallow: /e # all of it') when 1 then concat('User-agent: *', chr(10), 'Disallow: /t', substr(md5(url), 1, 1)) else concat('User-agent: other', chr(10), 'Disallow: /') end"


@query("crawl_allowed", duck_crawl(f"""not exists (select 1 from pages p where {_DUCK_SITE.format('p.url')} = {_DUCK_SITE.format('target')} and
  (p.page_id % 3 = 0 and (substr(target, 1 + length({_DUCK_SITE.format('target')}), 2) in ('/a', '/e')) or p.page_id % 3 = 1 and substr(target, 1 + length({_DUCK_SITE.format('target')}), 3) = '/t' || substr(md5(p.url), 1, 1)))"""))
def crawl_allowed(spark, sf_dir):
    """The crawls of all pages without what the robots files of their sites forbid."""
    from loomspan.plans.pages import links

    pages = table(spark, sf_dir, "pages")
    robots = pages.select(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1).alias("site"), "page_id", F.expr(_ROBOTS_TEXT).alias("text"))
    rules = workflows.robots_rules(robots.select(F.struct("site", "page_id").alias("site"), "text")).select("site.site", "prefix")
    return workflows.crawl(links(spark, sf_dir), pages.select(F.col("page_id").alias("root"), "url"), disallowed=rules)


def _designs(spark, sf_dir):
    tokens = F.create_map(F.lit("base"), F.col("p_type"), F.lit("size"), F.concat(F.col("p_size").cast("string"), F.lit("px")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("template_id"), F.col("p_name").alias("url"), F.col("p_partkey").alias("at"), tokens.alias("tokens"))


@query("template_versions", "select p_brand as template_id, row_number() over (partition by p_brand order by p_partkey) as version, p_type as base, p_type as shown_base, concat(p_size, 'px') as shown_size from part")
def template_versions(spark, sf_dir):
    """Versions of each template's tokens, and the values that their previews show."""
    versions_ = workflows.template_step(_designs(spark, sf_dir), prompts.preview)[2]
    shown = lambda name: F.regexp_extract("preview", f"--color-{name}:([^;]*);", 1)
    return versions_.select("template_id", F.col("version").cast("long").alias("version"), F.col("tokens")["base"].alias("base"), shown("base").alias("shown_base"), shown("size").alias("shown_size"))


@query("template_tokens", "select p_brand as template_id, arg_max(p_type, p_partkey) as base from part group by 1")
def template_tokens(spark, sf_dir):
    """The stored tokens of each template: the latest put."""
    return workflows.template_step(_designs(spark, sf_dir), prompts.preview)[1].select("template_id", F.col("tokens")["base"].alias("base"))


@query("event_telemetry", "select event_id from (select event_id, row_number() over (partition by event_type, date_trunc('day', ts) order by event_id) as place from events) where place <= 50")
def event_telemetry(spark, sf_dir):
    """What a queue of fifty for each kind of event takes in a day; the rest is dropped."""
    x = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("client"), F.col("event_id").alias("seq"), F.date_trunc("day", "ts").alias("day"))
    return queued(x, ["day"], 50).select("event_id")


@query("raster_compare", f"""select vec_id, same, (same or similarity >= 99) as strict, similarity >= 5 as normalized from (select a.vec_id, array_to_string(list_transform(a.embedding, lambda x: case when x::double >= list_avg(a.embedding) then '1' else '0' end), '') = array_to_string(list_transform(b.embedding, lambda x: case when x::double >= list_avg(b.embedding) then '1' else '0' end), '') as same,
  list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: case when abs(p[1]::double - p[2]::double) <= {TOLERANCE} then 100.0::double else 0.0::double end)) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)""")
def raster_compare(spark, sf_dir):
    """Two renders: alike by hash or by pixels (strict), or by enough of their pixels (normalized)."""
    from loomspan.plans import rasters

    bits = rasters.average_hash_bits(spark, sf_dir)
    similar = rasters.pixel_fidelity(spark, sf_dir).select("vec_id", "similarity")
    other = bits.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    x = bits.join(other, "vec_id").join(similar, "vec_id").withColumn("same", F.col("bits") == F.col("other"))
    return x.select("vec_id", "same", (F.col("same") | (F.col("similarity") >= 99)).alias("strict"), (F.col("similarity") >= 5).alias("normalized"))


@query("order_due_dates", "select o_orderkey, strftime(o_orderdate::date + interval 30 day, '%Y-%m-%d') as due, date_diff('day', o_orderdate::date, date '2000-01-01')::int as age from orders")
def order_due_dates(spark, sf_dir):
    """Dates moved by an interval, and days between dates."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("due"), F.date_diff(F.lit("2000-01-01").cast("date"), day).alias("age"))


#: A box in each notation of a page's first colour, and one in another's.
_BRANDED = _put("""'<p style="color: #', substr(md5(url), 1, 6), '; margin:0">a</p><p style="background: rgb(', page_id % 256, ', 7, 9)">b</p><p style="border: 1px solid #', substr(md5(url), 1, 6), '">c</p>'""")


@query("page_brand_applied", r"""with p as (select page_id, substr(md5(url), 7, 6) as accent, page_id % 3 > 0 as known from pages)
  select page_id, 1 + known::bigint as colors_remapped, concat('color: #0', page_id % 10, 'aa', 10 + page_id % 90, '; margin: 0') as first, case when known then concat('background: rgb(', ('0x' || substr(accent,1,2))::int, ', ', ('0x' || substr(accent,3,2))::int, ', ', ('0x' || substr(accent,5,2))::int, ')')
  else concat('background: rgb(', page_id % 256, ', 7, 9)') end as second, 2::int + (page_id % 4)::int as version from p""")
def page_brand_applied(spark, sf_dir):
    """Pages in the colours of a brand: styles remapped in their notation, compiled anew, and the next version of each."""
    from loomspan.operators import brand

    pages = table(spark, sf_dir, "pages")
    tree = nodes.parse_html(pages.select("page_id", F.expr(_BRANDED).alias("html")))
    palette = lambda *pairs: pages.select("page_id", F.inline(F.array(*(F.struct(F.lit(role).alias("role"), F.expr(c).alias("color")) for role, c in pairs))))
    old = palette(("primary", "concat('#', upper(substr(md5(url), 1, 6)))"), ("accent", "concat('rgb(', page_id % 256, ',7,9)')"), ("gone", "'#123456'"))
    new = palette(("primary", "concat('#0', page_id % 10, 'aa', 10 + page_id % 90)"), ("accent", "case when page_id % 3 > 0 then concat('#', substr(md5(url), 7, 6)) else 'none' end"), ("added", "'#000000'"))
    stored = pages.select("page_id", F.explode(F.sequence(F.lit(1), (1 + F.col("page_id") % 4).cast("int"))).alias("version"))
    x = brand.apply_brand(tree, pages.select("page_id", F.lit("T").alias("title")), old, new, stored)
    style = lambda text: F.regexp_extract("html", f'<p style="([^"]*)">{text}</p>', 1)
    return x.select("page_id", "colors_remapped", style("a").alias("first"), style("b").alias("second"), "version")


_PARTS = "floor(p_partkey / 20)::bigint as template_id, row_number() over (partition by floor(p_partkey / 20) order by p_partkey) - 1 as place"


@query("template_compose", rf"""with c as (select {_PARTS}, case when p_partkey % 9 > 0 then concat('c', p_size % 12) end as id, case when p_partkey % 2 = 0 then p_brand end as source, case when p_partkey % 3 = 0 then 'span' else 'div' end as tag, p_partkey % 5 as kind from part),
  o as (select *, coalesce(id, concat('component_', place)) as own from c), n as (select *, row_number() over (partition by template_id, own order by place) as nth from o),
  named as (select *, case when nth = 1 then own when source is not null then concat(source, '_', own) else concat(own, '_', place) end as name from n)
  select template_id, count(*)::int as component_count, string_agg(name, ',' order by place) as ids, string_agg(case when tag = 'span' and kind = 1 then concat('Invalid HTML nesting: <ul> inside <span> (component ''', name, ''')') end, ',' order by place) as errors from named group by 1""")
def template_compose(spark, sf_dir):
    """Twenty parts at a time composed into a template: names that are taken, and elements that must not be nested."""
    from loomspan.operators import brand
    from loomspan.plans.values import BLOCK, INLINE

    parts = table(spark, sf_dir, "part").selectExpr(
        "cast(floor(p_partkey / 20) as bigint) as template_id", "p_partkey", "case when p_partkey % 9 > 0 then concat('c', p_size % 12) end as id", "case when p_partkey % 2 = 0 then p_brand end as source",
        "case when p_partkey % 3 = 0 then 'Span' else 'div' end as tag", "case when p_partkey % 5 = 1 then concat('<b>', p_name, '</b>< UL><li>') else p_name end as content",
    )
    out = brand.compose(brand.numbered(parts, "template_id", "p_partkey"), INLINE, BLOCK)
    return out.select("template_id", "component_count", F.array_join("ids", ",").alias("ids"), F.nullif(F.array_join("errors", ","), F.lit("")).alias("errors"))
