"""Queries over page trees: nodes, sections, slots, fields, styles, tokens, compiled and compared markup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomspan.operators import markup, nodes, sections, styles
from loomspan.plans.pages import INLINE_TRACKER
from loomspan.plans.registry import ORACLES, query
from loomspan.session import checkpointed, table


def page_nodes(spark, sf_dir):
    return nodes.parse_html(table(spark, sf_dir, "pages"))


_COUNTED = ("nav", "ul", "li", "a", "article", "h1", "p", "footer", "div", "br", "b")


@query("tree_tag_counts", "select page_id, tag, n from (" + " union all ".join(f"select page_id, '{t}' as tag, len(regexp_extract_all(html,'<{t}[\\s>]'))::bigint as n from pages" for t in _COUNTED) + ") where n > 0")
def tree_tag_counts(spark, sf_dir):
    """Elements of the tree by tag: as many as there are start tags in the markup."""
    return page_nodes(spark, sf_dir).where(F.col("tag").isin(*_COUNTED)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("tree_nodes")
def tree_nodes(spark, sf_dir):
    return page_nodes(spark, sf_dir)


@query("tree_stats")
def tree_stats(spark, sf_dir):
    return sections.tree_stats(page_nodes(spark, sf_dir))


@query("tree_flatten")
def tree_flatten(spark, sf_dir):
    return sections.flatten(page_nodes(spark, sf_dir))


#: Every third page has all that it holds in an element that isn't shown.
_UNSEEN = "case when page_id % 3 = 0 then concat('<body><noscript>', replace(replace(html, '<body>', ''), '</body>', ''), '</noscript></body>') else html end"


@query("tree_consistency", f"select page_id, not (page_id % 3 = 0 and len(regexp_extract_all({_UNSEEN}, '<[a-z][a-z0-9]*')) > 10) as consistent from pages")
def tree_consistency(spark, sf_dir):
    """Whether the tree has a tenth at least of the elements that the markup has."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_UNSEEN).alias("html"))
    raw = pages.select("page_id", F.regexp_count("html", F.lit("<[a-z][a-z0-9]*")).alias("dom"))
    return raw.join(sections.tree_stats(nodes.parse_html(pages)), "page_id", "left").select("page_id", (~((F.col("dom") > 10) & (F.coalesce("n_nodes", F.lit(0)) < 0.1 * F.col("dom")))).alias("consistent"))


@query("page_sections", """select page_id, role, n from (select page_id, 'navigation' as role, len(regexp_extract_all(html,'<nav[\\s>]'))::bigint as n from pages union all select page_id, 'footer', len(regexp_extract_all(html,'<footer[\\s>]'))::bigint from pages
  union all select page_id, 'unknown', len(regexp_extract_all(html,'<(div|article)[\\s>]'))::bigint from pages) where n > 0""")
def page_sections(spark, sf_dir):
    """Sections of each page by role."""
    return sections.classify(page_nodes(spark, sf_dir)).groupBy("page_id", "role").agg(F.count("*").alias("n"))


@query("page_slots")
def page_slots(spark, sf_dir):
    return sections.slots(page_nodes(spark, sf_dir))


@query("page_fields")
def page_fields(spark, sf_dir):
    return sections.fields(checkpointed(page_nodes(spark, sf_dir)))


@query("page_slot_report")
def page_slot_report(spark, sf_dir):
    """Slots of each page by its sections' roles, and how many hold real, placeholder or unclear content."""
    x = sections.fields(checkpointed(page_nodes(spark, sf_dir)))
    of = lambda s: F.count_if(F.col("content_state") == s)
    return x.groupBy("page_id", "role").agg(F.count("*").alias("slots"), of("confirmed_real").alias("real"), of("confirmed_placeholder").alias("placeholder"), of("needs_user_confirmation").alias("unclear"))


#: Put at the end of a page's body: a team of some members, links to an id that isn't there, and parts that open and turn.
_RICH = """concat(replace(replace(html, '</body>', ''), '</html>', ''), '<section class="team">', repeat('<div><p>a</p></div>', cast(page_id % 4 as int)), '</section><div id="here"><a href="#here">a</a>', repeat('<a href="#gone">b</a>', cast(page_id % 3 as int)), '</div>',
  repeat('<div><button aria-expanded="false" aria-controls="m">x</button><div id="m">y</div></div>', cast(page_id % 2 as int)), repeat('<div class="slider"><p>a</p><p>b</p></div>', cast(page_id % 3 as int)), repeat('<div class="dropdown"><ul><li>a</li></ul></div>', cast(page_id % 4 as int)), '</body></html>')"""


def _rich_nodes(spark, sf_dir):
    return nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(_RICH).alias("html")))


@query("page_repeats", "select page_id, 'team' as role, page_id % 4 as instances from pages")
def page_repeats(spark, sf_dir):
    """Instances of the repeated part of each page's team."""
    return sections.repeats(checkpointed(_rich_nodes(spark, sf_dir))).select("page_id", "role", F.col("instances").cast("long").alias("instances"))


@query("page_orphaned_anchors", "select page_id, 'gone' as target, page_id % 3 as n from pages where page_id % 3 > 0")
def page_orphaned_anchors(spark, sf_dir):
    return sections.orphaned_anchors(_rich_nodes(spark, sf_dir)).groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("page_interactive", "select * from (select page_id, unnest(['disclosure', 'carousel', 'dropdown']) as kind, unnest([page_id % 2, page_id % 3, page_id % 4]) as n from pages) where n > 0")
def page_interactive(spark, sf_dir):
    return sections.interactive(_rich_nodes(spark, sf_dir)).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def _styled(spark, sf_dir):
    return styles.match(table(spark, sf_dir, "pages").select("page_id", "html", F.lit("").alias("css")))


#: Style sheets that differ from page to page.
_RULES = "concat('.c', page_id, '{color:red;margin:', page_id % 7, 'px}', repeat('h2{top:0}', cast(page_id % 3 as int)))"


@query("page_css_rules", """select page_id, 1 as rule_no, concat('.c', page_id) as selector, unnest(['color', 'margin']) as prop, unnest(['red', concat(page_id % 7, 'px')]) as value from pages
  union all select page_id, unnest(range(2, 2 + page_id % 3))::int, 'h2', 'top', '0' from pages""")
def page_css_rules(spark, sf_dir):
    return styles.parse_css(table(spark, sf_dir, "pages").select("page_id", F.expr(_RULES).alias("css"))).select("page_id", "rule_no", "selector", "prop", "value")


@query("page_cascade", "select page_id, len(regexp_extract_all(html,'<p[\\s>]'))::bigint as styled from pages where regexp_matches(html,'<p[\\s>]')")
def page_cascade(spark, sf_dir):
    """Nodes of each page that a declaration falls on."""
    return styles.cascade(_styled(spark, sf_dir)).groupBy("page_id").agg(F.countDistinct("node_id").alias("styled"))


#: At the end of a page's body, an element with a colour and a variable, so many elements within, and text in the last.
_NESTED = """concat(replace(replace(html, '</body>', ''), '</html>', ''), '<div style="color:red;--gap:4px">', repeat('<div>', cast(page_id % 40 as int)), '<p style="margin:var(--gap);width:var(--none, 1px)">x<i style="color:blue">y</i></p>',
  repeat('</div>', cast(page_id % 40 as int)), '</div></body></html>')"""


@query("page_computed_styles", r"""select * from (select page_id, unnest(['margin', 'color', 'color', 'color', 'margin', 'width']) as prop, unnest(['0', 'red', 'red', 'blue', '4px', '1px']) as value, unnest([true, true, false, true, true, true]) as own,
  unnest([len(regexp_extract_all(html, '<p[\s>]'))::bigint, 1, 1 + page_id % 40, 1, 1, 1]) as n from pages) where n > 0""".replace("\\\\", "\\"))
def page_computed_styles(spark, sf_dir):
    """Computed values of each page: how many elements have them of their own, or from an element around them."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_NESTED).alias("html"), F.lit("").alias("css"))
    found = styles.inherit(nodes.parse_html(pages), styles.cascade(styles.match(pages)))
    return found.groupBy("page_id", "prop", "value", "own").agg(F.count("*").alias("n"))


#: Colours, fonts, sizes and spacing of each page; there is no background, as long as every fifth page has nothing at all.
_LOOK = "case when page_id % 5 = 0 then 'i{top:1px}' else concat('h1{color:#00F;font-size:', 20 + page_id % 5, 'px}p{margin:', 1 + page_id % 3, 'px;font-family:', case when page_id % 2 = 0 then 'Georgia' else 'Verdana' end, '}') end"


@query("page_tokens", """select page_id, unnest(['colors','colors','typography','spacing','spacing']) as category, unnest(['primary','background','base','sm','md']) as key, unnest(['#000000','#ffffff','Arial, sans-serif','8px','16px']) as value from pages where page_id % 5 = 0
  union all select page_id, unnest(['colors','typography','typography','spacing']), unnest(['primary','base','size-1','xs']), unnest(['#0000ff', case when page_id % 2 = 0 then 'Georgia' else 'Verdana' end, concat(20 + page_id % 5, 'px'), concat(1 + page_id % 3, 'px')]) from pages where page_id % 5 > 0""")
def page_tokens(spark, sf_dir):
    """Design tokens of pages with a look of their own; a page that declares none has the defaults."""
    return styles.tokens(styles.parse_css(table(spark, sf_dir, "pages").select("page_id", F.expr(_LOOK).alias("css"))))


@query("page_compiled_html")
def page_compiled_html(spark, sf_dir):
    return markup.compile_html(page_nodes(spark, sf_dir))


@query("page_compiled_jsx")
def page_compiled_jsx(spark, sf_dir):
    return markup.compile_jsx(page_nodes(spark, sf_dir))


@query("page_compiled_vue")
def page_compiled_vue(spark, sf_dir):
    return markup.compile_vue(page_nodes(spark, sf_dir), page_tokens(spark, sf_dir))


@query("page_structural_score", r"""select page_id, case page_id % 3 when 0 then round((1 + n - k)::double / (1 + n + k) * 100, 2) when 1 then round((2 + n)::double / (5 + n) * 100, 2)
  else round((2 + 2 * k)::double / (2 + 2 * k + n) * 100, 2) end as structural_score from (select page_id, n, least(n, page_id % 4) as k from (select page_id, len(regexp_extract_all(html,'<p[\s>]')) as n from pages))""".replace("\\\\", "\\"))
def page_structural_score(spark, sf_dir):
    """As many paragraphs as each page has, in a version against another: the last few with another id, which match nothing;
    the first of two like boxes alone, which is the one that it is taken for; and what is left when all before it goes."""
    x = table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"<p[\s>]")).alias("n"))
    x = x.withColumn("k", F.least("n", F.col("page_id") % 4).cast("int"))
    body = lambda *parts: F.concat(F.lit("<body>"), *(F.expr(p) for p in parts), F.lit("</body>"))
    kinds = [
        (body("repeat('<p>x</p>', n)"), body("repeat('<p>x</p>', n - k)", "repeat('<p id=\"e\">x</p>', k)")),
        (body("'<nav></nav><div>'", "repeat('<p>x</p>', n)", "'</div><hr><div><ul></ul></div>'"), body("'<div>'", "repeat('<p>x</p>', n)", "'</div>'")),
        (body("repeat('<i></i>', n)", "'<div class=\"a b\"></div>'", "repeat('<b></b><u></u>', k)"), body("'<div class=\"b  a\"></div>'", "repeat('<b></b><u></u>', k)")),
    ]
    of = lambda i: F.element_at(F.array(*(kind[i] for kind in kinds)), (F.col("page_id") % 3 + 1).cast("int"))
    return markup.structural_score(x.select("page_id", of(0).alias("original"), of(1).alias("other"))).select("page_id", "structural_score")


#: What must go, and what must stay, in different numbers on each page.
_UNSAFE = """concat(replace(replace(html, '</body>', ''), '</html>', ''), repeat('<script>x()</script>', cast(page_id % 3 as int)), repeat('<a href="javascript:x()" onclick="y()">bare</a>', cast(page_id % 2 as int)), repeat('<img src="/ok.png" onerror="z()">', cast(page_id % 4 as int)), '</body></html>')"""


@query("page_sanitized", """select page_id, false as has_script, 0::bigint as handlers, len(regexp_extract_all(html,'<a href="'))::bigint as links, page_id % 2 as bare, page_id % 4 as images from pages""")
def page_sanitized(spark, sf_dir):
    """Sanitized pages: no script and no handler, but all links and pictures that are safe."""
    clean = F.pandas_udf(lambda s: pd.Series([markup.sanitize(x or "") for x in s]), "string")
    x = table(spark, sf_dir, "pages").select("page_id", clean(F.expr(_UNSAFE)).alias("html"))
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return x.select("page_id", F.col("html").contains("<script").alias("has_script"), count(r"\son[a-z]+=").alias("handlers"), count('<a href="').alias("links"), count("<a>bare</a>").alias("bare"), count('<img src="/ok.png">').alias("images"))


_TRACKED = """concat(replace(replace(html, '</body>', ''), '</html>', ''), repeat('<img src="https://www.google-analytics.com/collect?v=1">', cast(page_id % 4 as int)), repeat('<script>gtag("config")</script>', cast(page_id % 3 as int)), '<img src="/own.png"></body></html>')"""


@query("page_stripped", "select page_id, (page_id % 4 + page_id % 3)::int as removed from pages")
def page_stripped(spark, sf_dir):
    """Trackers removed from each page."""
    return markup.strip(table(spark, sf_dir, "pages").select("page_id", F.expr(_TRACKED).alias("html")), INLINE_TRACKER).select("page_id", "removed")


@query("page_without_menu", "select page_id, 0::bigint as menu_nodes, len(regexp_extract_all(html,'<p[\\s>]'))::bigint as paragraphs, len(regexp_extract_all(html,'<li[\\s>]'))::bigint as entries_before from pages".replace("\\\\", "\\"))
def page_without_menu(spark, sf_dir):
    """Pages with their first section removed: no node of a menu is left, and every paragraph is."""
    x = checkpointed(page_nodes(spark, sf_dir).select("page_id", "node_id", "parent_id", "depth", "subtree_end", "tag", "path", "attrs"))
    left = sections.without_sections(x, x.where("tag = 'nav' and depth = 1").select("page_id", "path"))
    before = x.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("entries_before"))
    return left.groupBy("page_id").agg(F.count_if(F.col("tag").isin("nav", "li")).alias("menu_nodes"), F.count_if(F.col("tag") == "p").alias("paragraphs")).join(before, "page_id")


@query("page_substituted", "select page_id, 'Sample Heading' as heading from pages where regexp_matches(html,'<h1[\\s>]')")
def page_substituted(spark, sf_dir):
    """Pages with a sample text in the place of their first heading."""
    x = page_nodes(spark, sf_dir)
    head = x.where("tag = 'h1'").groupBy("page_id").agg(F.min_by("path", "node_id").alias("path"), F.min("node_id").alias("h"))
    changed = sections.substitute(x, head.select("page_id", "path", F.lit("Sample Heading").alias("value")))
    texts = changed.where("tag = '#text'").select("page_id", F.col("parent_id").alias("h"), F.col("text_content").alias("heading"))
    return texts.join(head.select("page_id", "h"), ["page_id", "h"]).select("page_id", "heading")


# Pages built from a page's own numbers, whose trees, slots, fields and reports follow from them by the rules.
_N = r"len(regexp_extract_all(html, '<p[\s>]'))"


def _built(spark, sf_dir, html: str):
    """(page_id, html) of pages made by an expression over page_id, url and n, the paragraphs of the real page."""
    x = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_count("html", F.lit(r"<p[\s>]")).alias("n"))
    return x.select("page_id", F.expr(html).alias("html"))


@query("tree_depths", f"select page_id, 2 + k + 4 * n as n_nodes, greatest(k + 1, case when n > 0 then 3 else 0 end)::int as depth, 1 + 2 * n as n_texts from (select page_id, page_id % 50 as k, {_N}::bigint as n from pages)")
def tree_depths(spark, sf_dir):
    """Nodes, depth and texts of pages with as many elements in one another as their number says."""
    pages = _built(spark, sf_dir, "concat('<body>', repeat('<div>', cast(page_id % 50 as int)), 'x', repeat('</div>', cast(page_id % 50 as int)), repeat('<p>a<b>c</b></p>', n), '</body>')")
    return sections.tree_stats(nodes.parse_html(pages))


@query("page_slot_numbers", f"""select page_id, least(300, 2 + n + m) as n_slots, case when m > 0 then concat('slot_li_', least(300, 2 + n + m)) else concat('slot_img_', n + 2) end as last_slot, greatest(80, 2 * (5 * w - 1)) + 80 * (least(300, 2 + n + m) - 2) as lengths
  from (select page_id, 1 + page_id % 30 as w, (page_id * 37) % 400 as m, {_N}::bigint as n from pages)""")
def page_slot_numbers(spark, sf_dir):
    """Slots of each page up to the cap, its last, and how long their texts may be. Text of one character or without a
    letter or digit makes none, nor does a picture without an address."""
    pages = _built(spark, sf_dir, """concat('<body><h1>', repeat('word ', cast(1 + page_id % 30 as int)), '</h1>', repeat('<p>some words</p>', n), '<p>-</p><p> a </p><img alt="x"><div>none</div><img src="a.png">', repeat('<li>x y</li>', cast((page_id * 37) % 400 as int)), '</body>')""")
    x = sections.slots(nodes.parse_html(pages))
    return x.groupBy("page_id").agg(F.count("*").alias("n_slots"), F.max_by("slot_id", "node_id").alias("last_slot"), F.sum("max_length").alias("lengths"))


#: Classes that pages' first sections have, and the roles that they show.
_ROLES = (("pricing wide", "pricing"), ("our-team", "team"), ("faqs", "faq"), ("blog-feed", "blog_feed"), ("call-to-action", "cta"), ("plain", "unknown"))
_ROLE = "case page_id % 6 " + " ".join(f"when {i} then '{r}'" for i, (_, r) in enumerate(_ROLES)) + " end"
_CLASS = "case page_id % 6 " + " ".join(f"when {i} then '{c}'" for i, (c, _) in enumerate(_ROLES)) + " end"
_TITLE = "case page_id % 6 " + " ".join(f"when {i} then '{'' if r == 'unknown' else r.replace('_', ' ').title() + ' '}'" for i, (_, r) in enumerate(_ROLES)) + " end"


@query("page_field_forms", f"""select page_id, unnest([concat(role, '_slot_h2_1'), concat(role, '_slot_img_2'), 'footer_slot_p_3', 'unknown_slot_em_4']) as field_id, unnest([concat(title, 'Heading'), concat(title, 'Image'), 'Footer Text', 'Text']) as label,
  unnest(['text', 'image', case when 2 * length(url) > 200 or page_id % 4 = 0 then 'textarea' else 'text' end, 'text']) as field_type, unnest([role, role, 'footer', 'unknown']) as role, unnest([80, null, greatest(80, 2 * (length(concat('Page ', page_id)) + 110 * (page_id % 4 = 0)::int)), 80])::int as max_length
  from (select page_id, 'x' as url, {_ROLE} as role, {_TITLE} as title from pages)""")
def page_field_forms(spark, sf_dir):
    """Forms of pages whose first section has a role by its class: fields with their names, labels, types and lengths."""
    pages = _built(spark, sf_dir, f"""concat('<body><section class="', {_CLASS}, '"><h2>Plans for all</h2><img src="p.png"></section><footer><p>Page ', page_id, case when page_id % 4 = 0 then repeat(' and so on.', 10) else '' end, '</p></footer><div><em>Other words</em></div></body>')""")
    return sections.fields(checkpointed(nodes.parse_html(pages))).select("page_id", "field_id", "label", "field_type", "role", "max_length")


_REPURPOSED = "concat('<body><section><h2>A title that is long enough for a sample</h2>', repeat('<p>Words that are long enough, too.</p>', n), repeat('<p>Abcd</p>', cast(page_id % 7 as int)), '</section></body>')"
_DUCK_REPURPOSED = f"(select page_id, 1 + n + r as n_fields, 1 + n + r as applied, 1 + n + r as present, greatest(0.0, 100.0 - 20 * r)::double as safety, 100.0::double as structural, round((300 + greatest(0.0, 100.0 - 20 * r)) / 4, 2)::double as success from (select page_id, page_id % 7 as r, {_N}::bigint as n from pages))"


@query("page_repurpose_scores", f"select * from {_DUCK_REPURPOSED}")
def page_repurpose_scores(spark, sf_dir):
    """What pages make of sample content: each short paragraph is a risk to what is put in its place. All fields of a page
    count, beyond the cap on its slots, too."""
    from loomspan.plans.evaluation import repurpose

    return repurpose(_built(spark, sf_dir, _REPURPOSED), most=None)


@query("corpus_repurpose_scores", "select count(*) as pages, " + ", ".join(f"{f}({m})::double as {n}_{m}" for m in ("n_fields", "safety", "structural", "success") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + f" from {_DUCK_REPURPOSED}")
def corpus_repurpose_scores(spark, sf_dir):
    """The report of these pages as a corpus."""
    from loomspan.plans.evaluation import repurpose_stats

    return repurpose_stats(page_repurpose_scores(spark, sf_dir))


_CANONICAL = """concat('<body class="k', page_id, '"><ul>', repeat('<li>x<b>y</b></li>', n), '</ul>', repeat('<div>', cast(page_id % 20 as int)), '<img src="a.png">', repeat('</div>', cast(page_id % 20 as int)), '<br><p title="a &amp; &quot;b&quot;">', page_id, '</p></body>')"""


@query("page_html_round_trip", f"select page_id, {_CANONICAL.replace('cast(page_id % 20 as int)', '(page_id % 20)::bigint')} as html from (select page_id, {_N}::bigint as n from pages)")
def page_html_round_trip(spark, sf_dir):
    """Markup that is parsed and compiled again comes back as it was."""
    return markup.compile_html(nodes.parse_html(_built(spark, sf_dir, _CANONICAL)))


@query("page_vue_files", f"""with v as (select page_id, array_to_string(list_sort(list(concat('  --', category, '-', key, ': ', value, ';'))), chr(10)) as variables from ({{tokens}}) group by 1)
  select page_id, concat('<template>', chr(10), '<body><h1>', page_id, '</h1></body>', chr(10), '</template>', chr(10), chr(10), '<script setup>', chr(10), '</script>', chr(10), chr(10), '<style scoped>', chr(10), ':root {{{{', chr(10), variables, chr(10), '}}}}', chr(10), '</style>', chr(10)) as vue from v""".format(tokens=ORACLES["page_tokens"]))
def page_vue_files(spark, sf_dir):
    """Single-file components: a small template with the variables of the page's look."""
    tree = nodes.parse_html(_built(spark, sf_dir, "concat('<body><h1>', page_id, '</h1></body>')"))
    return markup.compile_vue(tree, page_tokens(spark, sf_dir))


@query("page_group_substitutions", """select page_id, 'team_slot_h3_1' as field_id, 'root > section:nth-child(1) > h3:nth-child(1)' as path, concat('Name ', page_id) as original_value, 'plain' as value, 'text_replace' as kind from pages
  union all select page_id, concat('team[', i, '].team_slot_h3_1'), concat('root > section:nth-child(1) > h3:nth-child(', 1 + i, ')'), case when i < 2 then concat('Name ', page_id) end, concat('value ', i), case when i < 2 then 'text_replace' else 'repeatable_instance_add' end
  from (select page_id, unnest(range(page_id % 5)) as i from pages)""")
def page_group_substitutions(spark, sf_dir):
    """What is put into a team of two, member by member: the third and later ones are additions."""
    from loomspan.operators import workflows

    pages = table(spark, sf_dir, "pages")
    fields = sections.fields(checkpointed(nodes.parse_html(_built(spark, sf_dir, "concat('<body><section class=\"team\"><h3>Name ', page_id, '</h3><h3> </h3></section></body>')"))))
    member = F.explode(F.expr("case when page_id % 5 > 0 then sequence(0, cast(page_id % 5 as int) - 1) else array() end")).alias("instance")
    many = pages.select("page_id", member).select("page_id", F.lit("team_slot_h3_1").alias("field_id"), F.concat(F.lit("value "), F.col("instance").cast("string")).alias("value"), "instance", F.lit("team").alias("group_id"))
    one = pages.select("page_id", F.lit("team_slot_h3_1").alias("field_id"), F.lit("plain").alias("value"), F.lit(None).cast("int").alias("instance"), F.lit(None).cast("string").alias("group_id"))
    groups = pages.select("page_id", F.lit("team").alias("group_id"), F.lit(2).alias("instances"))
    return workflows.substitutions(fields, many.unionByName(one), groups)


@query("page_portfolio_built", """select page_id, category, case when category = case page_id % 3 when 0 then 'bio' when 1 then 'projects' else 'contact' end then 1 + page_id % 4 else 0 end as n_fields, n_fields > 0 as is_applicable
  from pages, (select unnest(['bio', 'bio_header', 'contact', 'projects', 'services', 'skills', 'social_links', 'testimonials']) as category)""")
def page_portfolio_built(spark, sf_dir):
    """What pages with one section of a known role hold for each part of a portfolio."""
    from loomspan.operators import workflows
    from loomspan.plans.values import PORTFOLIO

    html = "concat('<body><section class=\"', case page_id % 3 when 0 then 'about-us' when 1 then 'our-work' else 'contactus' end, '\">', repeat('<p>Some words</p>', cast(1 + page_id % 4 as int)), '</section><div><p>Other words</p></div></body>')"
    return workflows.portfolio(sections.fields(checkpointed(nodes.parse_html(_built(spark, sf_dir, html)))), PORTFOLIO)


@query("page_open_fields", """select page_id, unnest(['unknown_slot_p_1', 'unknown_slot_p_2']) as field_id from pages union all select page_id, 'unknown_slot_p_5' from pages where page_id % 2 = 0""")
def page_open_fields(spark, sf_dir):
    """Fields of which nobody knows whether their content is real: short ones that look like nothing in particular."""
    html = "concat('<body><div><p>Hi</p><p>Short words</p><p>A text that is long enough to be real</p><p>lorem ipsum</p><p>', case when page_id % 2 = 0 then 'Page ' else 'This is the text of page ' end, page_id, '</p></div></body>')"
    return sections.to_confirm(sections.fields(checkpointed(nodes.parse_html(_built(spark, sf_dir, html)))))
