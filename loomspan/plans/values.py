"""Queries over values cut from the tables, one for each scalar rule: colours, lengths, selectors, media, slots, roles.

The values that a rule is shown are made of a table's own columns, so that they grow and vary with it. One text makes
them, which Spark and DuckDB read alike; the rule itself is stated twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import colors
from loomspan.operators import nodes, sections, versions
from loomspan.plans.registry import query, sql_text
from loomspan.session import table


def derived(name: str, *columns: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """Rows of a table with these columns: for Spark, and as DuckDB's text."""
    return lambda spark, sf_dir: table(spark, sf_dir, name).selectExpr(*columns), f"(select {', '.join(columns)} from {name})"


def choice(number: str, *values: str) -> str:
    """One of some expressions, by a number."""
    return f"case {number} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


_MD5 = "md5(coalesce(text, ''))"
_colors, _DUCK_COLORS = derived("documents", "doc_id", choice(
    "doc_id", f"concat('#', upper(substr({_MD5}, 1, 3)))", f"concat('#', substr({_MD5}, 1, 6))", f"concat('#', substr({_MD5}, 1, 8))", "concat('rgb(', n_chars % 300, ', ', doc_id % 256, ', 16)')",
    "concat('rgba(', doc_id % 400, ',-4,12.9,.5)')", "lang", "' Inherit '", f"concat('#', substr({_MD5}, 1, 2))", "'transparent'", "concat('rgb(a,', lang, ',c)')", f"concat('#', substr({_MD5}, 1, 6), ' url(x.png)')",
    "''", "concat(n_chars, 'px')", "concat('rgb(', doc_id % 256, ',2)')",
) + " as value")
_CHANNEL = "lpad(to_hex(greatest(0, least(255, trunc(trim(c[{i}])::double)::int))), 2, '0')"
_RGB = f"case when regexp_matches(v,'^rgba?[(][^)]+[)]') then case when len(c) >= 3 and regexp_matches(trim(c[1]) || ',' || trim(c[2]) || ',' || trim(c[3]),'^[-+0-9.]+,[-+0-9.]+,[-+0-9.]+$') then '#' || {' || '.join('lower(' + _CHANNEL.format(i=i) + ')' for i in (1, 2, 3))} end"
_FROM_COLORS = f"(select *, case when length(substr(t,2)) = 3 then substr(t,2,1)||substr(t,2,1)||substr(t,3,1)||substr(t,3,1)||substr(t,4,1)||substr(t,4,1) else substr(t,2) end as h from (select doc_id, value, v, string_split(regexp_extract(v,'^rgba?[(]([^)]+)[)]',1),',') as c, regexp_extract(v,'^([^ ]*)',1) as t from (select doc_id, value, lower(trim(value)) as v from {_DUCK_COLORS})))"


@query("color_normalize", f"""select doc_id, value, {_RGB} when t like '#%' then case when regexp_matches(h,'^([0-9a-f]{{6}}|[0-9a-f]{{8}})$') then '#' || substr(h,1,6) end when t in ('inherit','initial','transparent','none','unset','currentcolor') then null when regexp_matches(t,'^[a-z]+$') then t end as color from {_FROM_COLORS}""")
def color_normalize(spark, sf_dir):
    return _colors(spark, sf_dir).select("doc_id", "value", colors.normalize(F.col("value")).alias("color"))


@query("color_normalize_hex", f"""select doc_id, value, {_RGB} when v like '#%' and regexp_matches(h,'^[0-9a-f]{{6}}$') and t = v then '#' || h end as color from {_FROM_COLORS}""")
def color_normalize_hex(spark, sf_dir):
    return _colors(spark, sf_dir).select("doc_id", "value", colors.normalize_hex(F.col("value")).alias("color"))


_known, _DUCK_KNOWN = derived(
    "pages", "page_id", "url", "case when page_id % 4 = 3 then 'typography' else 'colors' end as category", "concat('key-', page_id % 3) as key",
    choice("page_id", "concat('#f', substr(md5(url), 1, 1), '0', substr(md5(url), 2, 1), '0', substr(md5(url), 3, 1))", "concat('ff0', substr(md5(url), 1, 1), '0', substr(md5(url), 2, 1))", "'#f00'", "'red'", "concat('#', substr(md5(url), 1, 6))") + " as value",
)


@query("knowledge_color_query", f"""select page_id, url, key, round(sqrt(pow(('0x'||substr(h,1,2))::int - 255, 2) + pow(('0x'||substr(h,3,2))::int - 5, 2) + pow(('0x'||substr(h,5,2))::int - 5, 2)), 2) as color_distance from (select *, case when length(x) = 3 then substr(x,1,1)||substr(x,1,1)||substr(x,2,1)||substr(x,2,1)||substr(x,3,1)||substr(x,3,1) else x end as h from (select *, ltrim(lower(trim(value)),'#') as x from {_DUCK_KNOWN})) where category = 'colors' and regexp_matches(h,'^[0-9a-f]{{6}}$') and sqrt(pow(('0x'||substr(h,1,2))::int - 255, 2) + pow(('0x'||substr(h,3,2))::int - 5, 2) + pow(('0x'||substr(h,5,2))::int - 5, 2)) <= 20""")
def knowledge_color_query(spark, sf_dir):
    """Entries within a distance of #ff0505; values that are no colour fall away."""
    x = _known(spark, sf_dir).where("category = 'colors'").withColumn("c", colors.channels_of_hex(F.col("value")))
    d = colors.distance(F.col("c"), F.array(F.lit(255), F.lit(5), F.lit(5)))
    return x.where("c is not null").select("page_id", "url", "key", d.alias("d")).where("d <= 20").select("page_id", "url", "key", F.round("d", 2).alias("color_distance"))


@query("knowledge_token_query", "select p_partkey, p_brand as key from part where contains(lower(p_type),'brass') or contains(lower(p_brand),'#13')")
def knowledge_token_query(spark, sf_dir):
    """Entries that have a word in their value or another in their key."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"), F.col("p_type").alias("value"))
    return x.where(F.lower("value").contains("brass") | F.lower("key").contains("#13")).select("p_partkey", "key")


_lengths, _DUCK_LENGTHS = derived("documents", "doc_id", choice(
    "doc_id", "concat(n_chars, 'px')", "concat(n_chars % 50, '.5rem')", "concat('-', n_chars % 9, 'em')", "cast(n_chars as string)", "concat('.', n_chars % 10, 'px')", "'auto'", "concat(n_chars % 100, ' PX')", "concat(n_chars, '%')", "''",
    "concat(n_chars % 10, '.px')",
) + " as value")


@query("length_to_px", rf"select doc_id, value, case when regexp_matches(v,'^(-?[0-9]*\.?[0-9]+)\s*(px|rem|em)?$') then regexp_extract(v,'^(-?[0-9]*\.?[0-9]+)',1)::double * case when regexp_matches(v,'em$') then 16 else 1 end end::double as px from (select doc_id, value, lower(trim(value)) as v from {_DUCK_LENGTHS})")
def length_to_px(spark, sf_dir):
    return _lengths(spark, sf_dir).select("doc_id", "value", colors.to_px(F.col("value")).cast("double").alias("px"))


_selectors, _DUCK_SELECTORS = derived("pages", "page_id", choice(
    "page_id", "'div'", "concat('#p', page_id, ' .b')", "concat('ul li:nth-child(', page_id, ')')", "concat('a[href].x', page_id, ':hover')", "'div > p + span'", "concat('.a.b.c', repeat('.d', cast(page_id % 5 as int)))", "'h1#t.big[data-x]'", "'*'",
    "concat('nav', repeat(' ul', cast(page_id % 4 as int)), ' li a')",
) + " as selector")


@query("selector_specificity", rf"select page_id, selector, length(s) - length(replace(s,'#','')) as ids, length(s) - length(replace(s,'.','')) + length(s) - length(replace(s,'[','')) as classes, len(regexp_extract_all(s,'(^|[\s>+~]+)[a-zA-Z0-9]+'))::int as tags from (select page_id, selector, case when contains(selector,':') then regexp_replace(selector,':[a-zA-Z0-9_-]+(\([^)]*\))?','','g') else selector end as s from {_DUCK_SELECTORS})")
def selector_specificity(spark, sf_dir):
    return _selectors(spark, sf_dir).select("page_id", "selector", colors.specificity(F.col("selector")).alias("s")).select("page_id", "selector", "s.*")


_GREY = "n_chars % 16"
_states, _ = derived(
    "documents", "doc_id", choice("doc_id", "'none'", "concat(n_chars, 'px')", f"concat('rgb(', 17 * ({_GREY}), ', ', 17 * ({_GREY}), ', ', 17 * ({_GREY}), ')')", "concat('rgba(', n_chars % 256, ',2,3,1)')", "lang") + " as a",
    choice("doc_id", "case when doc_id % 2 = 0 then '0px' else '1px' end", "concat(n_chars + doc_id % 2, 'PX ')", "concat('#', repeat(substr('0123456789abcdef', cast((n_chars + doc_id % 2) % 16 as int) + 1, 1), 6))", "concat('rgba(', n_chars % 256, ',2,3,', case when doc_id % 2 = 0 then '0.9995' else '0.5' end, ')')", "concat(case when doc_id % 2 = 0 then '' else 'x' end, upper(lang), ' ')") + " as b",
)


@query("style_diff", "select doc_id, doc_id % 2 = 1 as differs from documents")
def style_diff(spark, sf_dir):
    """Whether two style values differ in more than their notation: each kind of value has an odd and an even form."""
    a, b = (colors.normalize_style_value(F.col(c)) for c in "ab")
    return _states(spark, sf_dir).select("doc_id", (a != b).alias("differs"))


# Properties that are dropped whatever their value.
DENIED = ("behavior", "-moz-binding", "will-change", "pointer-events", "user-select", "-webkit-user-select", "-webkit-tap-highlight-color", "-webkit-touch-callout", "touch-action", "scroll-behavior", "content")
_properties, _DUCK_PROPERTIES = derived("documents", "doc_id", choice("doc_id", "'color'", "concat('--', lang)", "'content'", "'will-change'", "concat('margin-', source)", "'--content'", "'behavior'", "'touch-action'", "'contents'") + " as p")


@query("property_denylist", f"select doc_id, p from {_DUCK_PROPERTIES} where p like '--%' or p not in (" + ", ".join(map(sql_text, DENIED)) + ")")
def property_denylist(spark, sf_dir):
    return _properties(spark, sf_dir).where(F.col("p").startswith("--") | ~F.col("p").isin(*DENIED))


# First bytes of media files; those of RIFF and MP4 have a size in between.
_START = choice(
    "doc_id", "'89504E470D0A1A0A'", "'FFD8FFE000104A46'", "'524946460000000057454250'", "'52494646000000004156492030'", "'000000186674797069736F6D'", "'1A45DFA3'", "'4F676753'", "'49443303'", "'664C6143'", "'FFFB9000'", "'25504446'", "'504B0304'", "'00'",
    "'524946460000000057415645'",
)
_files, _DUCK_FILES = derived("documents", "doc_id", f"concat({_START}, upper({_MD5})) as f")


@query("media_format", f"select doc_id, case when f like '89504E47%' then 'png' when f like 'FFD8FF%' then 'jpeg' when f like '52494646%' and substr(f,17,8) = '57454250' then 'webp' when substr(f,9,8) = '66747970' then 'mp4' when f like '1A45DFA3%' then 'webm' when f like '4F676753%' then 'ogg' when f like '52494646%' and substr(f,17,8) = '57415645' then 'wav' when f like '494433%' or f like 'FFFB%' then 'mp3' when f like '664C6143%' then 'flac' when f like '25504446%' then 'pdf' when f like '504B0304%' then 'zip' end as format from {_DUCK_FILES}")
def media_format(spark, sf_dir):
    """Kinds of files, by their first twelve bytes."""
    data = F.try_to_binary("f", F.lit("hex"))
    x = _files(spark, sf_dir).select("doc_id", F.hex(F.substring(data, 1, 12)).alias("h"))
    h = F.col("h")
    riff = lambda kind: h.startswith("52494646") & (F.substring(h, 17, 8) == kind)
    return x.select("doc_id", F.when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg").when(riff("57454250"), "webp").when(F.substring(h, 9, 8) == "66747970", "mp4").when(h.startswith("1A45DFA3"), "webm")
                    .when(h.startswith("4F676753"), "ogg").when(riff("57415645"), "wav").when(h.startswith("494433") | h.startswith("FFFB"), "mp3").when(h.startswith("664C6143"), "flac").when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304"), "zip").alias("format"))


@query("upload_decode", "select doc_id, case doc_id % 4 when 2 then null when 3 then 0 else strlen(text) end::int as n_bytes from documents")
def upload_decode(spark, sf_dir):
    """Bytes of a base64 payload with or without a data: prefix; null if it is none."""
    payload = F.expr(choice("doc_id", "base64(cast(text as binary))", "concat('data:text/plain;base64,', base64(cast(text as binary)))", "concat(lang, ' not base64!')", "''"))
    data = F.try_to_binary(F.regexp_replace(payload, "^data:[^,]*,", ""), F.lit("base64"))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(data).alias("n_bytes"))


_images, _DUCK_IMAGES = derived("part", "p_partkey", "concat(replace(p_name, ' ', '_'), '-', p_partkey, case when p_partkey % 3 = 0 then '' else '.png' end) as name", "cast(p_size * 10 as int) as w", "cast((p_partkey % 50) * 8 as int) as h")


@query("image_facts", rf"select p_partkey, regexp_replace(regexp_replace(name,'\.[^.]*$',''),'[_-]+',' ','g') as alt, case when w > 0 and h > 0 then round(w::double / h, 3) end as aspect, case when w > 0 and h > 0 then case when w::double/h > 1.05 then 'landscape' when w::double/h < 0.95 then 'portrait' else 'square' end end as orientation from {_DUCK_IMAGES}")
def image_facts(spark, sf_dir):
    sized, ratio = (F.col("w") > 0) & (F.col("h") > 0), F.col("w") / F.nullif(F.col("h"), F.lit(0))
    alt = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "[_-]+", " ")
    return _images(spark, sf_dir).select("p_partkey", alt.alias("alt"), F.when(sized, F.round(ratio, 3)).alias("aspect"), F.when(sized, F.when(ratio > 1.05, "landscape").when(ratio < 0.95, "portrait").otherwise("square")).alias("orientation"))


_slots, _DUCK_SLOTS = derived(
    "documents", "doc_id", choice("doc_id", "'text'", "'text'", "'image'", "'text'", "null", "'text'", "'image'", "'text'", "'text'") + " as slot", "doc_id % 2 = 0 as required", "case when doc_id % 4 > 0 then 400 end as most",
    choice("doc_id", "'text'", "'text'", "'text'", "'document'", "'text'", "'text'", "'image'", "'image'", "'text'") + " as given", choice("doc_id", "coalesce(text, '')", "' '", "concat('https://placehold.it/', doc_id)", "coalesce(text, '')", "concat('Lorem IPSUM ', lang)") + " as value",
)


@query("slot_validation", f"""select doc_id, case when slot is null then 'hard:unknown slot' when required and trim(value) = '' then 'hard:required' when trim(value) = '' then 'ok:empty' when slot <> given and not (slot = 'text' and given = 'document') then 'hard:type mismatch' when slot = 'image' and regexp_matches(lower(value),'placehold') then 'soft:placeholder image' when length(value) > coalesce(most, 1000000) then 'soft:too long' when contains(lower(value),'lorem ipsum') then 'soft:placeholder text' else 'ok' end as verdict from {_DUCK_SLOTS}""")
def slot_validation(spark, sf_dir):
    """Ordered rules for a value in a slot; the first that holds decides."""
    blank = F.trim("value") == ""
    verdict = (
        F.when(F.col("slot").isNull(), "hard:unknown slot").when(F.col("required") & blank, "hard:required").when(blank, "ok:empty")
        .when((F.col("slot") != F.col("given")) & ~((F.col("slot") == "text") & (F.col("given") == "document")), "hard:type mismatch")
        .when((F.col("slot") == "image") & F.lower("value").contains("placehold"), "soft:placeholder image").when(F.length("value") > F.col("most"), "soft:too long")
        .when(F.lower("value").contains("lorem ipsum"), "soft:placeholder text").otherwise("ok")
    )
    return _slots(spark, sf_dir).select("doc_id", verdict.alias("verdict"))


_types, _DUCK_TYPES = derived("documents", "doc_id", choice("doc_id", "'text'", "'image'", "'text'", "'video'", "'audio'", "'document'") + " as t", "case when doc_id % 7 > 0 then n_chars end as n")


@query("field_types", f"select doc_id, case when t = 'text' and n > 200 then 'textarea' when t = 'image' then 'image' when t in ('video','audio') then 'url' else 'text' end as field_type from {_DUCK_TYPES}")
def field_types(spark, sf_dir):
    return _types(spark, sf_dir).select("doc_id", F.when((F.col("t") == "text") & (F.col("n") > 200), "textarea").when(F.col("t") == "image", "image").when(F.col("t").isin("video", "audio"), "url").otherwise("text").alias("field_type"))


# Inline elements, and block elements that must not be inside them.
INLINE = ("span", "a", "strong", "em", "b", "i", "small", "label", "code", "abbr", "cite", "s", "sub", "sup", "mark")
BLOCK = ("div", "p", "section", "article", "header", "footer", "main", "aside", "nav", "ul", "ol", "li", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6")
_nested, _DUCK_NESTED = derived("pages", "page_id", choice("page_id", "'span'", "'div'", "'A'", "'em'", "'mark'") + " as tag", choice("page_id", "concat('<i>', url, '</i>')", "html", "concat('<b>< Li>', url)", "null", "concat('plain ', url)", "replace(html, '<nav>', '<x>')", "html") + " as content")


@query("nesting_errors", "select page_id, b as nested from (select page_id, list_filter(list_transform(regexp_extract_all(coalesce(content,''),'<\\s*([a-zA-Z0-9]+)',1), lambda t: lower(t)), lambda t: list_contains([" + ", ".join(map(sql_text, BLOCK)) + "], t))[1] as b, tag from " + _DUCK_NESTED + ") where b is not null and lower(tag) in (" + ", ".join(map(sql_text, INLINE)) + ")")
def nesting_errors(spark, sf_dir):
    """The first block element in what is put into an inline one: here whole pages, and pieces."""
    tags = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"<\s*([a-zA-Z0-9]+)"), F.lit(1)), F.lower)
    first = F.get(F.filter(tags, lambda t: t.isin(*BLOCK)), F.lit(0))
    return _nested(spark, sf_dir).where(F.lower("tag").isin(*INLINE)).select("page_id", first.alias("nested")).where("nested is not null")


@query("brand_remap", """with brand as (select n_nationkey, 7 * n_nationkey as r, 20 * n_regionkey as g, case when n_nationkey % 5 > 0 then substr(md5(n_name), 1, 6) end as new from nation)
  select c_custkey, case when c_custkey % 3 = 2 then 'red' when c_custkey % 3 = 0 then case when new is null then 'rgb(' || r || ', ' || g || ',5)' else 'rgb(' || ('0x' || substr(new,1,2))::int || ', ' || ('0x' || substr(new,3,2))::int || ', ' || ('0x' || substr(new,5,2))::int || ')' end
  else coalesce('#' || new, '#' || printf('%02X%02X05', r, g)) end as value from customer join brand on c_nationkey = n_nationkey""")
def brand_remap(spark, sf_dir):
    """Colours of one palette replaced by those of another with the same role, in the notation that they had.

    Nations are the roles of both palettes, of which the new one has no colour for some; customers' values are of their
    nation's old colour or of none. The remap joins the values by equality."""
    nation = table(spark, sf_dir, "nation").selectExpr("n_name as role", "n_nationkey", "concat('rgb(', 7 * n_nationkey, ', ', 20 * n_regionkey, ',5)') as old_text", "concat('#', lpad(hex(7 * n_nationkey), 2, '0'), lpad(hex(20 * n_regionkey), 2, '0'), '05') as old_hex")
    old = nation.select("role", colors.normalize_hex(F.col("old_text")).alias("old"))
    new = table(spark, sf_dir, "nation").select(F.col("n_name").alias("role"), colors.normalize_hex(F.expr("case when n_nationkey % 5 > 0 then concat('#', substr(md5(n_name), 1, 6)) else 'nope' end")).alias("new"))
    remap = old.join(new, "role").where("old is not null and new is not null").groupBy("old").agg(F.max_by("new", "role").alias("new"))
    values = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "case c_custkey % 3 when 0 then old_text when 1 then old_hex else 'red' end as v")
    x = values.withColumn("old", colors.normalize_hex(F.col("v")))
    c = colors.channels_of_hex(F.col("new"))
    like = F.when(F.lower(F.trim("v")).startswith("rgb"), F.format_string("rgb(%d, %d, %d)", c[0], c[1], c[2])).otherwise(F.col("new"))
    return x.join(remap, "old", "left").select("c_custkey", F.coalesce(F.when(F.col("new").isNotNull(), like), "v").alias("value"))


# What a section is in a personal portfolio; sections without an entry are left out.
PORTFOLIO = {"hero": "bio_header", "about": "bio", "portfolio": "projects", "testimonials": "testimonials", "contact": "contact", "social_links": "social_links", "media_gallery": "projects", "feature_grid": "skills", "services": "services"}
ROLES = ("hero", "about", "portfolio", "team", "testimonials", "contact", "social_links", "navigation", "footer", "sidebar", "media_gallery", "cta", "faq", "blog_feed", "feature_grid", "pricing", "services", "unknown")
#: Classes of the sections that pages get, and the role that each shows.
_CLASSES = (("about-us", "about"), ("our-work", "portfolio"), ("testimonials wide", "testimonials"), ("contactus", "contact"), ("features", "feature_grid"), ("pricing", "pricing"), ("jumbotron", "hero"), ("offerings", "services"), ("photo-gallery", "portfolio"))


@query("portfolio_categories", f"select page_id, role, category from (select page_id, {choice('page_id', *(sql_text(r) for _, r in _CLASSES))} as role, {choice('page_id', *(sql_text(PORTFOLIO.get(r)) for _, r in _CLASSES))} as category from pages) where category is not null")
def portfolio_categories(spark, sf_dir):
    """What the sections of each page are in a portfolio; each page has one more section, by its number."""
    html = f"concat(replace(replace(html, '</body>', ''), '</html>', ''), '<section class=\"', {choice('page_id', *(sql_text(c) for c, _ in _CLASSES))}, '\">x</section></body></html>')"
    mapping = F.create_map(*(F.lit(x) for kv in PORTFOLIO.items() for x in kv))
    found = sections.classify(nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html"))))
    return found.select("page_id", "role", F.try_element_at(mapping, F.col("role")).alias("category")).where("category is not null")


_grids, _DUCK_GRIDS = derived("pages", "page_id", choice("page_id", "concat('repeat(', page_id % 7, ', 1fr)')", "trim(repeat('1fr  ', cast(page_id % 6 as int)))", "''", "'repeat(auto-fill, 10px)'", "concat(page_id, 'px')") + " as v")


@query("grid_columns", rf"select page_id, coalesce(try_cast(nullif(regexp_extract(v,'repeat\(\s*([0-9]+)\s*,',1),'') as int), greatest(1, len(list_filter(string_split(v,' '), lambda x: x <> ''))))::int as columns from {_DUCK_GRIDS}")
def grid_columns(spark, sf_dir):
    return _grids(spark, sf_dir).select("page_id", versions.grid_columns(F.col("v")).alias("columns"))


@query("closest_factor", r"""with g as (select page_id, len(regexp_extract_all(html, '<(p|li)[\s>]'))::int as items, (1 + page_id % 6)::int as columns from pages), f as (select page_id, items, columns, unnest(case when items <= 1 then [1] else range(1, items + 1)::int[] end) as f from g)
  select page_id, items, columns, arg_min(f, (abs(f - columns), -f)) as factor from f where items <= 1 or items % f = 0 group by all""")
def closest_factor(spark, sf_dir):
    """Columns that a page's items fill without a rest, as near as can be to those wanted; of two, the more."""
    x = table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(r"<(p|li)[\s>]")).alias("items"), (1 + F.col("page_id") % 6).cast("int").alias("columns"))
    factors = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), "items")), lambda f: F.col("items") % f == 0)
    nearest = F.array_min(F.transform(factors, lambda f: F.struct(F.abs(f - F.col("columns")).alias("d"), (-f).alias("f"))))
    return x.select("page_id", "items", "columns", F.when(F.col("items") <= 1, 1).otherwise(-nearest["f"]).alias("factor"))


_displays, _DUCK_DISPLAYS = derived("pages", "page_id", choice("page_id", "'grid'", "'flex'", "'inline-flex'", "concat('block', page_id)", "null") + " as d", choice("page_id", "''", "'column'", "'row'", "null", "'column-reverse'", "'flex'", "'column-reverse'") + " as f")


@query("container_type", f"select page_id, case when contains(d,'grid') then 'grid' when contains(d,'flex') then case when coalesce(f,'') like '%column%' then 'flex_column' else 'flex_row' end else 'stack' end as kind from (select page_id, coalesce(d,'') as d, f from {_DUCK_DISPLAYS})")
def container_type(spark, sf_dir):
    d, f = F.coalesce("d", F.lit("")), F.coalesce("f", F.lit(""))
    return _displays(spark, sf_dir).select("page_id", F.when(d.contains("grid"), "grid").when(d.contains("flex"), F.when(f.contains("column"), "flex_column").otherwise("flex_row")).otherwise("stack").alias("kind"))


_LINE = "chr(10)"
_robots, _DUCK_ROBOTS = derived("pages", "page_id", choice("page_id", f"concat('User-agent: *', {_LINE}, 'Disallow: /')", f"concat('User-agent: *', {_LINE}, 'Disallow: /', page_id)", f"concat('# ', url, {_LINE}, 'DISALLOW: /*')", "''", "'Allow: /'", "concat('  disallow:   /  ')", f"concat('Disallow: ', url, {_LINE})") + " as txt")


@query("robots_class", rf"select page_id, case when len(list_filter(string_split(lower(txt),chr(10)), lambda l: regexp_matches(l,'^\s*disallow:\s*/\*?\s*$'))) > 0 then 'restricted' else 'safe_to_reconstruct' end as verdict from {_DUCK_ROBOTS}")
def robots_class(spark, sf_dir):
    closed = F.exists(F.split(F.lower("txt"), "\n"), lambda line: line.rlike(r"^\s*disallow:\s*/\*?\s*$"))
    return _robots(spark, sf_dir).select("page_id", F.when(closed, "restricted").otherwise("safe_to_reconstruct").alias("verdict"))


_paths, _ = derived("pages", "page_id", choice("page_id", "concat('root > div:nth-child(', page_id % 9, ') > p:nth-child(', page_id % 5 + 1, ')')", "concat('root > ul:nth-child(', page_id, ')')", "'root'") + " as p", "cast(page_id % 4 as int) as i")


@query("path_shift", "select page_id, case page_id % 3 when 0 then concat('root > div:nth-child(', page_id % 9, ') > p:nth-child(', page_id % 5 + 1 + page_id % 4, ')') when 1 then concat('root > ul:nth-child(', page_id + page_id % 4, ')') else 'root' end as path from pages")
def path_shift(spark, sf_dir):
    """The last index of a path moved by the number of an instance."""
    n = F.regexp_extract("p", r"^.*nth-child\(([0-9]+)\)", 1).try_cast("int")
    moved = F.concat(F.regexp_extract("p", r"^(.*nth-child\()[0-9]+\)", 1), (n + F.col("i")).cast("string"), F.regexp_extract("p", r"^.*nth-child\([0-9]+(\).*)$", 1))
    return _paths(spark, sf_dir).select("page_id", F.coalesce(F.when(n.isNotNull(), moved), "p").alias("path"))


_srcsets, _DUCK_SRCSETS = derived("pages", "page_id", choice("page_id", "concat(url, '/a.png 1x, ', url, '/b.png 2x')", "concat('c', page_id, '.jpg 480w,  d.jpg 800w')", "concat('e', page_id, '.gif')") + " as s")


@query("srcset_parts", rf"select page_id, pos, regexp_extract(x,'^(\S+)',1) as url, trim(regexp_extract(x,'^\S+(.*)$',1)) as descriptor from (select page_id, trim(unnest(string_split(s,','))) as x, generate_subscripts(string_split(s,','),1) as pos from {_DUCK_SRCSETS})")
def srcset_parts(spark, sf_dir):
    x = _srcsets(spark, sf_dir).select("page_id", F.posexplode(F.split("s", ",")).alias("pos", "x"))
    return x.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.regexp_extract(F.trim("x"), r"^(\S+)", 1).alias("url"), F.trim(F.regexp_extract(F.trim("x"), r"^\S+(.*)$", 1)).alias("descriptor"))


#: What a sheet imports: each page has one, by its number, which names others of its eight; every eighth names none.
IMPORTS = "case when page_id % 8 = 0 then concat('p{color:red} /* ', url, ' */') when page_id % 2 = 0 then concat('@import url(\"s', page_id - page_id % 8 + (3 * page_id) % 8, '.css\") screen; p{}') else concat('@IMPORT \"s', page_id - page_id % 8 + (3 * page_id) % 8, '.css\"; @import url(s', page_id - page_id % 8 + 2, '.css);') end as css"
_imports, _DUCK_IMPORTS = derived("pages", "page_id", IMPORTS)
_IMPORT_PATTERNS = (r"""(?i)@import\s+url\(\s*["']?([^"')]+)["']?\s*\)""", r"""(?i)@import\s+["']([^"']+)["']""")
_DUCK_FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(css, {sql_text(p)}, 1)" for p in _IMPORT_PATTERNS) + ")"


def imported(css: str) -> F.Column:
    """The sheets that a sheet imports, those by url() first."""
    return F.concat(*(F.regexp_extract_all(css, F.lit(p), F.lit(1)) for p in _IMPORT_PATTERNS))


@query("css_imports", f"select page_id, array_to_string({_DUCK_FOUND}, ',') as refs from {_DUCK_IMPORTS}")
def css_imports(spark, sf_dir):
    return _imports(spark, sf_dir).select("page_id", F.array_join(imported("css"), ",").alias("refs"))


DUCK_SHEETS = f"(select concat('s', page_id, '.css') as sheet, unnest({_DUCK_FOUND}) as imported from {_DUCK_IMPORTS})"


def sheet_imports(spark, sf_dir) -> DataFrame:
    """(sheet, imported) of the pages' sheets."""
    return _imports(spark, sf_dir).select(F.concat(F.lit("s"), F.col("page_id").cast("string"), F.lit(".css")).alias("sheet"), F.explode(imported("css")).alias("imported"))
