"""Queries over captured pages that need no tree: start tags, links, URLs, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import urls
from loomspan.plans.registry import query, sql_text
from loomspan.session import table

#: An anchor's address, in double, single or no quotes; comments and scripts hold no anchors.
_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


#: The same in one scan: what is no markup takes part without a group; an address comes with its quotes.
_SCAN = _NOT_MARKUP + r"""|<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, pos, href) of every anchor that has an address, in page order."""
    raw = F.filter(F.regexp_extract_all("html", F.lit(_SCAN), F.lit(1)), lambda r: r != "")
    hrefs = F.transform(raw, lambda r: F.when(F.substring(r, 1, 1).isin('"', "'"), F.substr(r, F.lit(2), F.length(r) - 2)).otherwise(r))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href")).withColumn("pos", F.col("pos") + 1)


_DUCK_CLEAN = f"regexp_replace(html, {sql_text(_NOT_MARKUP)}, '', 'g')"
_DUCK_HREFS = "list_transform(list_zip(" + ", ".join(f"regexp_extract_all({_DUCK_CLEAN}, {sql_text(_HREF)}, {i})" for i in (1, 2, 3)) + "), lambda w: concat(w[1], w[2], w[3]))"
_DUCK_LINKS = f"(select page_id, url, unnest(hrefs) as href, generate_subscripts(hrefs, 1) as pos from (select page_id, url, {_DUCK_HREFS} as hrefs from pages))"
_DUCK_HOST = r"regexp_replace(regexp_replace(regexp_extract(lower(trim({0})),'^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)',1),'^[^@]*@',''),':[0-9]*$','')"


@query("page_scan", "select page_id, url, length(html) as n_chars from pages")
def page_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query("page_tag_histogram", "select tag, count(*) as n from (select unnest(regexp_extract_all(html,'<([a-z][a-z0-9]*)',1)) as tag from pages) group by tag")
def page_tag_histogram(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("page_url_normalize", "select page_id, regexp_extract(url,'^([a-z]+://[^/?#]+)',1) || case when p = '' then '/' else p end as norm_url from (select page_id,url,regexp_replace(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),'/+$','') as p from pages)")
def page_url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("norm_url"))


@query("page_template_id", "select page_id, substring(md5(url),1,12) as template_id from pages")
def page_template_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.template_id(F.col("url")).alias("template_id"))


@query("page_title_lang", """select page_id, regexp_extract(html,'<title>([^<]*)</title>',1) as title, regexp_extract(html,'<html lang="([^"]*)"',1) as lang from pages""")
def page_title_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query("page_link_targets", f"select page_id, pos, href from {_DUCK_LINKS}")
def page_link_targets(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("page_links_resolved", f"""select page_id, pos, case when regexp_matches(href,'^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when href like '//%' then regexp_extract(url,'^([a-zA-Z]+:)',1) || href
  when href like '/%' then regexp_extract(url,'^([a-zA-Z]+://[^/?#]*)',1) || regexp_replace(href,'#.*$','') else href end as target from {_DUCK_LINKS}""")
def page_links_resolved(spark, sf_dir):
    """Anchors made absolute against their page."""
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), urls.resolve(F.col("url"), F.col("href")).alias("target"))


@query("page_links_relative", f"""select page_id, pos, regexp_extract(url,'^([a-zA-Z]+://[^/?#]*)',1) || case page_id % 4 when 0 then '/d1/d2/' when 1 then '/d1/' else '/' end || substr(href, 2) || case when page_id % 2 = 0 then '/' else '?q=../x' end as target
  from {_DUCK_LINKS} where regexp_matches(href, '^/[^/?#]+$')""")
def page_links_relative(spark, sf_dir):
    """Anchors as they would be written relative to a page two folders down, with dots to leave folders, made absolute."""
    x = links(spark, sf_dir).where(F.col("href").rlike("^/[^/?#]+$"))
    base = F.concat(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1), F.lit("/d1/d2/page.html?x=/y/"))
    ref = F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 4).cast("int")), F.lit("./"), F.substr("href", F.lit(2)), F.when(F.col("page_id") % 2 == 0, "/z/..#part").otherwise("?q=../x"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), urls.resolve(base, ref).alias("target"))


@query("page_unfetchable_links", f"""select page_id, count(*)::bigint as n_links, count(*) filter (where regexp_matches(lower(trim(href)),'^(#|javascript:|mailto:|tel:|about:|blob:)'))::bigint as n_unfetchable from {_DUCK_LINKS} group by 1""")
def page_unfetchable_links(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(urls.is_unfetchable(F.col("href"))).alias("n_unfetchable"))


@query("page_safe_links", f"""select page_id, count(*) filter (where href = '' or lower(regexp_extract(trim(href),'^([a-zA-Z][a-zA-Z0-9+.-]*):',1)) in ('','http','https','mailto','tel'))::bigint as n_safe from {_DUCK_LINKS} group by 1""")
def page_safe_links(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id").agg(F.count_if(urls.is_safe_uri(F.col("href"))).alias("n_safe"))


@query("page_run_key", "select page_id, replace(replace(regexp_extract(url,'^[a-z]+://([^/?#]*)',1),'www.',''),':','_') as run_key from pages")
def page_run_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.run_key(F.col("url")).alias("run_key"))


@query("page_run_directory", r"select page_id, case when n = '' then 'run' else n end as run_directory from (select page_id, regexp_replace(regexp_replace(regexp_extract(url,'([^/]*)/*$',1),'[^A-Za-z0-9._-]','_','g'),'^[._]+|[._]+$','','g') as n from pages)")
def page_run_directory(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_run_key(F.col("url")).alias("run_directory"))


@query("page_public_url", f"""select page_id, regexp_matches(lower(url),'^https?:') and h <> '' and h <> 'localhost' and not regexp_matches(h,'[.](local|internal|localhost)$') and not regexp_matches(h,'^(0|10|127)[.]|^192[.]168[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]') as is_public from (select page_id, url, {_DUCK_HOST.format('url')} as h from pages)""")
def page_public_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.may_be_public(F.col("url")).alias("is_public"))


#: An address for each page, by its number: its own, or of local, private, public and tracking hosts.
_ADDRESS = "case page_id % 22 " + " ".join(f"when {i} then {v}" for i, v in enumerate((
    "url", "concat('http://10.', page_id % 256, '.2.3/x')", "concat('https://172.', 12 + page_id % 30, '.0.9/')", "concat('http://192.168.', page_id % 256, '.1')", "concat('http://8.8.8.', page_id % 256, '/dns')", "concat('http://localhost:', 8000 + page_id, '/')",
    "concat('https://svc', page_id, '.internal/x')", "concat('https://printer', page_id, '.local')", "concat('ftp://example.org/', page_id)", "'data:text/plain,x'", "concat('/relative/', page_id)", "'http://169.254.169.254/latest'",
    "concat('https://cdn.example.org/', page_id, '.js')", "concat('http://', 220 + page_id % 20, '.0.0.1/')", "concat('https://www.google-analytics.com/ga.js?', page_id)", "'//static.hotjar.com/c.js'", "'https://nothotjar.com/c.js'",
    "concat('https://www.facebook.com/tr?id=', page_id)", "concat('https://example.org/facebook/', page_id)", "concat('https://a.b.criteo.net:', page_id, '/x')", "''", "concat(url, '?u=https://hotjar.com')",
))) + " end as url"
_DUCK_URLS = f"(select page_id, {_ADDRESS} from pages)"


def _addresses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", _ADDRESS)


@query("url_disallowed_resource", f"""select page_id, url, regexp_matches(lower(url),'^https?:') and h <> '' and (h = 'localhost' or regexp_matches(h,'[.](local|internal|localhost)$') or (regexp_matches(h,'^[0-9]+([.][0-9]+){{3}}$')
  and regexp_matches(h,'^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]|^192[.]168[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]'))) as disallowed from (select page_id, url, {_DUCK_HOST.format('url')} as h from {_DUCK_URLS})""")
def url_disallowed_resource(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", "url", urls.is_disallowed_resource(F.col("url")).alias("disallowed"))


_TRACKER_LIST = "[" + ", ".join(map(sql_text, urls.TRACKER_DOMAINS)) + "]"


@query("url_tracker", f"""select page_id, url, contains(lower(url),'facebook.com/tr') or contains(lower(url),'google.com/pagead') or len(list_filter({_TRACKER_LIST}, lambda d: h = d or ends_with(h, '.' || d))) > 0 as is_tracker from (select page_id, url, {_DUCK_HOST.format('url')} as h from {_DUCK_URLS})""")
def url_tracker(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", "url", urls.is_tracker(F.col("url")).alias("is_tracker"))


@query("page_link_trackers", f"""select page_id, count(*) filter (where t)::bigint as n_trackers from (select page_id, len(list_filter({_TRACKER_LIST}, lambda d: h = d or ends_with(h, '.' || d))) > 0 or contains(lower(href),'facebook.com/tr') or contains(lower(href),'google.com/pagead') as t from (select page_id, href, {_DUCK_HOST.format('href')} as h from {_DUCK_LINKS})) group by 1""")
def page_link_trackers(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id").agg(F.count_if(urls.is_tracker(F.col("href"))).alias("n_trackers"))


# Tokens that start a tracker in an inline script.
INLINE_TRACKER = (
    r"""\bgtag\s*\(|\bfbq\s*\(|\b_paq\s*[.\[]|\b_hjSettings\b|\bmixpanel\.init\b|\banalytics\.load\s*\(|\bamplitude\.getInstance\b|["']clarity["']"""
    r"""|\bttq\.load\b|\bsnaptr\s*\(|\btwq\s*\(|\blintrk\s*\(|\bym\s*\(\s*[0-9]+,|googletagmanager\.com/gtm\.js"""
)


@query("page_inline_trackers", f"""select page_id, regexp_matches(array_to_string(regexp_extract_all(html,'(?s)<script>(.*?)</script>',1),' '), {sql_text(INLINE_TRACKER)}) as has_tracker from pages""")
def page_inline_trackers(spark, sf_dir):
    scripts = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1)), " ")
    return table(spark, sf_dir, "pages").select("page_id", scripts.rlike(INLINE_TRACKER).alias("has_tracker"))


@query("page_css_text", "select page_id, array_to_string(regexp_extract_all(html,'(?s)<style>(.*?)</style>',1), chr(10)) as css from pages")
def page_css_text(spark, sf_dir):
    """Style elements of each page, joined in page order."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("(?s)<style>(.*?)</style>"), F.lit(1)), "\n").alias("css"))


@query("page_css_urls", r"""select page_id, array_to_string(regexp_extract_all(html,'url\(["'']?([^"'')]*)["'']?\)',1),',') as css_urls from pages""")
def page_css_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"""url\(["']?([^"')]*)["']?\)"""), F.lit(1)), ",").alias("css_urls"))


def _tag_count(tag: str) -> F.Column:
    return F.regexp_count("html", F.lit(f"<{tag}[\\s>]")).cast("long")


def _duck_count(tag: str) -> str:
    return f"len(regexp_extract_all(html,'<{tag}[\\s>]'))::bigint"


_LANDMARKS = ("header", "nav", "main", "footer", "aside", "h1", "h2", "h3", "img")


@query("page_accessibility", "select page_id, " + ", ".join(f"{_duck_count(t)} as n_{t}" for t in _LANDMARKS) + """, len(regexp_extract_all(html,'<img[^>]*\\salt='))::bigint as n_alt, len(regexp_extract_all(html,'\\srole='))::bigint as n_roles,
  len(regexp_extract_all(html,'\\saria-(label|labelledby)='))::bigint as n_labels, regexp_matches(html,'<html[^>]*\\slang=') as lang_set, regexp_matches(html,'<a href="#') as skip_link from pages""")
def page_accessibility(spark, sf_dir):
    extra = {"n_alt": r"<img[^>]*\salt=", "n_roles": r"\srole=", "n_labels": r"\saria-(label|labelledby)="}
    return table(spark, sf_dir, "pages").select(
        "page_id", *(_tag_count(t).alias(f"n_{t}") for t in _LANDMARKS), *(F.regexp_count("html", F.lit(p)).cast("long").alias(n) for n, p in extra.items()),
        F.col("html").rlike(r"<html[^>]*\slang=").alias("lang_set"), F.col("html").contains('<a href="#').alias("skip_link"),
    )


_PARTS = ("button", "form", "input", "textarea", "select", "dialog", "details", "table", "video", "audio", "iframe", "svg", "picture")


@query("page_components", "select page_id, " + ", ".join(f"{_duck_count(t)} as n_{t}" for t in _PARTS) + """, len(regexp_extract_all(html,'class="[^"]*(carousel|slider|swiper)'))::bigint as n_carousel, len(list_distinct(regexp_extract_all(html,'<([a-z]+-[a-z0-9-]*)',1)))::bigint as n_custom from pages""")
def page_components(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", *(_tag_count(t).alias(f"n_{t}") for t in _PARTS),
        F.regexp_count("html", F.lit('class="[^"]*(carousel|slider|swiper)')).cast("long").alias("n_carousel"),
        F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z]+-[a-z0-9-]*)"), F.lit(1)))).cast("long").alias("n_custom"),
    )


@query("page_meta", """select page_id, pos, meta from (select page_id, unnest(regexp_extract_all(html,'<meta ([^>]*)>',1)) as meta, generate_subscripts(regexp_extract_all(html,'<meta ([^>]*)>',1),1) as pos from pages)""")
def page_meta(spark, sf_dir):
    found = F.posexplode(F.regexp_extract_all("html", F.lit("<meta ([^>]*)>"), F.lit(1))).alias("pos", "meta")
    return table(spark, sf_dir, "pages").select("page_id", found).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "meta")


# Icon libraries by what their markup shows, first match first.
ICON_LIBRARIES = (
    (r"font-?awesome|\bfa-[a-z]", "font-awesome"), (r"material-icons|material-symbols", "material"), (r"lucide", "lucide"), (r"heroicon", "heroicons"),
    (r"bootstrap-icons|\bbi-[a-z]", "bootstrap-icons"), (r"phosphor|\bph-[a-z]", "phosphor"), (r"feather", "feather"), (r"iconify", "iconify"), (r"remixicon|\bri-[a-z]", "remixicon"),
)


@query("page_icon_library", "select page_id, case " + " ".join(f"when regexp_matches(html,'(?i){p}') then '{n}'" for p, n in ICON_LIBRARIES) + " when contains(lower(html),'<svg') then 'inline-svg' else 'unknown' end as icon_library from pages")
def page_icon_library(spark, sf_dir):
    out = F
    for p, n in ICON_LIBRARIES:
        out = out.when(F.col("html").rlike(f"(?i){p}"), n)
    return table(spark, sf_dir, "pages").select("page_id", out.when(F.lower("html").contains("<svg"), "inline-svg").otherwise("unknown").alias("icon_library"))


@query("page_spa_signals", f"""select p.page_id, regexp_matches(html,'data-react(root|id)') as react, regexp_matches(html,'id="__next"') as nextjs, regexp_matches(html,'<app-root|ng-version') as angular, contains(html,'svelte-') as svelte,
  coalesce(l.n,0)::bigint as n_links, coalesce(l.routed,0)::bigint as n_routed, coalesce(l.n > 5 and l.routed > 0.5*l.n, false) as client_side_routing
  from pages p left join (select page_id, count(*) as n, count(*) filter (where href like '/%' or contains(href,'#')) as routed from {_DUCK_LINKS} group by 1) l using (page_id)""")
def page_spa_signals(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.size(hrefs).cast("long").alias("n_links"), F.size(F.filter(hrefs, lambda h: h.startswith("/") | h.contains("#"))).cast("long").alias("n_routed"))
    html = F.col("html")
    return pages.select(
        "page_id", html.rlike("data-react(root|id)").alias("react"), html.contains('id="__next"').alias("nextjs"), html.rlike("<app-root|ng-version").alias("angular"), html.contains("svelte-").alias("svelte"),
        "n_links", "n_routed", ((F.col("n_links") > 5) & (F.col("n_routed") > 0.5 * F.col("n_links"))).alias("client_side_routing"),
    )


# Script names that show an animation library.
ANIMATION_SCRIPTS = (
    ("gsap", "gsap"), ("aos", "aos"), ("swiper", "swiper"), ("lottie", "lottie"), ("anime", "anime.js"), ("scrollmagic", "scrollmagic"), ("three", "three.js"), ("locomotive", "locomotive-scroll"),
    ("rellax", "rellax"), ("typed", "typed.js"), ("particles", "particles.js"), ("framer", "framer-motion"), ("tilt", "vanilla-tilt"),
)


@query("page_animation_libraries", "select page_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(lower(html),'<script[^>]*src=\"[^\"]*{k}') then '{n}' end" for k, n in ANIMATION_SCRIPTS) + ") as libraries from pages")
def page_animation_libraries(spark, sf_dir):
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", *(F.when(low.rlike(f'<script[^>]*src="[^"]*{k}'), n) for k, n in ANIMATION_SCRIPTS)).alias("libraries"))


@query("page_text", "select page_id, md5(regexp_replace(html,'<[^>]+>',' ','g')) as text_md5, length(regexp_replace(html,'<[^>]+>',' ','g'))::bigint as n_chars from pages")
def page_text(spark, sf_dir):
    text = F.regexp_replace("html", "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query("page_charset", """select page_id, regexp_extract(html,'<meta[^>]*charset="?([^">/ ]*)',1) as charset, regexp_matches(html,'<meta[^>]*charset=') as declared, regexp_matches(html,'<head>') as has_head from pages""")
def page_charset(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", '<meta[^>]*charset="?([^">/ ]*)', 1).alias("charset"), F.col("html").rlike("<meta[^>]*charset=").alias("declared"), F.col("html").contains("<head>").alias("has_head")
    )


@query("page_asset_refs", f"""select page_id, 'a' as kind, count(distinct href)::bigint as n from {_DUCK_LINKS} group by 1 union all select page_id, 'img', len(list_distinct(regexp_extract_all(html,'<img[^>]*src="([^"]*)"',1)))::bigint from pages
  union all select page_id, 'script', len(list_distinct(regexp_extract_all(html,'<script[^>]*src="([^"]*)"',1)))::bigint from pages""")
def page_asset_refs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    distinct = lambda p: F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(p), F.lit(1)))).cast("long").alias("n")
    a = links(spark, sf_dir).groupBy("page_id").agg(F.countDistinct("href").alias("n")).select("page_id", F.lit("a").alias("kind"), "n")
    return a.unionByName(pages.select("page_id", F.lit("img").alias("kind"), distinct('<img[^>]*src="([^"]*)"'))).unionByName(pages.select("page_id", F.lit("script").alias("kind"), distinct('<script[^>]*src="([^"]*)"')))


@query("asset_url_dedup", f"select page_id, target, min(pos)::bigint as first_pos from (select page_id, pos, regexp_extract(url,'^([a-zA-Z]+://[^/?#]*)',1) || href as target from {_DUCK_LINKS} where href like '/%') group by 1,2")
def asset_url_dedup(spark, sf_dir):
    """Each absolute URL of a page once, at its first place."""
    x = links(spark, sf_dir).where(F.col("href").startswith("/")).select("page_id", "pos", urls.resolve(F.col("url"), F.col("href")).alias("target"))
    return x.groupBy("page_id", "target").agg(F.min("pos").cast("long").alias("first_pos"))


@query("page_link_graph", f"""select h as host, count(distinct page_id)::bigint as pages, count(*)::bigint as links from (select page_id, {_DUCK_HOST.format('url')} as h from {_DUCK_LINKS}) group by 1""")
def page_link_graph(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host")).groupBy("host").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("links"))
