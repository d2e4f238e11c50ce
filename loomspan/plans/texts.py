"""Queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import placeholder
from loomspan.plans.registry import query, sql_text
from loomspan.session import table

_STRIP = r"^[ \t\r\n]+|[ \t\r\n]+$"
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+[.][a-zA-Z0-9_.-]+"
_URL = r"""https?://[^\s<>"')]+"""


def lines(text: F.Column) -> F.Column:
    """Lines of a text, trimmed."""
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _STRIP, ""))


_DUCK_LINES = rf"list_transform(string_split(text,chr(10)), lambda x: regexp_replace(x,'{_STRIP}','','g'))"


@query("content_hash_dedup", "select doc_id, min(doc_id) over (partition by sha256(text)) as kept_doc_id from documents")
def content_hash_dedup(spark, sf_dir):
    """The first document of each content hash. The hash is aggregated first, so that a large group of copies is
    pre-aggregated, and joined back by an equi-join that AQE may split."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.join(docs.groupBy("hash").agg(F.min("doc_id").alias("kept_doc_id")), "hash").select("doc_id", "kept_doc_id")


@query("doc_counts", r"select doc_id, len(list_filter(string_split_regex(text,'[ \t\n\r]+'), lambda x: x <> ''))::bigint as word_count, len(list_filter(" + _DUCK_LINES + ", lambda x: x <> ''))::bigint as line_count from documents")
def doc_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("long").alias("word_count"), F.size(F.filter(lines(F.col("text")), lambda x: x != "")).cast("long").alias("line_count")
    )


@query("doc_emails", f"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text,'{_EMAIL}')))[:20],',') as emails from documents")
def doc_emails(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(found, 1, 20), ",").alias("emails"))


@query("doc_urls", f"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text,{sql_text(_URL)})))[:40],',') as urls from documents")
def doc_urls(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_URL), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(found, 1, 40), ",").alias("urls"))


@query("doc_title", rf"select doc_id, regexp_replace(regexp_replace(l[1],'^[# ]+',''),'{_STRIP}','','g') as title from (select doc_id, list_filter({_DUCK_LINES}, lambda x: length(x) between 2 and 120) as l from documents)")
def doc_title(spark, sf_dir):
    """The first line of 2 to 120 characters, without leading hashes."""
    first = F.get(F.filter(lines(F.col("text")), lambda x: F.length(x).between(2, 120)), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(first, "^[# ]+", ""), _STRIP, "").alias("title"))


@query("doc_summary", rf"""select doc_id, nullif(substring(replace(regexp_extract(array_to_string(l,chr(10)),'^\n*([^\n]+(?:\n[^\n]+)*)',1),chr(10),' '),1,500),'') as summary from (select doc_id, {_DUCK_LINES} as l from documents)""")
def doc_summary(spark, sf_dir):
    """The first run of lines that aren't empty, joined, 500 characters at most."""
    block = F.regexp_extract(F.array_join(lines(F.col("text")), "\n"), r"^\n*([^\n]+(?:\n[^\n]+)*+)", 1)
    text = F.substring(F.replace(block, F.lit("\n"), F.lit(" ")), 1, 500)
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(text, F.lit("")).alias("summary"))


def headings(texts):
    """Heading-like lines of each text: marked with hashes, in capitals, or in title case without final punctuation."""
    out = []
    for text in texts:
        found = []
        for line in (x.strip() for x in (text or "").splitlines()):
            bare = line.lstrip("# ").strip()
            if not 2 <= len(bare) <= 80:
                continue
            title_case = bare[-1] not in ".!?,:;" and bare == bare.title() and len(bare.split()) <= 8
            if line.startswith("#") or bare.isupper() or title_case:
                found.append(bare)
        out.append(found[:20])
    return out


@query("doc_headings")
def doc_headings(spark, sf_dir):
    """Headings need Unicode title case, which no built-in function has: one Arrow-batched function over the text."""
    import pandas as pd

    find = F.pandas_udf(lambda s: pd.Series(headings(s)), "array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", find("text").alias("headings"))


@query("doc_placeholder", "select doc_id, " + ", ".join(f"{placeholder.duck_detect('text', chr(39) + 'text' + chr(39), x)} as {x}" for x in ("state", "signal")) + " from documents")
def doc_placeholder(spark, sf_dir):
    found = placeholder.detect(F.col("text"), F.lit("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("p")).select("doc_id", "p.state", "p.signal")


@query("turn_placeholder", "select conv_id, turn, " + ", ".join(f"{placeholder.duck_detect('text', chr(39) + 'text' + chr(39), x)} as {x}" for x in ("state", "confidence", "signal")) + " from conversations")
def turn_placeholder(spark, sf_dir):
    found = placeholder.detect(F.col("text"), F.lit("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("p")).select("conv_id", "turn", "p.state", F.col("p.confidence").cast("double").alias("confidence"), "p.signal")


#: What documents' fields hold, by their number: their own text, or what often stands there in its place.
_FIELD = "case doc_id % 19 " + " ".join(f"when {i} then {v}" for i, v in enumerate((
    "text", "concat('Lorem ipsum dolor ', lang)", "'  '", "null", "'ok'", "concat('A real sentence of some length in ', source, '.')", "'Short real'", "concat('https://via.placeholder.com/', doc_id)", "'/img/photo12.png'", "'/img/harbour.png'",
    "'#'", "'javascript:void(0)'", "concat('https://site.org/', doc_id)", "'#ff0000'", "'Insert title here'", "'write to test@test.de'", "'xxxx'", "'blank.gif'", "text",
))) + " end as v"
_FIELD_TYPE = "case when doc_id % 19 in (3, 7, 8, 9, 17) then 'image' when doc_id % 19 in (10, 11, 12) then 'url' when doc_id % 19 = 13 then 'color' when doc_id % 19 in (14, 18) then 'textarea' else 'text' end as k"


@query("field_placeholder", "select doc_id, " + ", ".join(f"{placeholder.duck_detect('v', 'k', x)} as {x}" for x in ("state", "confidence", "signal")) + f" from (select doc_id, {_FIELD}, {_FIELD_TYPE} from documents)")
def field_placeholder(spark, sf_dir):
    found = placeholder.detect(F.col("v"), F.col("k"))
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", _FIELD, _FIELD_TYPE)
    return x.select("doc_id", found.alias("p")).select("doc_id", "p.state", F.col("p.confidence").cast("double").alias("confidence"), "p.signal")


@query("doc_duplicate_lines", rf"""select doc_id, coalesce(max(n),0) >= 2 as has_duplicates from (select d.doc_id, l.n from documents d left join (select doc_id, v, count(*) as n from (select doc_id, unnest(list_transform({_DUCK_LINES}, lambda x: lower(x))) as v from documents) where v <> '' group by 1,2) l using (doc_id)) group by 1""")
def doc_duplicate_lines(spark, sf_dir):
    """Whether two lines of a document are alike, without regard to case: arrays only, no shuffle."""
    found = F.filter(F.transform(lines(F.col("text")), F.lower), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(found) > F.size(F.array_distinct(found))).alias("has_duplicates"))


@query("doc_manifest", "select doc_id, sha256(text) as sha256, strlen(text)::bigint as n_bytes from documents")
def doc_manifest(spark, sf_dir):
    """The manifest of an artifact: a checksum for each file."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("artifact_verify", "select doc_id, case when doc_id % 7 = 0 then 'missing file' when doc_id % 5 = 0 then 'checksum mismatch' else 'valid' end as status from documents")
def artifact_verify(spark, sf_dir):
    """A manifest joined with what is there; here every seventh file is gone and every fifth one changed."""
    docs = table(spark, sf_dir, "documents")
    manifest = docs.select("doc_id", F.sha2("text", 256).alias("expected"))
    actual = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing file").when(F.col("found") != F.col("expected"), "checksum mismatch").otherwise("valid")
    return manifest.join(actual, "doc_id", "full_outer").select("doc_id", status.alias("status"))


# Words that name a section of a site, in the order in which they are listed.
INTENT_KEYWORDS = (
    ("portfolio", "portfolio"), ("work", "portfolio"), ("projects", "portfolio"), ("showcase", "portfolio"), ("gallery", "media_gallery"), ("about", "about"), ("bio", "about"),
    ("biography", "about"), ("story", "about"), ("contact", "contact"), ("email", "contact"), ("phone", "contact"), ("service", "services"), ("services", "services"), ("offering", "services"),
    ("pricing", "pricing"), ("price", "pricing"), ("plan", "pricing"), ("testimonial", "testimonials"), ("review", "testimonials"), ("team", "team"), ("staff", "team"), ("blog", "blog_feed"),
    ("news", "blog_feed"), ("faq", "faq"), ("questions", "faq"), ("feature", "feature_grid"), ("features", "feature_grid"), ("social", "social_links"), ("social media", "social_links"),
)
NEGATIONS = "no|without|remove|exclude|don't need|skip"
ROLE_PATTERNS = (
    r"i(?:'m| am) (?:a |an )?(.+?)(?:\.|,|$)", r"(?:for|about) (?:a |an |my )?(.+?)(?:\.|,| with| who| that|$)",
    r"(?:this is|it's) (?:a |an |my )?(.+?)(?:'s| site| website| page|\.|,|$)", r"(?:building|creating|making) (?:a |an |my )?(.+?)(?:\.|,| site| website|$)",
)


def intent(text: F.Column) -> list[F.Column]:
    """The domain that a request names, and the sections it asks for and excludes (each once, in list order)."""
    low = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    negated = lambda k: low.rlike(rf"(?:{NEGATIONS})\s+(?:[a-zA-Z0-9_]+\s+)*{k}")
    wanted = F.array(*(F.when(low.contains(k) & ~negated(k), role) for k, role in INTENT_KEYWORDS))
    excluded = F.array(*(F.when(low.contains(k) & negated(k), role) for k, role in INTENT_KEYWORDS))
    domain = F.coalesce(*(F.when(low.rlike(p), F.trim(F.regexp_extract(low, p, 1))) for p in ROLE_PATTERNS))
    return [domain.alias("domain"), *(F.array_join(F.array_distinct(F.array_compact(x)), ",").alias(n) for n, x in (("emphasize", wanted), ("exclude", excluded)))]


def _duck_intent(source: str, key: str) -> str:
    neg = lambda k: rf"regexp_matches(l,{sql_text(rf'(?:{NEGATIONS})\s+(?:[a-zA-Z0-9_]+\s+)*{k}')})"
    # DuckDB's list_distinct keeps no order: each role is listed once, by its first keyword that applies.
    def listed(negated: bool) -> str:
        items = [f"case when contains(l,'{k}') and {'' if negated else 'not '}{neg(k)} then '{r}' end" for k, r in INTENT_KEYWORDS]
        return f"array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(list_filter([{', '.join(items)}], lambda x: x is not null), lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end), ',')"

    domain = "coalesce(" + ", ".join(f"case when regexp_matches(l,{sql_text(p)}) then trim(regexp_extract(l,{sql_text(p)},1)) end" for p in ROLE_PATTERNS) + ")"
    return rf"select {key}, {domain} as domain, {listed(False)} as emphasize, {listed(True)} as exclude from (select *, lower(regexp_replace(text,'^\s+|\s+$','','g')) as l from {source})"


#: A request for each part, in words that name a trade and sections.
_REQUEST = "case p_partkey % 6 " + " ".join(f"when {i} then {v}" for i, v in enumerate((
    "concat('I am a ', p_type, ', show my portfolio and gallery')", "concat('A site for a ', p_name, ' with pricing, without a blog')", "concat('This is my ', p_brand, ' website. Remove the faq and testimonials')",
    "concat('building an ', p_type, ' site; features, plans and social media')", "concat('nothing in particular ', p_name)", "concat('  Contact me by email or phone ', p_partkey, '  ')",
))) + " end as text"


@query("request_intent", _duck_intent(f"(select p_partkey, {_REQUEST} from part)", "p_partkey"))
def request_intent(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", _REQUEST).select("p_partkey", *intent(F.col("text")))


@query("turn_intent", _duck_intent("(select * from conversations where role = 'user')", "conv_id, turn"))
def turn_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", *intent(F.col("text")))


#: Roles that are asked of each page, by its number.
_WANTED = "case page_id % 4 when 0 then 'navigation,about,pricing' when 1 then 'footer' when 2 then 'faq,footer,blog_feed' else concat('unknown,role', page_id % 3) end as roles"


@query("intent_unsupported", f"""with p as (select page_id, {_WANTED}, list_filter([case when contains(html, '<nav>') then 'navigation' end, case when contains(html, '<footer>') then 'footer' end, case when regexp_matches(html, '<(div|article)[ >]') then 'unknown' end], lambda x: x is not null) as has from pages),
  i as (select page_id, has, unnest(string_split(roles, ',')) as role from p) select page_id, array_to_string(list_sort(list(role)), ',') as unsupported from i where not list_contains(has, role) group by 1""")
def intent_unsupported(spark, sf_dir):
    """Roles that are asked of a page and that none of its sections has, sorted."""
    from loomspan.operators import nodes, sections

    pages = table(spark, sf_dir, "pages")
    has = sections.classify(nodes.parse_html(pages)).groupBy("page_id").agg(F.collect_set("role").alias("has"))
    x = pages.selectExpr("page_id", _WANTED).join(has, "page_id", "left")
    missing = F.array_sort(F.array_except(F.split("roles", ","), F.coalesce("has", F.array().cast("array<string>"))))
    return x.select("page_id", F.array_join(missing, ",").alias("unsupported"), F.size(missing).alias("n")).where("n > 0").drop("n")


def fit_risks(x: DataFrame) -> DataFrame:
    """Risks of (id, value, original, required, max_length, width, height, slot_width, slot_height, is_text), a row each."""
    value, original = F.coalesce("value", F.lit("")), F.regexp_replace(F.coalesce("original", F.lit("")), r"^\s+|\s+$", "")
    empty = F.col("required") & (F.regexp_replace(value, r"^\s+|\s+$", "") == "")
    ratio = F.abs(F.col("width") / F.col("height") - F.col("slot_width") / F.col("slot_height")) / (F.col("slot_width") / F.col("slot_height"))
    sized = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("slot_width") > 0) & (F.col("slot_height") > 0)
    risk = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    text = F.col("is_text") & ~empty
    risks = F.array_compact(F.array(
        risk(empty, "required_empty", "high"), risk(text & (F.length(value) > F.col("max_length")), "text_exceeds_constraint", "medium"),
        risk(text & (F.length(original) >= 4) & (F.length(value) > 2.5 * F.length(original)), "text_overflow", "medium"),
        risk(~F.col("is_text") & ~empty & sized & (F.when(sized, ratio) > 0.4), "aspect_shift", "medium"),
    ))
    return x.select("id", F.explode(risks).alias("r")).select("id", "r.kind", "r.severity")


# What each severity takes from a safety score of 100.
PENALTY = {"high": 40.0, "medium": 20.0, "low": 8.0}


def safety_score(severities: F.Column) -> F.Column:
    penalty = F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv))
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(penalty[severities]), F.lit(0.0))), 2)


_DUCK_TURN_RISKS = """(select id, 'text_exceeds_constraint' as kind from (select a.conv_id * 1000 + a.turn as id, a.text as original, b.text as value from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1) where length(value) > 200
  union all select id, 'text_overflow' from (select a.conv_id * 1000 + a.turn as id, a.text as original, b.text as value from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1) where length(regexp_replace(original,'^\\s+|\\s+$','','g')) >= 4 and length(value) > 2.5 * length(regexp_replace(original,'^\\s+|\\s+$','','g')))""".replace("\\\\", "\\")


def turn_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn put in the place of the one before it."""
    c = table(spark, sf_dir, "conversations")
    before, after = c.select("conv_id", "turn", F.col("text").alias("original")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("value"))
    none = F.lit(None).cast("int")
    return before.join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "value", "original", F.lit(False).alias("required"), F.lit(200).alias("max_length"), F.lit(True).alias("is_text"),
        *(none.alias(n) for n in ("width", "height", "slot_width", "slot_height")),
    )


@query("fit_risks", f"select kind, count(*)::bigint as n from {_DUCK_TURN_RISKS} group by 1")
def fit_risk_counts(spark, sf_dir):
    return fit_risks(turn_substitutions(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("fit_safety_score", f"select id, round(greatest(0.0, 100.0 - 20.0 * count(*)), 2)::double as safety_score from {_DUCK_TURN_RISKS} group by 1")
def fit_safety_score(spark, sf_dir):
    return fit_risks(turn_substitutions(spark, sf_dir)).groupBy("id").agg(safety_score(F.col("severity")).alias("safety_score"))


@query("auto_payload", "select conv_id, turn, 'Sample ' || role || ' ' || turn as value from conversations where role in ('user','assistant')")
def auto_payload(spark, sf_dir):
    """A sample value for each field that takes text."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.concat(F.lit("Sample "), "role", F.lit(" "), F.col("turn").cast("string")).alias("value"))


@query("page_merge", "select lang, count(*)::bigint as pages, array_to_string(list_distinct(list(source)).list_sort(),',') as assets from documents group by 1")
def page_merge(spark, sf_dir):
    """Results of many pages as one: counts added, assets once each."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("assets"))


@query("document_kinds", "select doc_id, case doc_id % 6 when 0 then 'pdf' when 1 then 'docx' when 2 then 'md' when 3 then 'txt' when 4 then null else 'csv' end as kind from documents")
def document_kinds(spark, sf_dir):
    """What documents' files are: by their first bytes, what an archive holds, their ending, and whether they are text."""
    from loomspan.sources.tables import document_kind

    text = "coalesce(text, '')"
    content = F.expr(f"""case doc_id % 6 when 0 then cast(concat('%PDF-1.7 ', {text}) as binary) when 1 then unhex('504B0304') || cast('word/document.xml' as binary) when 2 then cast({text} as binary) when 3 then cast({text} as binary)
      when 4 then unhex('FFFE00C3') else cast(concat('a,b', {text}) as binary) end""")
    path = F.expr("concat('files/d', doc_id, case doc_id % 6 when 2 then '.MD' when 3 then '' when 5 then '.csv' else '.bin' end)")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content")).select("doc_id", document_kind().alias("kind"))


@query("manifest_icons", """select page_id, case page_id % 3 when 0 then concat('{"icons":[{"src":"assets/i', page_id, '.png","sizes":"48x48"},{"src":"data:image/png,x"}]}') when 1 then concat('{"name":"', page_id, '"}') else 'no json' end as json from pages""")
def manifest_icons(spark, sf_dir):
    """Web-app manifests with their icons' files in assets/; one without icons, or that can't be read, stays."""
    from loomspan.sources.tables import localize_manifest

    given = F.expr("""case page_id % 3 when 0 then concat('{"icons":[{"src":"/img/i', page_id, '.png?v=2","sizes":"48x48"},{"src":"data:image/png,x"}]}') when 1 then concat('{"name":"', page_id, '"}') else 'no json' end""")
    return table(spark, sf_dir, "pages").select("page_id", given.alias("json")).select("page_id", localize_manifest().alias("json"))


@query("design_prompts", """select p_partkey, concat('Use ', case when p_partkey % 3 > 0 then concat('#', substr(md5(p_name), 1, 6)) else '#000000' end, ' as the primary colour on #ffffff, set text in ', case when p_partkey % 2 = 0 then p_brand else 'Arial, sans-serif' end, ' and space blocks by ', p_size, 'px.') as prompt,
  concat('<!doctype html><meta http-equiv="Content-Security-Policy" content="script-src ''none''"><style>:root{', case when p_partkey % 2 = 0 then concat('--color-base:', p_brand, ';') else '' end, '--color-md:', p_size, 'px;', case when p_partkey % 3 > 0 then concat('--color-primary:#', substr(md5(p_name), 1, 6), ';') else '' end,
  '}</style><iframe sandbox srcdoc="<p title=&quot;a&amp;b&quot;>', p_name, '</p>"></iframe>') as preview from part""")
def design_prompts(spark, sf_dir):
    """A sentence on each design and a page that shows it in a sandboxed frame; tokens that are missing have defaults."""
    from loomspan.functions import prompts

    entry = lambda key, value, when="true": F.when(F.expr(when), F.struct(F.lit(key).alias("key"), F.expr(value).alias("value")))
    tokens = F.map_from_entries(F.array_compact(F.array(entry("primary", "concat('#', substr(md5(p_name), 1, 6))", "p_partkey % 3 > 0"), entry("base", "p_brand", "p_partkey % 2 = 0"), entry("md", "concat(p_size, 'px')"))))
    x = table(spark, sf_dir, "part").select("p_partkey", "p_name", tokens.alias("tokens"))
    html = F.concat(F.lit('<p title="a&b">'), "p_name", F.lit("</p>"))
    return x.select("p_partkey", prompts.design_prompt().alias("prompt"), prompts.preview(html, F.col("tokens")).alias("preview"))


@query("sql_functions", r"""select page_id, len(regexp_extract_all(html, '<p[\s>]'))::bigint as paragraphs, 1::bigint as declarations, 100.0::double as score, false as has_script from pages""")
def sql_functions(spark, sf_dir):
    """The library's functions in SQL: pages and their sheets parsed laterally, compared with themselves, sanitized."""
    from loomspan.functions.register import register

    register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("loomspan_pages")
    return spark.sql("""
        with tags as (select p.page_id, count_if(n.tag = 'p') as paragraphs from loomspan_pages p, lateral parse_html(p.html) n group by p.page_id),
        rules as (select p.page_id, count(*) as declarations from loomspan_pages p, lateral parse_css(concat('p', p.page_id, '{margin:0}')) r group by p.page_id)
        select p.page_id, t.paragraphs, r.declarations, structural_score(p.html, p.html) as score, contains(sanitize_html(p.html), '<script') as has_script
        from loomspan_pages p join tags t using (page_id) join rules r using (page_id)""")
