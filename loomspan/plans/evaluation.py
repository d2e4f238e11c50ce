"""Whole-corpus reports: how well pages take new content, and checks of model answers and of edited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import markup, nodes, sections
from loomspan.plans.values import ROLES
from loomspan.plans.pages import _DUCK_LINKS, links
from loomspan.plans.registry import query, sql_text
from loomspan.plans.texts import fit_risks, safety_score
from loomspan.session import checkpointed, table


def repurpose(pages: DataFrame, most: int | None = sections.MOST_SLOTS) -> DataFrame:
    """For each of pages(page_id, html): fields (the first so many, or all), how many sample values landed, safety, structure
    and success.

    One job for the whole corpus; every join is on page_id, and what a page lacks counts as nothing done."""
    tree = checkpointed(nodes.parse_html(pages))
    fields = sections.fields(tree, most)
    wanted = fields.where("field_type <> 'image'").select("page_id", "field_id", "path", "original_value", "max_length", F.concat(F.lit("Sample "), "label").alias("value"))
    edited = markup.compile_html(sections.substitute(tree, wanted.select("page_id", "path", "value")))
    before = markup.compile_html(tree).select("page_id", F.col("html").alias("original"))
    landed = wanted.join(edited, "page_id").groupBy("page_id").agg(F.count("*").alias("applied"), F.count_if(F.col("html").contains(F.col("value"))).alias("present"))
    none = F.lit(None).cast("int")
    sized = wanted.select(F.col("page_id").alias("id"), "value", F.col("original_value").alias("original"), F.lit(False).alias("required"), "max_length", F.lit(True).alias("is_text"), *(none.alias(n) for n in ("width", "height", "slot_width", "slot_height")))
    safety = fit_risks(sized).groupBy(F.col("id").alias("page_id")).agg(safety_score(F.col("severity")).alias("safety"))
    structure = markup.structural_score(before.join(edited.withColumnRenamed("html", "other"), "page_id")).select("page_id", F.col("structural_score").alias("structural"))
    counts = fields.groupBy("page_id").agg(F.count("*").alias("n_fields"))
    x = pages.select("page_id").join(counts, "page_id", "left").join(landed, "page_id", "left").join(safety, "page_id", "left").join(structure, "page_id", "left")
    x = x.select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fields", "applied", "present")), F.coalesce("safety", F.lit(100.0)).alias("safety"), "structural")
    scores = F.array_compact(F.array(F.lit(100.0), F.col("present") * 100.0 / F.nullif(F.col("applied"), F.lit(0)), F.col("safety"), F.col("structural")))
    success = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / F.size(scores)
    return x.withColumn("success", F.when(F.col("applied") == 0, 0.0).otherwise(F.round(success, 2)))


@query("page_repurpose_report")
def page_repurpose_report(spark, sf_dir):
    return repurpose(table(spark, sf_dir, "pages").select("page_id", "html"))


def repurpose_stats(report: DataFrame) -> DataFrame:
    """The report of a corpus: each measure's mean and extremes."""
    measures = ("n_fields", "safety", "structural", "success")
    return report.agg(F.count("*").alias("pages"), *(f(F.col(m)).cast("double").alias(f"{n}_{m}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


@query("corpus_repurpose_stats")
def corpus_repurpose_stats(spark, sf_dir):
    return repurpose_stats(page_repurpose_report(spark, sf_dir))


#: A model's answer about each document, by its number: well-formed, unsure, of no known role, without reason, or no answer.
_ANSWER = "case doc_id % 7 " + " ".join(f"when {i} then {v}" for i, v in enumerate((
    """concat('{"section_role":"hero","confidence":0.', 70 + doc_id % 30, ',"reasoning":"', source, '"}')""", """concat('{"section_role":"', lang, '","confidence":0.9,"reasoning":"x"}')""", """'{"section_role":"faq","confidence":0.5,"reasoning":"x"}'""",
    """concat('{"section_role":"faq","confidence":', doc_id, '.5,"reasoning":"x"}')""", """'{"section_role":"about","confidence":0.8,"reasoning":" "}'""", "concat('not json ', lang)", """concat('{"section_role":"team","confidence":0.8,"reasoning":"', lang, '"}')""",
))) + " end as answer"
_ROLE_LIST = ", ".join(map(sql_text, ROLES))


@query("answer_validation", f"""select doc_id, coalesce(try_cast(json_extract_string(j,'$.confidence') as double) between 0.8 and 1 and json_extract_string(j,'$.section_role') in ({_ROLE_LIST}) and trim(json_extract_string(j,'$.reasoning')) <> '', false) as accepted from (select doc_id, case when json_valid(answer) then answer end as j from (select doc_id, {_ANSWER} from documents))""")
def answer_validation(spark, sf_dir):
    """Answers of a model that are well-formed: a known role, a confidence of 0.8 to 1, and a reason. Others fail closed."""
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", _ANSWER).select("doc_id", F.from_json("answer", "section_role string, confidence double, reasoning string").alias("a"))
    ok = F.col("a.confidence").between(0.8, 1.0) & F.col("a.section_role").isin(*ROLES) & (F.trim("a.reasoning") != "")
    return x.select("doc_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def integrity(tree: DataFrame) -> DataFrame:
    """(page_id, kind, detail): what is wrong with edited pages; no rows if nothing is.

    Links to ids that are gone, section numbers that aren't 1 to n, and empty sections."""
    orphans = sections.orphaned_anchors(tree).select("page_id", F.lit("orphaned anchor").alias("kind"), F.col("target").alias("detail"))
    numbers = tree.select("page_id", "parent_id", nodes.attribute("data-section-index").try_cast("int").alias("i")).where("i is not null").groupBy("page_id", "parent_id").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.countDistinct("i").alias("d"), F.count("*").alias("n"))
    gaps = numbers.where("a <> 1 or b <> n or d <> n").select("page_id", F.lit("section numbers").alias("kind"), F.col("parent_id").cast("string").alias("detail"))
    filled = tree.where("parent_id is not null").select("page_id", F.col("parent_id").alias("node_id")).distinct()
    empty = tree.where((F.col("depth") == 1) & F.col("tag").isin(*sections.SECTION_TAGS)).join(filled, ["page_id", "node_id"], "left_anti").select("page_id", F.lit("empty section").alias("kind"), F.col("path").alias("detail"))
    return orphans.unionByName(gaps).unionByName(empty)


#: What is put at the end of a page's body, so that every third page has a dead link and every fourth an empty section.
_BROKEN = """concat(replace(replace(html, '</body>', ''), '</html>', ''), case when page_id % 3 = 0 then '<p><a href="#gone">x</a></p>' else '' end, case when page_id % 4 = 0 then '<section></section>' else '' end, '</body></html>')"""


@query("page_integrity", "select page_id, ((page_id % 3 = 0)::bigint + (page_id % 4 = 0)::bigint) as violations from pages")
def page_integrity(spark, sf_dir):
    """What is wrong with pages after their menu is removed."""
    tree = checkpointed(nodes.parse_html(table(spark, sf_dir, "pages").select("page_id", F.expr(_BROKEN).alias("html"))).select("page_id", "node_id", "parent_id", "depth", "subtree_end", "tag", "path", "attrs"))
    left = checkpointed(sections.without_sections(tree, tree.where("tag = 'nav' and depth = 1").select("page_id", "path")))
    found = integrity(left).groupBy("page_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


@query("asset_local_names", f"""select page_id, pos, case when n = '' then 'asset' else n end || '-' || substr(sha256(target), 1, 8) || '.html' as local_name from (select page_id, pos, target, regexp_extract(target, '([^/?#]*)(?:[?#].*)?$', 1) as n from (select page_id, pos, regexp_extract(url,'^([a-zA-Z]+://[^/?#]*)',1) || href as target from {_DUCK_LINKS} where starts_with(href, '/') and not starts_with(href, '//')))""")
def asset_local_names(spark, sf_dir):
    """File names for local copies of what pages of one site refer to: the last part of the address and a stable hash of
    the whole."""
    local = F.col("href").startswith("/") & ~F.col("href").startswith("//")
    x = links(spark, sf_dir).where(local).select("page_id", F.col("pos").cast("long").alias("pos"), F.concat(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1), "href").alias("target"))
    name = F.regexp_extract("target", "([^/?#]*)(?:[?#].*)?$", 1)
    return x.select("page_id", "pos", F.concat(F.when(name == "", "asset").otherwise(name), F.lit("-"), F.substring(F.sha2("target", 256), 1, 8), F.lit(".html")).alias("local_name"))


@query("page_answer_fallback", """select page_id, unnest([2, 3]) as top_idx, unnest([case when page_id % 2 = 0 then 'hero' else 'unknown' end, 'unknown']) as role, unnest([case when page_id % 2 = 0 then 0.9 else 0.0 end, 0.0])::double as confidence from pages""")
def page_answer_fallback(spark, sf_dir):
    """Sections that rules leave open, with a model's answers joined where there are any that are valid; else they stay
    unknown. Every other page has an answer for its second section, every third an unsure one for its third."""
    open_ = sections.classify(nodes.parse_html(table(spark, sf_dir, "pages"))).where("confidence < 0.8")
    given = F.array(
        F.when(F.col("page_id") % 2 == 0, F.struct(F.lit(2).alias("top_idx"), F.lit("hero").alias("answer_role"), F.lit(0.9).alias("answer_confidence"))),
        F.when(F.col("page_id") % 3 == 0, F.struct(F.lit(3).alias("top_idx"), F.lit("faq").alias("answer_role"), F.lit(0.5).alias("answer_confidence"))),
    )
    answers = table(spark, sf_dir, "pages").select("page_id", F.inline(F.array_compact(given)))
    x = open_.join(answers.where(F.col("answer_role").isin(*ROLES) & F.col("answer_confidence").between(0.8, 1.0)), ["page_id", "top_idx"], "left")
    return x.select("page_id", "top_idx", F.coalesce("answer_role", F.lit("unknown")).alias("role"), F.coalesce("answer_confidence", F.lit(0.0)).alias("confidence"))
