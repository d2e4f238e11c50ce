"""Strings built from tokens and content: prompts, previews, log lines, metric expositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token(tokens: str, key: str, default: str) -> Column:
    """A value of a map column, or the default."""
    return F.coalesce(F.try_element_at(F.col(tokens), F.lit(key)), F.lit(default))


def design_prompt(tokens: str = "tokens") -> Column:
    """One sentence on a page's design from its tokens (a map column)."""
    return F.concat(
        F.lit("Use "), token(tokens, "primary", "#000000"), F.lit(" as the primary colour on "), token(tokens, "background", "#ffffff"), F.lit(", set text in "), token(tokens, "base", "Arial, sans-serif"),
        F.lit(" and space blocks by "), token(tokens, "md", "16px"), F.lit("."),
    )


def preview(html: Column, tokens: Column) -> Column:
    """A page that shows html in a sandboxed frame without scripts; tokens (a map) become variables."""
    escaped = F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    variables = F.array_join(F.transform(F.array_sort(F.map_entries(tokens)), lambda e: F.concat(F.lit("--color-"), e["key"], F.lit(":"), e["value"], F.lit(";"))), "")
    return F.concat(
        F.lit('<!doctype html><meta http-equiv="Content-Security-Policy" content="script-src \'none\'"><style>:root{'), variables, F.lit('}</style><iframe sandbox srcdoc="'), escaped, F.lit('"></iframe>')
    )


def prometheus(name: Column, bounds: Column, counts: Column, total: Column, sum_: Column) -> Column:
    """Lines of a histogram: cumulative counts by bound, all, sum and count."""
    lines = F.zip_with(bounds, counts, lambda b, n: F.concat(name, F.lit('_bucket{le="'), b.cast("string"), F.lit('"} '), n.cast("string")))
    rest = F.array(F.concat(name, F.lit('_bucket{le="+Inf"} '), total.cast("string")), F.concat(name, F.lit("_sum "), sum_.cast("string")), F.concat(name, F.lit("_count "), total.cast("string")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("# TYPE "), name, F.lit(" histogram"))), lines, rest), "\n")


# What a transformation must leave as it is, and what stands where no model answers.
PRESERVED = (
    "Leave layout, elements and class names as they are.",
    "Keep the order of sections and what stands out in them.",
    "Keep ids, style rules and which element is within which.",
    "Keep every slot bound to its field.",
    "Leave grid and flex containers whole and in place.",
)
# Fixed values.
NO_MODEL, NO_CHANGES = "LLM Generation Failed (graceful degradation fallback)", "No substitutions submitted."
MOST_DOCUMENT, MOST_HEADINGS = 4000, 10


def transformation_prompts(pages: DataFrame, changes: DataFrame, answers: DataFrame) -> DataFrame:
    """(page_id, source_url, design_summary, substitution_summary, substitutions, notes) of pages(page_id, url).

    changes(page_id, field_id, role, original_value, value, kind, extracted_text, headings) are what was submitted;
    answers(page_id, topic, answer) are a model's summaries of "design" and "substitutions", where there are any."""
    entry = F.struct(
        "field_id", "role", "original_value", "value", "kind", F.substring("extracted_text", 1, MOST_DOCUMENT).alias("document_text"), F.slice("headings", 1, MOST_HEADINGS).alias("headings")
    )
    listed = changes.groupBy("page_id").agg(F.sort_array(F.collect_list(entry)).alias("substitutions"))
    said = answers.where("trim(answer) <> ''").groupBy("page_id").agg(*(F.max(F.when(F.col("topic") == t, F.col("answer"))).alias(t) for t in ("design", "changed")))
    x = pages.select("page_id", F.col("url").alias("source_url")).join(listed, "page_id", "left").join(said, "page_id", "left")
    return x.select(
        "page_id", "source_url", F.coalesce("design", F.lit(NO_MODEL)).alias("design_summary"),
        F.when(F.col("substitutions").isNull(), NO_CHANGES).otherwise(F.coalesce("changed", F.lit(NO_MODEL))).alias("substitution_summary"),
        F.coalesce("substitutions", F.array().cast(listed.schema["substitutions"].dataType)).alias("substitutions"), F.array(*map(F.lit, PRESERVED)).alias("notes"),
    )
