"""Brands and templates: a palette put on pages of another, and components composed into one template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import colors
from loomspan.operators import markup, versions
from loomspan.operators.nodes import attribute


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, old, new) of palettes old(page_id, role, color) and new(page_id, role, color): colours of one role, where
    both are hex or rgb colours. Of roles that share an old colour the last by name counts."""
    palette = lambda p, name: p.select("page_id", "role", colors.normalize_hex(F.col("color")).alias(name)).where(F.col(name).isNotNull())
    return palette(old, "old").join(palette(new, "new"), ["page_id", "role"]).groupBy("page_id", "old").agg(F.max_by("new", "role").alias("new"))


def _like(value: Column, hex_: Column) -> Column:
    """A colour in the notation of a value."""
    c = colors.channels_of_hex(hex_)
    return F.when(F.lower(F.trim(value)).startswith("rgb"), F.format_string("rgb(%d, %d, %d)", c[0], c[1], c[2])).otherwise(hex_)


def restyle(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """nodes with the colours of their inline styles replaced by mapping(page_id, old, new). A value is replaced if all of
    it is such a colour; it keeps its notation, and declarations keep their order."""
    x = nodes.select("page_id", "node_id", attribute("style").alias("style")).where("style is not null")
    x = x.select("page_id", "node_id", F.posexplode(versions.declared(F.col("style"))).alias("pos", "d")).select("page_id", "node_id", "pos", "d.prop", "d.value")
    x = x.withColumn("old", colors.normalize_hex(F.col("value"))).join(mapping.select("page_id", "old", "new"), ["page_id", "old"], "left")
    value = F.when(F.col("new").isNotNull(), _like(F.col("value"), F.col("new"))).otherwise(F.col("value"))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat("prop", F.lit(": "), value).alias("text"))))
    styles = x.groupBy("page_id", "node_id").agg(F.max(F.col("new").isNotNull()).alias("changed"), F.array_join(F.transform(listed, lambda d: d["text"]), "; ").alias("value"))
    return versions.with_attribute(nodes, styles.where("changed"), "style")


def apply_brand(nodes: DataFrame, pages: DataFrame, old: DataFrame, new: DataFrame, stored: DataFrame) -> DataFrame:
    """(page_id, colors_remapped, html, jsx, version) of nodes and pages(page_id, title): the pages in a brand's colours,
    compiled anew, as the next version of each after stored(page_id, version)."""
    mapping = remap(old, new)
    tree = restyle(nodes, mapping)
    counts = mapping.groupBy("page_id").agg(F.count("*").alias("n"))
    last = stored.groupBy("page_id").agg(F.max("version").alias("last"))
    x = markup.compile_document(tree, pages).join(markup.compile_jsx(tree), "page_id").join(counts, "page_id", "left").join(last, "page_id", "left")
    return x.select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("colors_remapped"), "html", "jsx", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"))


def compose(components: DataFrame, inline: tuple[str, ...], block: tuple[str, ...]) -> DataFrame:
    """(template_id, component_count, ids, errors) of components(template_id, place, id, source, tag, content), places from 0.

    A component without an id is named by its place. An id that one before it has gets its source in front, or its place
    behind if it has none; the name it gets counts as taken for those after it. An inline element that holds a block
    element is an error."""
    own = F.coalesce("id", F.concat(F.lit("component_"), F.col("place").cast("string")))
    second = F.when(F.coalesce("source", F.lit("")) != "", F.concat("source", F.lit("_"), own)).otherwise(F.concat(own, F.lit("_"), F.col("place").cast("string")))
    tags = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"<\s*([a-zA-Z0-9]+)"), F.lit(1)), F.lower)
    nested = F.when(F.lower("tag").isin(*inline), F.get(F.filter(tags, lambda t: t.isin(*block)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("place", own.alias("own"), second.alias("second"), F.lower("tag").alias("tag"), nested.alias("nested"))))
    named = F.aggregate("parts", F.array().cast("array<string>"), lambda ids, p: F.concat(ids, F.array(F.when(F.array_contains(ids, p["own"]), p["second"]).otherwise(p["own"]))))
    wrong = F.filter(F.zip_with("parts", "ids", lambda p, i: F.when(p["nested"].isNotNull(), F.concat(F.lit("Invalid HTML nesting: <"), p["nested"], F.lit("> inside <"), p["tag"], F.lit("> (component '"), i, F.lit("')")))), lambda e: e.isNotNull())
    x = components.groupBy("template_id").agg(parts.alias("parts")).withColumn("ids", named)
    return x.select("template_id", F.size("parts").alias("component_count"), "ids", wrong.alias("errors"))


def numbered(rows: DataFrame, template: str, order: str) -> DataFrame:
    """rows with place: their number within a template, from 0."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(template).orderBy(order)) - 1)
