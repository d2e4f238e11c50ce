"""Two versions of a page's tree: what an edit does, and what it must leave whole.

A version is a nodes table. Inline styles and slot ids are read from the nodes, so that an edited tree says of itself what
it holds; the five rules compare it with the tree it came from by semi- and anti-joins on page_id and a value. The only
join of intervals is that of a page's few removed subtrees with its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import sections
from loomspan.operators.nodes import attribute, located

# Names of the rules, spacing properties, and values that are no step of a scale.
ORPHANED, EMPTY_GRID, ORDERING, OFF_SCALE, DANGLING = "no_orphaned_nav_entries", "no_empty_grid_cells", "contiguous_section_ordering", "spacing_scale_invariance", "no_dangling_slot_references"
SPACING = tuple(f"{kind}{side}" for kind in ("margin", "padding") for side in ("", "-top", "-bottom", "-left", "-right"))
NO_STEP = ("0", "0px", "auto", "none", "")

SLOT = "data-slot-id"
_DECLARATION = r"""(?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\))+"""


def declared(style: F.Column) -> F.Column:
    """Declarations of a style attribute: an array of (prop, value), in order."""
    split = lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("prop"), F.trim(F.regexp_extract(d, "^[^:]*:(?s)(.*)$", 1)).alias("value"))
    return F.transform(F.filter(F.regexp_extract_all(style, F.lit(_DECLARATION), F.lit(0)), lambda d: d.contains(":")), split)


def inline_styles(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, path, prop, value) of the style attributes; of a property named twice the last value."""
    x = nodes.select("page_id", "node_id", "path", attribute("style").alias("style")).where("style is not null")
    x = x.select("page_id", "node_id", "path", F.posexplode(declared(F.col("style"))).alias("pos", "d"))
    return x.groupBy("page_id", "node_id", "path", F.col("d.prop").alias("prop")).agg(F.max_by("d.value", "pos").alias("value"))


def with_attribute(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """nodes with an attribute set from values(page_id, node_id, value)."""
    x = nodes.join(values.select("page_id", "node_id", F.col("value").alias("__value")), ["page_id", "node_id"], "left")
    rest = F.filter("attrs", lambda a: a["k"] != name)
    added = F.concat(rest, F.array(F.struct(F.lit(name).alias("k"), F.col("__value").alias("v"))))
    return x.withColumn("attrs", F.when(F.col("__value").isNull(), F.col("attrs")).otherwise(added)).select(*nodes.columns)


def with_slots(nodes: DataFrame) -> DataFrame:
    """nodes that carry the id of their slot, so that it stays with them when other nodes go."""
    return with_attribute(nodes, sections.slots(nodes).select("page_id", "node_id", F.col("slot_id").alias("value")), SLOT)


def slot_ids(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, path, slot_id) of the nodes that carry one."""
    return nodes.select("page_id", "node_id", "path", attribute(SLOT).alias("slot_id")).where("slot_id <> ''")


def orphaned(after: DataFrame) -> DataFrame:
    """Links to an id that is not on the page."""
    links = after.where("tag = 'a'").select("page_id", "path", F.trim(attribute("href")).alias("href")).where("href like '#_%'")
    links = links.select("page_id", "path", F.split_part(F.substring("href", 2, 1 << 30), F.lit("/"), F.lit(1)).alias("target"))
    ids = after.select("page_id", F.trim(attribute("id")).alias("target")).where("target is not null").distinct()
    return links.join(ids, ["page_id", "target"], "left_anti").select("page_id", F.lit(ORPHANED).alias("rule"), "path", F.concat(F.lit("Anchor points to missing ID: "), "target").alias("detail"))


def grid_columns(template: F.Column) -> F.Column:
    """Columns of a grid-template-columns value: repeat(n, ...), or as many as it has parts, one at least."""
    text = F.coalesce(template, F.lit(""))
    listed = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    return F.coalesce(F.regexp_extract(text, r"repeat\(\s*([0-9]+)\s*,", 1).try_cast("int"), F.greatest(F.lit(1), listed))


def empty_grids(after: DataFrame, styles: DataFrame) -> DataFrame:
    """Grids without items, or with no column."""
    of = F.col("prop")
    grids = styles.where(of.isin("display", "grid-template-columns")).groupBy("page_id", "node_id", "path").agg(F.max(F.when(of == "display", F.lower("value"))).alias("display"), F.max(F.when(of != "display", F.col("value"))).alias("template"))
    filled = after.where("parent_id is not null").select("page_id", F.col("parent_id").alias("node_id")).distinct().withColumn("filled", F.lit(True))
    x = grids.where(F.col("display").contains("grid")).join(filled, ["page_id", "node_id"], "left").withColumn("columns", grid_columns(F.col("template")))
    detail = F.when(F.col("filled").isNull(), "Grid has 0 items, leaving all cells empty.").when(F.col("columns") <= 0, F.concat(F.lit("Grid has invalid column count: "), F.col("columns").cast("string")))
    return x.select("page_id", F.lit(EMPTY_GRID).alias("rule"), "path", detail.alias("detail")).where("detail is not null")


def unordered(after: DataFrame, styles: DataFrame) -> DataFrame:
    """Parents whose children's section numbers, or orders, are not 1, 2, ... n."""
    parent = after.select("page_id", "node_id", "parent_id")
    given = after.select("page_id", "parent_id", F.lit("data-section-index values").alias("kind"), attribute("data-section-index").try_cast("int").alias("n"))
    orders = styles.where("prop = 'order'").join(parent, ["page_id", "node_id"]).select("page_id", "parent_id", F.lit("CSS flex/grid orders").alias("kind"), F.col("value").try_cast("int").alias("n"))
    numbers = given.unionByName(orders).where("n is not null and parent_id is not null").groupBy("page_id", "parent_id", "kind").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.countDistinct("n").alias("d"), F.count("*").alias("count"))
    broken = numbers.where("a <> 1 or b <> count or d <> count").join(after.select("page_id", F.col("node_id").alias("parent_id"), "path"), ["page_id", "parent_id"])
    return broken.select("page_id", F.lit(ORDERING).alias("rule"), "path", F.concat("kind", F.lit(" are not contiguous")).alias("detail"))


def _spacing(styles: DataFrame) -> DataFrame:
    x = styles.where(F.col("prop").isin(*SPACING)).withColumn("step", F.lower(F.trim("value")))
    return x.where(~F.col("step").isin(*NO_STEP))


def off_scale(styles_before: DataFrame, styles_after: DataFrame) -> DataFrame:
    """Spacing that no node had before."""
    scale = _spacing(styles_before).select("page_id", "step").distinct()
    found = _spacing(styles_after).join(scale, ["page_id", "step"], "left_anti")
    return found.select("page_id", F.lit(OFF_SCALE).alias("rule"), "path", F.concat(F.lit("Spacing property '"), "prop", F.lit(": "), "value", F.lit("' falls outside the page scale.")).alias("detail"))


def dangling_slots(before: DataFrame, after: DataFrame, removed: DataFrame) -> DataFrame:
    """Slots of removed(page_id, path) subtrees that are still there."""
    gone = located(before, removed).select("page_id", F.col("node_id").alias("a"), F.col("subtree_end").alias("b"))
    slots = slot_ids(before).join(gone, "page_id").where("node_id between a and b").select("page_id", "slot_id").distinct()
    return slot_ids(after).join(slots, ["page_id", "slot_id"], "left_semi").select("page_id", F.lit(DANGLING).alias("rule"), "path", F.concat(F.lit("Dangling slot_id reference '"), "slot_id", F.lit("' remains in tree.")).alias("detail"))


def violations(before: DataFrame, after: DataFrame, removed: DataFrame) -> DataFrame:
    """(page_id, rule, path, detail): what the edit of before to after, which took out removed(page_id, path), broke; no
    rows where nothing is. Links lead to ids of the page, grids have items, numbers run from 1, spacing is of the scale
    of the page before, and no slot of what went is left."""
    styles = inline_styles(after)
    found = orphaned(after).unionByName(empty_grids(after, styles)).unionByName(unordered(after, styles))
    return found.unionByName(off_scale(inline_styles(before), styles)).unionByName(dangling_slots(before, after, removed))


def reflow(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """nodes with the values that plan(page_id, path, prop, after) gives: section numbers in their attribute, others in
    the inline style, where they come last. Paths are those of nodes as it is, before anything goes."""
    changes = plan.where("prop is not null").groupBy("page_id", "path").agg(F.map_from_entries(F.collect_set(F.struct("prop", "after"))).alias("set"))
    # A page's changes in one row: nodes that are dealt by page already need not be dealt again.
    changes = changes.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "set"))).alias("sets"))
    x = nodes.join(changes, "page_id", "left").withColumn("set", F.try_element_at("sets", F.col("path")))
    number = F.try_element_at("set", F.lit("data-section-index"))
    numbered = F.transform("attrs", lambda a: F.struct(a["k"].alias("k"), F.when((a["k"] == "data-section-index") & number.isNotNull(), number).otherwise(a["v"]).alias("v")))
    styles = F.filter(F.map_entries("set"), lambda e: e["key"] != "data-section-index")
    kept = F.filter(declared(F.coalesce(attribute("style"), F.lit(""))), lambda d: ~F.map_contains_key("set", d["prop"]))
    text = F.array_join(F.concat(F.transform(kept, lambda d: F.concat(d["prop"], F.lit(": "), d["value"])), F.transform(styles, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    styled = F.concat(F.filter(numbered, lambda a: a["k"] != "style"), F.array(F.struct(F.lit("style").alias("k"), text.alias("v"))))
    attrs = F.when(F.col("set").isNull(), F.col("attrs")).when(F.size(styles) == 0, numbered).otherwise(styled)
    return x.withColumn("attrs", attrs).select(*nodes.columns)
