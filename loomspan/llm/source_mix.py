"""Mixing sources to target weights, in DataFrame functions alone.

Documents get hash-random keys and are range-sorted by them within each source: the upper bits of a key name one of
RANGES ranges, and a prefix sum over a source's ranges (a few thousand rows) gives each range its offset. Ranges before
the cut are taken whole and those after it not at all, so that one range of each source alone is sorted, by prefix sums
of its own, and texts never move. Each source is cut at its exact budget; a budget above the source's size takes whole
epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import keep

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
RANGE_BITS = 12
RANGES = 1 << RANGE_BITS
#: Parts that rows of one key are dealt over.
SALTS = 64
_OF = ["no_source", "source_name"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes(no_source, source_name, source_size), a row a source -> with target.

    Weights repeat over the sources by code point, null last. Targets share all words by weight; those above `most`
    times their source stop there, and the excess is shared again by weight: target = least(cap, level * weight), where
    the level follows from prefix sums over the sources in the order in which they fill up."""
    order = Window.orderBy("no_source", "source_name")
    choice = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", choice.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_name")
    before, after = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    x = x.withColumn("rank", F.row_number().over(fills)).withColumn("level", level)
    open_rank = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))
    x = x.withColumn("level", F.min_by(F.when(open_rank.isNotNull(), F.col("level")), open_rank).over(everything))
    return x.select("no_source", "source_name", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _cuts(x: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source of x: its size, target, epochs, and the range that its budget ends in, how many of that
    range's words it still takes (null and 0 where it ends with an epoch)."""
    ranges = x.groupBy(*_OF, "__range").agg(F.sum("size").alias("words"))
    sizes = ranges.groupBy(*_OF).agg(F.sum("words").alias("source_size"))
    budget = F.round("target").cast("long")
    targets = source_targets(sizes, weights, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    end = F.sum("words").over(Window.partitionBy(*_OF).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    at = ranges.withColumn("end", end).join(targets.select(*_OF, "rest"), _OF).where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest")))
    at = at.groupBy(*_OF).agg(F.min("__range").alias("cut"), F.min(F.col("rest") - F.col("end") + F.col("words")).alias("left"))
    return targets.join(at, _OF, "left").select(*_OF, "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("left", F.lit(0)).cast("long").alias("left"))


def _last_range(rows: DataFrame) -> DataFrame:
    """rows of the ranges that a cut is in, with what is taken of each row besides whole epochs (extra).

    Rows of one key are alike, and may be a third of all: they are dealt over salts and counted first, so that the
    window over a range has a row for each key and salt, and the one over rows has the rows of one key and salt."""
    same = [*_OF, "__key", "size", "__salt"]
    words = F.col("size") * F.col("n")
    before = F.sum(words).over(Window.partitionBy(*_OF).orderBy("__key", "size", "__salt").rowsBetween(Window.unboundedPreceding, 0)) - words
    starts = rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, before.alias("__start"))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id")) - 1
    extra = F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("__start") - nth * F.col("size")))
    return rows.join(starts, same).withColumn("extra", extra.cast("long")).drop("__salt", "__start")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 20) -> DataFrame:
    """Each row of docs(doc_id, text, source, ...) with size (words), source_size, target (of its source) and taken
    (words that the mix takes, repeats counted: whole epochs, and the words up to the cut).

    Columns of these names are replaced. A null text has size 0; a null source is a source, the last. Rows of equal
    key, id and size are interchangeable. The order depends on doc_id, text and seed alone, so that reruns agree. An
    empty table gives an empty table."""
    new = ["size", "source_size", "target", "taken"]
    keys = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("__key"),
    ).withColumn("__range", F.shiftrightunsigned("__key", 64 - RANGE_BITS).cast("int"))
    cuts = keep(_cuts(keys, weights, most))  # a row for each source
    x = keys.join(cuts, _OF)
    whole = x.where(F.col("__range") != F.col("cut")).withColumn("extra", F.when(F.col("__range") < F.col("cut"), F.col("size")).otherwise(0))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    last = _last_range(keep(x.where(F.col("__range") == F.col("cut")).withColumn("__salt", salt)))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")
    return whole.unionByName(last).withColumn("taken", taken).drop("__key", "__range", "epochs", "cut", "left", "extra", *_OF)


def apply_mix(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and the one at the cut with its first words only
    (joined by one space). Documents without words are of no source's budget and stay once."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), 1, part), " ")
    copies = F.array_repeat(F.col("text"), whole)
    texts = F.when(part > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    return mixed.withColumn("text", F.explode(texts)).drop("size", "source_size", "target", "taken")
