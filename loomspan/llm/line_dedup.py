"""Line dedup, in DataFrame functions alone.

Every line that is long enough becomes a row of a 128-bit hash of its key, its document and its position; texts stay
where they are. The rows are range-partitioned by hash and sorted by hash, document (the largest first) and position, so
that one pass over a hash's run sees the first occurrence in every document: these make up the number of documents that
hold it, and the very first is where its lines stay. A salt of the document follows the hash in the order of ranges: a
line that a third of all rows have is cut into runs of several ranges, whose sums are added up. What comes back is, for
each document, the runs of lines that stay, a bitmap compressed as its runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import keep, passing

SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5
#: Parts that the run of one hash may be cut into.
SALTS = 1024
_HASH = ["h1", "h2"]
_RUNS = "array<struct<start:int,length:int>>"


def _lines(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


def _text(text_column: str) -> F.Column:
    return F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))


def _named(docs: DataFrame, id_column: str, text_column: str, *columns: F.Column) -> DataFrame:
    """docs with what tells a row's document: its id, and a hash of the text, which tells apart rows of one id or none."""
    return docs.select(*columns, F.col(f"`{id_column}`").cast("long").alias("__doc"), F.xxhash64(_text(text_column)).alias("__twin"), _text(text_column).alias("__text"))


def line_hashes(named: DataFrame, least_length: int) -> DataFrame:
    """(h1, h2, doc, twin, position) of each line of named(__doc, __twin, __text) whose key has so many code points."""
    lines = named.select("__doc", "__twin", F.posexplode(_lines(F.col("__text"))).alias("position", "line"))
    keys = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).where(F.char_length("key") >= least_length)
    # Only in ASCII does lower() change A-Z alone; it is much faster than translate().
    plain = F.octet_length("key") == F.char_length("key")
    keys = keys.withColumn("key", F.when(plain, F.lower("key")).otherwise(F.translate("key", UPPER, LOWER)))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(12), "key").alias("h2"), F.col("__doc").alias("doc"), F.col("__twin").alias("twin"), "position")


def _holder() -> F.Column:
    """What counts as one document, in an order with the largest id last; rows without an id are told apart by their text."""
    return F.struct(F.col("doc").alias("doc"), F.when(F.col("doc").isNull(), F.col("twin")).alias("twin"))


def sorted_runs(hashes: DataFrame) -> DataFrame:
    """hashes in ranges of hash and salt, each sorted by document, the largest first, and position; `first` marks the
    first occurrence in each document."""
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64(_holder()), F.lit(SALTS)).cast("int"))
    ranges = salted.repartitionByRange(*_HASH, "salt")
    run = Window.partitionBy(*_HASH, "salt").orderBy(F.desc_nulls_last("doc"), F.desc("twin"), "position")
    return ranges.withColumn("before", F.lag(_holder()).over(run)).withColumn("first", F.col("before").isNull() | ~F.col("before").eqNullSafe(_holder())).drop("before")


def dropped_lines(hashes: DataFrame, least_documents: int) -> DataFrame:
    """(doc, twin, dropped): positions of the lines, in order, that so many documents have and a larger one keeps."""
    runs = keep(sorted_runs(hashes))
    # Runs are sorted, so that a task adds up a whole run to one row before anything is shuffled.
    keys = runs.groupBy(*_HASH).agg(F.count_if("first").alias("documents"), F.max(_holder()).alias("keeper"))
    keys = keep(keys.where(F.col("documents") >= least_documents).select(*_HASH, "keeper"))
    # Two plain tables: the join may split the rows of a line that very many documents have.
    drops = runs.join(keys, _HASH).where(~F.col("keeper").eqNullSafe(_holder()))
    return drops.groupBy("doc", "twin").agg(F.sort_array(F.collect_set("position")).alias("dropped"))


def _kept_runs(n_lines: F.Column, dropped: F.Column) -> F.Column:
    """Runs of lines between those that are dropped: (start, length), without empty ones."""
    ends = F.concat(dropped, F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda x: x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def _bitmaps(docs: DataFrame, id_column: str, text_column: str, least_length: int, least_documents: int, *columns: F.Column) -> DataFrame:
    """named rows (see _named) with n_lines, n_dropped and kept_runs."""
    with passing() as stay:
        drops = stay(keep(dropped_lines(line_hashes(_named(docs, id_column, text_column), least_length), least_documents)))
    named = _named(docs, id_column, text_column, *columns).withColumn("n_lines", F.size(_lines(F.col("__text"))).cast("long"))
    same = named["__doc"].eqNullSafe(drops["doc"]) & (named["__twin"] == drops["twin"])
    both = named.join(drops, same, "left").drop("doc", "twin")
    n = F.col("n_lines").cast("int")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("length"))).cast(_RUNS)
    both = both.withColumn("kept_runs", F.when(F.col("dropped").isNull(), whole).otherwise(_kept_runs(n, F.col("dropped")).cast(_RUNS)))
    return both.withColumn("n_dropped", F.coalesce(F.size("dropped"), F.lit(0)).cast("long")).drop("dropped")


def line_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, kept_runs), a row for each of docs: which lines stay, without the text.

    kept_runs lists the runs of lines that stay as (start, length), lines numbered from 0: the document's bitmap,
    compressed as its runs. text_hash (xxhash64) tells apart texts that share an id. See without_repeated_lines."""
    both = _bitmaps(docs, id_column, text_column, least_length, least_documents)
    return both.select(F.col("__doc").alias("doc_id"), F.col("__twin").alias("text_hash"), "n_lines", "n_dropped", "kept_runs")


def kept_text(text: F.Column, n_dropped: F.Column, runs: F.Column) -> F.Column:
    """A text's lines of these runs, joined by \\n."""
    # An array of one text, so that it is split once and not once a run.
    kept = F.transform(F.array(_lines(text)), lambda lines: F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))))
    return F.when(n_dropped == 0, text).otherwise(F.array_join(F.element_at(kept, 1), "\n"))


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Each row of docs with n_lines, n_dropped, kept_runs (see line_bitmaps) and kept_text.

    Texts are split at \\n; a line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    at least least_length code points that are found in least_documents documents lose all their lines but those of the
    document with the largest id. A null or empty text is one empty line. Texts are taken whole, whatever their length.
    Rows of one id are one document and lose or keep a key together; rows without an id are documents that are told
    apart by their text and come before all others. Repeats of a line within the keeping document stay. Columns of the
    four names, in any case, are replaced. An empty table gives an empty table."""
    new = ["n_lines", "n_dropped", "kept_runs", "kept_text"]
    own = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns) if c.lower() not in new]
    names = {f"__own_{i}": c for i, c in enumerate(docs.columns) if c.lower() not in new}
    both = _bitmaps(docs, id_column, text_column, least_length, least_documents, *own)
    both = both.withColumn("kept_text", kept_text(F.col("__text"), F.col("n_dropped"), F.col("kept_runs")))
    return both.select(*names, *new).withColumnsRenamed(names)
