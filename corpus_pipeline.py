"""From raw documents to packed training sequences, in five stages, each one operator of loomspan.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import jaccard_join, packing, pair_rank, source_mix, substring_dedup
from loomspan.llm.shared import discard, keep, passing, row_key


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns out of the way that an operator names its own results by (in any case), and how to name them
    back."""
    back = {f"__own_{i}": c for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranking classifier takes for good, as they came.

    A null text is judged as an empty one; a null id is judged, but not learned from. Long texts are judged whole.
    Repeated rows are judged alike, so that all or none stay. A score of exactly one half stays. Without labels all
    stay. An empty table gives an empty table; other columns, whatever their names, come through unchanged."""
    ranker = pair_rank.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    safe, back = _aside(docs, ("held_out", "score", "predicted"))
    # The texts go around Python's answer in the row itself, so that nothing has to be joined back.
    return pair_rank.classify(safe, ranker, with_text=True).where("predicted = 1").drop("held_out", "score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, as it came; one row of it.

    Null and blank texts are near nothing: all of them stay. Texts of fewer than five words are near equal ones only.
    Long texts are compared whole. Rows with one id and text count as one document and leave one row; rows without an
    id go by their text. An empty table gives an empty table; other columns come through unchanged."""
    safe, back = _aside(docs, ("n_shingles", "component_id"))
    grouped = jaccard_join.near_duplicates(safe).withColumn("__key", row_key("doc_id", "text"))
    first = grouped.where(F.col("component_id") == F.col("__key"))
    # Only repeated rows need the shuffle of texts that drops them.
    keys = docs.select(row_key("doc_id", "text").alias("k")).groupBy("k").count()
    if keys.where("count > 1").limit(1).count():
        first = first.dropDuplicates(["__key"])
    return first.drop("n_shingles", "component_id", "__key").withColumnsRenamed(back).select(*docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that are found more than once; n_chars follows the text.

    Every document stays, if with an empty text where all of it was repeated. A null text becomes an empty one. Long
    texts are treated whole. Rows that are there twice repeat each other and lose their windows. An empty table gives an
    empty table; other columns come through unchanged."""
    safe, back = _aside(docs, ("n_words", "n_removed", "n_spans", "kept_text", "kept_sha256"))
    out = substring_dedup.remove_repeats(safe).withColumnRenamed("kept_text", "text")
    out = out.withColumn("n_chars", F.length("text").cast("long")).drop("n_words", "n_removed", "n_spans", "kept_sha256")
    return out.withColumnsRenamed(back).select(*docs.columns)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, kept, cut at the budget or left out; n_chars follows the text.

    Documents without words, null texts among them, are of no budget and stay once. A null source is a source. Ties and
    repeated rows are in the order of a hash of id and text; equal rows are interchangeable. Only the document at a
    source's cut loses words, at its end. An empty table gives an empty table; other columns come through unchanged."""
    safe, back = _aside(docs, ("size", "source_size", "target", "taken"))
    out = source_mix.apply_mix(source_mix.mix(safe))
    return out.withColumn("n_chars", F.length("text").cast("long")).withColumnsRenamed(back).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence.

    A null text is an empty one: its end token alone. Only documents longer than a sequence are cut. Repeated rows, which
    the mix makes, are packed as often as they are there. An empty table gives an empty table; of other columns none is
    kept."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", source_mix_stage),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has written is read by the next one alone: it and all that the stage
    kept on its way are deleted when the next one has been written. The last stage's input stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing() as stay:
            docs = stay(keep(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
