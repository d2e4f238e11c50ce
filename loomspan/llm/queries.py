"""The queries of the subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import oracles
from loomspan.llm.shared import documents


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.lm_score import score

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.suffix_dedup import remove_repeats

    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), with_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.substring_dedup import remove_repeats

    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.pair_rank import classify, learn

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "held_out", "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.packing import pack

    out = pack(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.embedding_dedup import near_duplicates

    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.source_mix import mix

    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.fertility import quality_rules

    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*columns, "chars_per_token", "tokens_per_word", "byte_share", "token_entropy")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.divergence import divergence

    return divergence(documents(spark, sf_dir).select("text", "lang", "source"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.line_dedup import without_repeated_lines

    out = without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.centroid_cluster import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": oracles.DIVERGENCE, "op12_line_dedup": oracles.LINE_DEDUP, "op13_centroid_clustering": oracles.clustering()}
