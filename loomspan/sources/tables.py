"""Tables that a run reads and writes: catalogues that may be absent, reports, artifacts."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = "id string, url string, created timestamp, rank int, tags array<string>"
TEMPLATE_VERSIONS = "template_id string, version int, created timestamp, payload string"
KNOWLEDGE = "url string, category string, key string, value string"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one of that schema if there is none yet."""
    fs_path, fs = _file_system(spark, path)
    if not fs.exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path, fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions at path that were written whole, in order (see commit_batch)."""
    folder, fs = _file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    whole = [n for n in names if n.startswith("batch=") and fs.exists(_file_system(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def commit_batch(spark: SparkSession, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame], keep: int = 2) -> bool:
    """The table at path after a micro-batch: merge(table before) written as version batch_id; False, and nothing done, if
    that version or a later one is there, so that a batch that is replayed after a failure changes nothing. A version that
    was cut off has no _SUCCESS: it does not count and is written over. The last `keep` versions stay, for readers."""
    found = batch_numbers(spark, path)
    if not found:
        raise ValueError(f"there is no table at {path}: write its first version, such as batch=-1")
    if found[-1] >= batch_id:
        return False
    merge(spark.read.parquet(f"{path}/batch={found[-1]}")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for number in [*found, batch_id][:-keep]:
        old, fs = _file_system(spark, f"{path}/batch={number}")
        fs.delete(old, True)
    return True


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={batch_numbers(spark, path)[-1]}")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; equal columns on both sides."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*current.columns), F.struct("__new", order)).alias("r"))
    return best.select("r.*")


def write_report(df: DataFrame, path: str, run_column: str = "run_id") -> None:
    """A JSON report, a folder for each run."""
    df.write.mode("overwrite").partitionBy(run_column).json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small aggregate as a table; `most` rows at most."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, n_bytes) of files(path, content): a checksum for each, in the JVM."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


def verify(manifest_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of a manifest against files: valid, missing, changed or unlisted."""
    m, f = manifest_.select("path", F.col("sha256").alias("expected")), manifest(files).select("path", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("found") != F.col("expected"), "changed").otherwise("valid")
    return m.join(f, "path", "full_outer").select("path", status.alias("status"))


def unzip(archives: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """(path, member, content) of archives(path, content), such as spark.read.format("binaryFile") gives.

    Members that would leave the target folder and those above most_bytes are left out; a broken archive has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    name = posixpath.normpath(info.filename)
                    if info.is_dir() or name.startswith(("/", "..")) or info.file_size > most_bytes:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([archive.read(info)], pa.binary())], ["path", "member", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary")


# Endings of text files.
TEXT_KINDS = ("txt", "md", "markdown", "csv", "json", "html", "htm", "rtf")


def document_kind() -> F.Column:
    """pdf, docx, a declared text ending, or txt for what decodes as UTF-8; null otherwise. Of columns path, content."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    return (
        F.when(head == "25504446", "pdf")
        .when(head == "504B0304", F.when(F.instr(F.col("content").cast("string"), "word/document.xml") > 0, "docx"))
        .when(ending.isin(*TEXT_KINDS), ending)
        .when(F.is_valid_utf8(F.col("content").cast("string")), "txt")
    )


def localize_manifest() -> F.Column:
    """A web-app manifest (column json) with its icons' sources in assets/; as it is if it can't be read."""
    icons = T.StructType([T.StructField("icons", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    parsed = F.from_json("json", icons)
    local = lambda m: F.transform_values(m, lambda k, v: F.when((k == "src") & ~v.rlike("^(data:|assets/)"), F.concat(F.lit("assets/"), F.regexp_extract(v, "([^/?#]*)[?#]?[^/]*$", 1))).otherwise(v))
    return F.when(parsed["icons"].isNotNull(), F.to_json(F.struct(F.transform(parsed["icons"], local).alias("icons")))).otherwise(F.col("json"))
