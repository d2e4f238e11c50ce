"""What the operators share on the Spark side: tables kept in the shared folder and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, as in tests, and all runs
    in this one process, a local folder; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "loomspan-scratch")


_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


def keep(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage is cut, a lost executor costs nothing,
    and the shuffle files of the write are removed as soon as it ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/loomspan/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables that keep() wrote and that nothing reads any more."""
    for df in kept:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose kept tables are deleted as it ends, but for those named by the function that it gives: these
    belong to the scope around it (and, if there is none, to the result that reads them)."""
    own: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), own))

    def stay(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        if len(scopes := _scopes.get()) > 1:
            scopes[-2].append(df)
        return df

    try:
        yield stay
    finally:
        _scopes.reset(token)
        discard(*own)


def row_key(id_column: str, text_column: str) -> F.Column:
    """The id, or a hash of the text where the id is null."""
    return F.coalesce(F.col(id_column).cast("long"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), by alternating large-star and small-star rounds.

    Returns (node, component) with the smallest node of each component, for nodes that have an edge to
    another node, as a kept table. Every round is two partial aggregates and two joins. The aggregates are written
    before they are joined, so that both sides of a join are plain shuffles and AQE may split those of a hub; nothing
    is collected but one checksum a round."""
    with passing() as stay:
        edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        before = None
        for _ in range(most_rounds):
            with passing() as on:
                both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
                # Large star: a node's larger neighbours move to the smallest of its neighbourhood.
                large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                large = keep(large.where("u <> v").distinct())
                # Small star: a node and its smaller neighbours move to the smallest of them.
                low = keep(large.groupBy("u").agg(F.min("v").alias("m")))
                small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                after = on(keep(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()))
            discard(edges)
            edges = after
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("the components did not settle")
        return stay(keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        )))
