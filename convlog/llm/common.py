"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset: a temporary one in local mode, as in tests; an
    error on a cluster, whose executors don't share the driver's folders."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
    return context._jsc.sc().getCheckpointDir().get()


SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # a stored table needs its shuffles no longer
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),  # a Python worker's memory, however long texts are
}


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS for the jobs inside; the session's own values come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage and survives lost executors. The job's
    shuffle files go as soon as it has ended. With `by` the rows lie in a folder for each value of that column."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        root = scratch_dir(spark).partition(":")[2].lstrip("/") or scratch_dir(spark).lstrip("/")
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if root in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of runs without white space (space and U+0009..U+000D); null counts as none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


BROADCAST = 16 << 20  # bytes of a table's files, with compression


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, a stored table, with a broadcast hint if its files have no more than BROADCAST bytes and it has no more than so
    many rows; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if file_bytes(df) <= BROADCAST and df.count() <= rows else df


def file_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer counts for a stored table: its files, times the width of the columns taken."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable, itself included) for the nodes of edges (a, b).

    Alternating large and small stars: each round hangs neighbours below the smallest one, until nothing changes. Only
    joins and minima by node; each round is written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "components")
    sums = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = edges.agg(*sums).first()
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small_ = down.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = stored(small_.filter("a <> b").distinct(), "components")
        dropped(edges)
        edges, before, now = after, now, after.agg(*sums).first()
        if now == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
