"""Exact dedup by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z. Rows are first combined within each task (map-side
aggregation), then within salted digest groups, then the winners of the salts are combined globally. The grouping keys
hold the whole text at each stage, so a digest collision can never merge different texts. Rows look up their group by its
digest, large groups at several places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import fold_case, small, stored, table


PER_TASK = 1_000  # rows of a group that look it up in one place


def _parts() -> Column:
    return F.floor(F.col("group_size") / PER_TASK + 1).alias("parts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group stays. Null text counts as empty. Rows without an id are counted but win
    only over nothing: keep_id is null if no row of the group has an id. Repeated rows with the winning id all say kept.
    Other columns of docs are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), fold_case(F.col(text_col)).alias("content")).withColumn("digest", F.sha2("content", 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    )
    winners = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    by_digest = stored(
        winners.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("n").alias("group_size")),
        "exact-dedup",
    )
    # rows find their group by digest; a group of many rows is split over as many salts as its size asks for
    heavy = small(by_digest.filter(F.col("group_size") > PER_TASK).select("digest", _parts()))
    keyed = rows.select("id", "digest").join(heavy, "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)))
    groups = by_digest.filter("contents = 1").select("digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(0).cast("long"), _parts() - 1)).alias("part"))
    found = keyed.join(groups, ["digest", "part"]).select("id", "digest", "keep_id", "group_size")
    if not by_digest.filter("contents > 1").isEmpty():  # different texts with one digest: decide those by content
        clash = rows.join(by_digest.filter("contents > 1").select("digest"), "digest", "left_semi")
        found = found.unionByName(
            clash.join(winners.withColumnRenamed("n", "group_size"), ["digest", "content"]).select("id", "digest", "keep_id", "group_size")
        )
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM t
"""
