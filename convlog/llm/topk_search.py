"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector becomes the bits of its signs, cut into segments; an index row is (segment, value, id, code). If a code lies
within m * (r + 1) - 1 bits of a query, one of its m segments lies within r bits of the query's. So a round probes, for
the queries still open, all segment values at distance exactly r; what is met is verified on whole codes, and only the k
best of a query are kept. A query is closed when its k-th distance is below m * (r + 1): nothing outside what has been
probed can be nearer or equal. Each round's open queries and best lists are written tables.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.llm.common import stored, table


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above 0; missing components count as 0."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.coalesce(F.get(vector, i), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )


def _segments(code: Column, segments: int, bits: int) -> Column:
    width = bits // segments
    return F.array(*(F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s in range(segments)))


def _masks(spark: SparkSession, width: int, radius: int) -> DataFrame:
    """All values of so many set bits: a table whose size depends on the width and the radius alone."""
    return spark.createDataFrame([(sum(1 << b for b in c),) for c in combinations(range(width), radius)], "mask long")


def topk_search(queries: DataFrame, rows: DataFrame, k: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k rows nearest to each query by Hamming distance, ties by smaller id.

    Both sides are (id, code), codes of so many bits in a long. A row isn't its own neighbour (equal ids). Rows or
    queries with a null id or code are left out. Repeated (id, code) rows count once. Fewer than k other rows: all of
    them; an empty side gives an empty result, and other columns are ignored. Rows of one code are met together: the index holds each code once with its k + 1 smallest ids, since no query
    can return more of one code. Segments get about as many bits as the number of rows has, if their number isn't given. A query whose
    neighbours are far probes ever more values of a segment, at the worst all of them.
    """
    spark = rows.sparkSession
    rows = rows.filter("id is not null and code is not null").select("id", "code").distinct()
    near = Window.partitionBy("code", "part").orderBy("id")
    # two steps, so that no task ranks a whole hot code: the k + 1 smallest ids of each part, then of all
    parted = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    kept = parted.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= k + 1)
    codes = stored(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "topk-codes")
    if segments is None:
        segments = min((1, 2, 4, 8, 16), key=lambda m: abs(bits / m - math.log2(max(codes.count(), 2))))
    width = bits // segments
    index = stored(codes.select(F.explode(_segments(F.col("code"), segments, bits)).alias("s"), "code", F.col("ids")[0].alias("first")).select("s.segment", "s.value", "code", "first"), "topk-index")
    total = rows.agg(F.count_distinct("id")).first()[0]
    open_ = stored(queries.filter("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct(), "topk-open")
    best = None
    done = []
    pair = Window.partitionBy("query_id").orderBy("distance", "id")
    for radius in range(width + 1):
        probes = open_.select("query_id", "query", F.explode(_segments(F.col("query"), segments, bits)).alias("s")).crossJoin(F.broadcast(_masks(spark, width, radius)))
        probes = probes.select("query_id", "query", F.col("s.segment").alias("segment"), F.col("s.value").bitwiseXOR(F.col("mask")).alias("value"))
        met = index.join(probes, ["segment", "value"])
        # a code is taken up once: in the first of the segments in which it is nearest
        apart = [F.bit_count(F.shiftrightunsigned(F.col("query").bitwiseXOR(F.col("code")), s * width).bitwiseAND(F.lit((1 << width) - 1))) for s in range(segments)]
        met = met.filter((F.array_min(F.array(*apart)) == radius) & (F.array_position(F.array(*apart), radius) == F.col("segment") + 1))
        met = met.select("query_id", "code", "first", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        # every code has an id, so those of the k + 1 first codes (one may be the query's own) are enough
        close = met.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "first"))).filter(F.col("r") <= k + 1)
        found = close.join(codes, "code").select("query_id", F.explode("ids").alias("id"), "distance").filter("id <> query_id")
        if best is not None:
            found = found.unionByName(best.select("query_id", "id", "distance"))
        ranked = found.withColumn("rank", F.row_number().over(pair)).filter(F.col("rank") <= k)
        best = stored(ranked, "topk-best")
        # nothing that hasn't been met is nearer than segments * (radius + 1)
        sure = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("worst")).filter((F.col("worst") < segments * (radius + 1)) & (F.col("n") >= min(k, max(total - 1, 0))))
        done.append(best.join(sure.select("query_id"), "query_id"))
        open_ = stored(open_.join(sure.select("query_id"), "query_id", "left_anti"), "topk-open")
        best = best.join(open_.select("query_id"), "query_id")
        if radius == width or open_.isEmpty():
            break
    out = done[0]
    for d in [*done[1:], best]:
        out = out.unionByName(d)
    return out.select("query_id", "rank", "id", "distance")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    rows = stored(rows, "topk-rows")
    return topk_search(rows.filter("id % 50 = 0"), rows).withColumnRenamed("id", "vec_id")


OP10_SQL = """
WITH c AS (
  SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, bit_count(xor(q.code, r.code)) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id AND q.vec_id % 50 = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d
)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance::INTEGER AS distance FROM k WHERE rank <= 10
"""
