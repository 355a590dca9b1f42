"""Mixing sources to target weights by entropy balancing.

Each source gets a share of the corpus's words as its target. Among all rates of its documents that meet the target, the
ones nearest to taking every document once (in relative entropy, rates bounded by the largest number of copies) are
exponentially tilted: rate = min(copies, exp(lambda * size / mean size)). The dual of that problem is convex with one
multiplier a source; Newton steps, kept within a bracket, find it. Each step is one Spark aggregation over the counts of
documents by source and size. Rates are then rounded to whole copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.llm.common import n_words, small, stored, table

BLOCKS = 64  # parts in which equal-sized documents of a source are ranked
STEPS = 60


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sid, source, source_size, target from rows (source, size).

    Sources in code-point order, null last, get the weights in turn and share all words by weight; a target stops at
    most times its source's size, and the excess is shared by weight among the others. The running sums are over one
    row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("most", most * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", "sid")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(0, Window.unboundedFollowing)
    )
    ranked = ranked.withColumn("level", F.when(level <= F.col("fills_at"), level))  # the first that isn't full sets the level
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy("fills_at", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("fills_at") < F.col("level")), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return ranked.select("sid", "source", "source_size", F.least(target, F.col("most")).alias("target"))


def tilt(bins: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """sid, lam: the multiplier of each source, null where the target takes all that there is.

    Sums are of decimals, so that reruns agree to the last digit whatever the order of the tasks.
    """
    free = sources.filter(f"target > 0 and target < {most} * source_size * (1 - 1e-12)")
    state = stored(free.select("sid", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off")), "mixing-state")
    few = small(state) is not state
    for _ in range(STEPS):
        rate = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(math.log(most))))
        words = F.col("n") * F.col("size") * rate
        steep = F.when(F.col("lam") * F.col("z") < math.log(most), words * F.col("z")).otherwise(0.0)
        found = (
            bins.join(F.broadcast(state) if few else state, "sid")
            .groupBy("sid")
            .agg(F.sum(words.cast("decimal(28,6)")).cast("double").alias("words"), F.sum(steep.cast("decimal(28,6)")).cast("double").alias("steep"))
        )
        gap = F.col("words") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        next_ = state.join(found, "sid").select("sid", "target", "lam", low.alias("low"), high.alias("high"), (F.abs(gap) / F.col("target")).alias("off"), (F.col("lam") - gap / F.nullif(F.col("steep"), F.lit(0.0))).alias("newton"))
        inside = (F.col("newton") > F.coalesce("low", F.col("newton") - 1)) & (F.col("newton") < F.coalesce("high", F.col("newton") + 1)) & (F.abs(F.col("newton") - F.col("lam")) < 8)
        halved = (F.coalesce("low", F.col("high") - 2 - 2 * F.abs("high")) + F.coalesce("high", F.col("low") + 2 + 2 * F.abs("low"))) / 2
        lam = F.when(F.col("off") < 1e-9, F.col("lam")).when(inside, F.col("newton")).otherwise(halved)
        state = stored(next_.select("sid", "target", lam.alias("lam"), "low", "high", "off"), "mixing-state")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < 1e-9:
            break
    return state.select("sid", "lam")


def _whole(bins: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of each size of one source, from large to small; each takes on what the larger ones left over. A
    source with w words has fewer than sqrt(2 w) different sizes, so the loop is over a small table."""
    bins = bins.sort_values("size", ascending=False, kind="stable")
    left, copies = 0.0, []
    for size, n, rate, most in zip(bins["size"], bins["n"], bins["rate"], bins["most"], strict=True):
        left += n * rate * size
        k = int(min(max(math.floor(left / size + 0.5), 0), most * n)) if size else 0
        left -= k * size
        copies.append(k)
    # one copy more of a size and one less of another bring what is left nearer to nothing
    sizes, k, n = bins["size"].to_numpy(), np.array(copies, np.int64), bins["n"].to_numpy()
    more = np.append(sizes[(k < bins["most"].to_numpy() * n) & (sizes > 0)], 0)[::-1]
    less = np.append(sizes[(k > 0) & (sizes > 0)], 0)
    near = np.clip(np.searchsorted(more, left + less), 1, len(more) - 1) if len(more) > 1 else np.zeros(len(less), np.int64)
    near = np.where(np.abs(more[near] - less - left) < np.abs(more[near - 1] - less - left), near, near - 1) if len(more) > 1 else near
    pick = int(np.argmin(np.abs(more[near] - less - left)))
    if abs(more[near[pick]] - less[pick] - left) < abs(left):
        k = k + (sizes == more[near[pick]]) * (sizes > 0) - (sizes == less[pick]) * (sizes > 0)
    copies = k
    return bins[["sid", "size", "n"]].assign(copies=np.array(copies, np.int64))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies, taken: one row per input row.

    size counts the words of the whole text (null or empty: 0 words, no copies); a null source is a source of its own.
    No document is taken more than most times. Equal documents share the copies of their size by hash and id; rows with
    the same id are ranked in any order, since nothing tells them apart. An empty table gives an empty result.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mixing-sizes")
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-counts")
    sources = stored(source_targets(counts.select("source", (F.col("n") * F.col("size")).alias("size")), weights, most), "mixing-sources")
    keyed = counts.join(small(sources), counts["source"].eqNullSafe(sources["source"])).drop("source")
    mean = F.col("source_size") / F.sum("n").over(Window.partitionBy("sid"))
    bins = stored(keyed.select("sid", "size", "n", "source_size", "target", mean.alias("mean")).withColumn("z", F.col("size") / F.nullif(F.col("mean"), F.lit(0.0))), "mixing-bins")
    lam = tilt(bins.filter("size > 0"), sources, most)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") == 0, 0.0).when(F.col("lam").isNull(), float(most)).otherwise(F.exp(F.least(F.col("lam") * F.col("z"), F.lit(math.log(most)))))
    rated = bins.join(small(lam), "sid", "left").select("sid", "size", "n", rate.alias("rate"), F.lit(most).alias("most"))
    whole = stored(rated.groupBy("sid").applyInPandas(_whole, "sid int, size long, n long, copies long"), "mixing-copies")

    named = sizes.join(small(sources), sizes["source"].eqNullSafe(sources["source"])).select("id", sources["source"], "sid", "size", "source_size", "target")
    placed = named.join(small(whole), ["sid", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    before = placed.groupBy("sid", "size", "block").agg(F.count("*").alias("in_block"))
    before = before.withColumn("before", F.coalesce(F.sum("in_block").over(Window.partitionBy("sid", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.join(before, ["sid", "size", "block"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("sid", "size", "block").orderBy("id")))
    copies = F.expr("copies div n") + F.when(F.col("rank") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return ranked.withColumn("copies", copies).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
