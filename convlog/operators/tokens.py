"""Token accounting: sampled estimates and proportional shares of a budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions.text import token_estimate, trim


def counted_tokens(rows: DataFrame, text_col: str = "text", counter: Callable[[str], float] | None = None) -> DataFrame:
    """rows with tokens and estimated: what counter says of each text, blanks at its ends aside, rounded; the estimate where
    there is no counter, or it fails or gives no finite number of 0 or more. Blank and null texts have 0, not estimated.
    Equal texts are counted once: distinct ones go through the counter, and their numbers are joined back by digest."""
    text = trim(F.coalesce(F.col(text_col), F.lit("")))
    guess = F.when(text == "", F.lit(0)).otherwise(token_estimate(text)).cast("long")
    if counter is None:
        return rows.withColumn("tokens", guess).withColumn("estimated", text != "")

    @F.pandas_udf("double")
    def told(texts: pd.Series) -> pd.Series:
        def one(t: str) -> float | None:
            try:
                n = float(counter(t))
            except Exception:  # noqa: BLE001 - a counter that fails is answered by the estimate
                return None
            return n if 0 <= n < float("inf") else None

        return texts.map(one).astype("float64")

    keyed = rows.withColumn("_digest", F.sha2(text, 256))
    distinct = keyed.filter(text != "").groupBy("_digest").agg(F.first(text).alias("_t"))
    known = distinct.select("_digest", F.floor(told(F.col("_t")) + 0.5).cast("long").alias("_n"))
    out = keyed.join(known, "_digest", "left").withColumn("tokens", F.coalesce("_n", guess)).withColumn("estimated", F.col("_n").isNull() & (text != ""))
    return out.select(*rows.columns, "tokens", "estimated")


def sampled_tokens(rows: DataFrame, samples: int = 200) -> DataFrame:
    """conv_id, tokens: an estimate from at most so many evenly spaced rows (conv_id, message_id, text), scaled up."""
    by = Window.partitionBy("conv_id")
    placed = rows.select("conv_id", "text", (F.row_number().over(by.orderBy("message_id")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    k = F.least("n", F.lit(max(1, samples)))
    spots = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda s: F.when(k == 1, F.lit(0).cast("long")).otherwise(F.floor(s * (F.col("n") - 1) / (k - 1) + 0.5)))
    times = F.size(F.filter(spots, lambda p: p == F.col("i")))
    taken = placed.withColumn("times", times).filter("times > 0")
    total = F.sum(token_estimate(F.coalesce("text", F.lit(""))) * F.col("times"))
    return taken.groupBy("conv_id").agg(F.floor(total * F.first("n") / F.least(F.first("n"), F.lit(max(1, samples))) + 0.5).alias("tokens"))


def allocate(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """seeds (keys, idx, tokens, budget) with share: the tokens if they fit the budget, else shares in proportion, rounded
    down, and what is left to the largest remainders, ties by idx."""
    w = Window.partitionBy(*keys)
    tokens, budget = F.greatest(F.lit(0), F.floor(F.col("tokens") + 0.5)), F.greatest(F.lit(0), F.floor(F.col("budget") + 0.5))
    rows = seeds.withColumn("t", tokens).withColumn("b", budget).withColumn("total", F.sum("t").over(w))
    exact = F.when(F.col("total") > 0, F.col("t") * F.col("b") / F.col("total")).otherwise(0.0)
    rows = rows.withColumn("low", F.floor(exact)).withColumn("rest", exact - F.floor(exact))
    rows = rows.withColumn("left", F.col("b") - F.sum("low").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.col("rest").desc(), "idx")))
    share = F.when((F.col("total") == 0) | (F.col("b") == 0), 0).when(F.col("total") <= F.col("b"), F.col("t")).otherwise(F.col("low") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))
    return rows.withColumn("share", share.cast("long")).select(*seeds.columns, "share")


def percentages(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Shares above 0 with their percentage of the group's total, in order of idx."""
    return shares.filter("share > 0").withColumn("percent", F.col("share") * 100.0 / F.sum("share").over(Window.partitionBy(*keys)))
