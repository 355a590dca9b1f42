"""What a request takes along of a log: the rows of the recency window behind one row with the summaries of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlog.functions.text import summary_block, token_estimate
from convlog.operators.lineage import ordered_text
from convlog.operators.rollup import rollup_due
from convlog.operators.tokens import sampled_tokens
from convlog.operators.turns import current_input, safe_start


def phase_start(messages: DataFrame, boundary: Column) -> DataFrame:
    """conv_id, phase_start: the last row up to the current input at which a phase begins; no row where none does."""
    upto = messages.join(current_input(messages), "conv_id").filter(boundary & (F.col("message_id") <= F.col("current_input")))
    return upto.groupBy("conv_id").agg(F.max("message_id").alias("phase_start"))


def carried_entries(messages: DataFrame, entries: DataFrame, boundary: Column | None, asks: Column | None) -> DataFrame:
    """The entries that a request carries: none that is deleted, and of level 1 only those from the current phase on, unless
    the current input asks for an earlier one (asks, over the columns of messages)."""
    live = entries.filter("not deleted")
    if boundary is None:
        return live
    inputs = messages.join(current_input(messages), "conv_id").filter("message_id = current_input").select("conv_id", F.coalesce(asks if asks is not None else F.lit(False), F.lit(False)).alias("asks"))
    known = live.join(phase_start(messages, boundary), "conv_id", "left").join(inputs, "conv_id", "left")
    keeps = F.col("phase_start").isNull() | F.coalesce("asks", F.lit(False)) | (F.col("level") > 1) | (F.col("start_id") >= F.col("phase_start"))
    return known.filter(keeps).select(*entries.columns)


def assembled(messages: DataFrame, entries: DataFrame, size: int, boundary: Column | None = None, asks: Column | None = None) -> DataFrame:
    """conv_id, place, name, text: the rows from the window's safe start on and all system rows, in place, and before the first
    of the window one row `history` with the blocks of the entries carried. Logs of which nothing goes keep all rows."""
    covered = entries.groupBy("conv_id").agg(F.max("end_id").alias("covered"))
    start = safe_start(messages, covered, size)
    kept = messages.join(start, "conv_id").filter("message_id >= safe_start or is_system").select("conv_id", F.col("message_id").cast("double").alias("place"), "name", "text")
    block = summary_block(F.col("text"), F.col("start_id"), F.col("end_id"), F.col("level"))
    carried = carried_entries(messages, entries, boundary, asks).join(start, "conv_id").filter("safe_start > 0")
    history = carried.groupBy("conv_id").agg((F.first("safe_start") - 0.5).alias("place"), ordered_text(block, F.col("start_id"), "\n").alias("text"))
    return kept.unionByName(history.select("conv_id", "place", F.lit("history").alias("name"), "text"))


def inspections(messages: DataFrame, entries: DataFrame, size: int, boundary: Column | None = None, asks: Column | None = None, groups: tuple[int, int] = (10, 5), kind: str = "normal") -> DataFrame:
    """One row a log on what assembled() does to it: conv_id, kind, safe_start, retained_end (the current input), removed,
    tokens_removed (from at most 200 rows, evenly spaced), entries_carried, entries_left, tokens_injected, tokens_saved,
    covered (-1: nothing) and warnings (rollup_due, where a level holds more than its group)."""
    covered = entries.groupBy("conv_id").agg(F.max("end_id").alias("covered"))
    start = safe_start(messages, covered, size)
    gone = messages.join(start, "conv_id").filter("message_id < safe_start and not is_system")
    removed = gone.groupBy("conv_id").agg(F.count("*").alias("removed")).join(sampled_tokens(gone).withColumnRenamed("tokens", "tokens_removed"), "conv_id")
    block = summary_block(F.col("text"), F.col("start_id"), F.col("end_id"), F.col("level"))
    history = carried_entries(messages, entries, boundary, asks).groupBy("conv_id").agg(F.count("*").alias("carried"), token_estimate(ordered_text(block, F.col("start_id"), "\n")).alias("tokens"))
    live = entries.filter("not deleted").groupBy("conv_id").agg(F.count("*").alias("live"))
    due = rollup_due(entries, *groups).select("conv_id", F.array(F.lit("rollup_due")).alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    some = F.col("safe_start") > 0
    parts = start.join(current_input(messages), "conv_id")
    for more in (removed, history, live, due, covered):
        parts = parts.join(more, "conv_id", "left")
    out = parts.select(
        "conv_id", F.lit(kind).alias("kind"), "safe_start", F.col("current_input").alias("retained_end"), zero(F.col("removed")).alias("removed"), zero(F.col("tokens_removed")).alias("tokens_removed"),
        zero(F.when(some, F.col("carried"))).alias("entries_carried"), zero(F.when(some, zero(F.col("live")) - zero(F.col("carried")))).alias("entries_left"), zero(F.when(some, F.col("tokens"))).alias("tokens_injected"),
        F.coalesce("covered", F.lit(-1)).cast("long").alias("covered"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    return out.withColumn("tokens_saved", F.greatest(F.col("tokens_removed") - F.col("tokens_injected"), F.lit(0)))
