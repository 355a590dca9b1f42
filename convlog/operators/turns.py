"""Turns and recency windows. Windows partition by conversation, so one exchange serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by() -> WindowSpec:
    return Window.partitionBy("conv_id")


def ordered() -> WindowSpec:
    return by().orderBy("message_id")


def non_system(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("is_system"))


def turn_flags(messages: DataFrame) -> DataFrame:
    """completes: an assistant row whose previous non-system row is the user's."""
    last = F.last(F.when(~F.col("is_system"), F.col("is_user")), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("completes", ~F.col("is_system") & ~F.col("is_user") & F.coalesce(last, F.lit(False)))


def turn_segments(messages: DataFrame) -> DataFrame:
    """segment: rows after one completion up to and with the next share a number."""
    done = F.sum(F.col("completes").cast("long")).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return turn_flags(messages).withColumn("segment", F.coalesce(done, F.lit(0)))


def completed_turns(messages: DataFrame) -> DataFrame:
    return turn_flags(messages).groupBy("conv_id").agg(F.count_if("completes").alias("turns"))


def current_input(messages: DataFrame) -> DataFrame:
    """The last user row; conversations without one have no row."""
    return messages.filter("is_user and not is_system").groupBy("conv_id").agg(F.max("message_id").alias("current_input"))


def recent_window(messages: DataFrame, size: int, unit: str = "turns") -> DataFrame:
    """conv_id, current_input, retained_start, removable: the size-th user row (turns) or non-system row (messages) before
    the current input starts what stays; fewer: all stays; size 0: from the current input on."""
    counts = ~F.col("is_system") if unit == "messages" else F.col("is_user") & ~F.col("is_system")
    current = F.max(F.when(F.col("is_user") & ~F.col("is_system"), F.col("message_id"))).over(by())
    marked = messages.select("conv_id", "message_id", "is_system", counts.alias("counts"), current.alias("current_input")).filter("current_input is not null")
    units = F.sum((F.col("counts") & (F.col("message_id") < F.col("current_input"))).cast("long")).over(by().orderBy(F.col("message_id").desc()))
    placed = marked.withColumn("units", units)
    start = F.max(F.when(F.col("counts") & (F.col("message_id") < F.col("current_input")) & (F.col("units") == size), F.col("message_id"))).over(by())
    start = F.col("current_input") if size <= 0 else F.coalesce(start, F.lit(0))
    return placed.withColumn("retained_start", start).groupBy("conv_id").agg(
        F.first("current_input").alias("current_input"), F.first("retained_start").alias("retained_start"), F.count_if((F.col("message_id") < F.col("retained_start")) & ~F.col("is_system")).alias("removable")
    )


def align_to_turn(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """conv_id, aligned: starts (conv_id, start) moved to the start of a turn: past system rows, then to the user row there
    or the nearest one before it, or 0; unchanged at the ends and where only system rows follow."""
    rows = messages.join(starts, "conv_id")
    first = F.min(F.when((F.col("message_id") >= F.col("start")) & ~F.col("is_system"), F.col("message_id"))).over(by())
    rows = rows.withColumn("first", first).withColumn("n", F.max("message_id").over(by()) + 1)
    found = rows.groupBy("conv_id").agg(
        F.first("start").alias("start"),
        F.first("first").alias("first"),
        F.first("n").alias("n"),
        F.max(F.when(F.col("is_user") & ~F.col("is_system") & (F.col("message_id") <= F.col("first")), F.col("message_id"))).alias("user"),
    )
    clamped = F.greatest(F.lit(0), F.least("n", "start"))
    kept = (clamped <= 0) | (clamped >= F.col("n")) | F.col("first").isNull()
    return found.select("conv_id", F.when(kept, clamped).otherwise(F.coalesce("user", F.lit(0))).alias("aligned"))


def safe_start(messages: DataFrame, covered: DataFrame, size: int, unit: str = "turns") -> DataFrame:
    """conv_id, safe_start: the window's start, moved back so that no row after covered (conv_id, covered; none: nothing is
    covered) is dropped, and to a turn for windows of turns."""
    window = recent_window(messages, size, unit).join(covered, "conv_id", "left")
    starts = window.select("conv_id", F.least("retained_start", F.greatest(F.lit(0), F.coalesce(F.col("covered") + 1, F.lit(0)))).alias("start"))
    if unit != "turns":
        return starts.withColumnRenamed("start", "safe_start")
    return align_to_turn(messages, starts).withColumnRenamed("aligned", "safe_start")


def ready_target(messages: DataFrame, size: int, unit: str = "turns") -> DataFrame:
    """conv_id, target: the last row that may be rolled up, as if a new user row followed; -1 if the last non-system row is
    the user's or nothing may go."""
    ends = messages.groupBy("conv_id").agg(F.max("message_id").alias("last"), F.max_by("is_user", F.when(~F.col("is_system"), F.col("message_id"))).alias("open"), F.count_if(~F.col("is_system")).alias("n"))
    virtual = ends.select("conv_id", (F.col("last") + 1).alias("message_id"), F.lit(True).alias("is_user"), F.lit(False).alias("is_system"))
    window = recent_window(messages.select("conv_id", "message_id", "is_user", "is_system").unionByName(virtual), size, unit)
    ok = (F.col("n") > 0) & ~F.col("open") & (F.col("removable") > 0)
    return ends.join(window, "conv_id").select("conv_id", F.when(ok, F.col("retained_start") - 1).otherwise(-1).alias("target"))


def non_system_count(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """conv_id, start, end, n: non-system rows in [start, end) of ranges (conv_id, start, end)."""
    inside = (F.col("message_id") >= F.col("start")) & (F.col("message_id") < F.col("end")) & ~F.col("is_system")
    return messages.join(ranges, "conv_id").groupBy("conv_id", "start", "end").agg(F.count_if(inside).alias("n"))


def remove_rows(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose (conv_id, message_id) isn't in gone, in place."""
    return messages.join(gone.select("conv_id", "message_id"), ["conv_id", "message_id"], "left_anti")
