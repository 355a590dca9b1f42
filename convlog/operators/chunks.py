"""Bounded chunks of a message log: windows where only turns and phases bound them, pointers from chunk to chunk where
characters do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions.text import utf16_length
from convlog.operators.turns import by, ordered, turn_flags
from convlog.store import dropped, stored


def plan_by_turns(messages: DataFrame, turns: int, boundary: Column | None = None) -> DataFrame:
    """conv_id, chunk, start_id, end_id, turns_done: a chunk closes with its last completed turn; a boundary row (a new
    phase) starts a new one. For logs in which no limit on characters can bind: windows alone."""
    rows = turn_flags(messages).withColumn("phase", F.sum((boundary if boundary is not None else F.lit(False)).cast("long")).over(ordered()))
    phase = Window.partitionBy("conv_id", "phase").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("completes").cast("long")).over(phase), F.lit(0))
    chunks = rows.withColumn("part", F.floor(before / turns)).groupBy("conv_id", "phase", "part").agg(
        F.min("message_id").alias("start_id"), F.max("message_id").alias("end_id"), F.count_if("completes").alias("turns_done")
    )
    return chunks.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("start_id")) - 1).cast("long").alias("chunk"), "start_id", "end_id", "turns_done")


BLOCK_ROWS, BLOCK_TURNS = 1 << 14, 1 << 12  # of a log that one task has at once


def _numbered_turns(messages: DataFrame, boundary: Column) -> DataFrame:
    """conv_id, message_id, chars, completes, new_phase, turns and total of each row: completed turns and characters up to it.

    Sums run inside blocks of a log's rows; what a block begins with comes from a row a block, so a log of any length is
    spread over many tasks.
    """
    size = utf16_length(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "message_id", "is_user", "is_system", size.alias("chars"), F.coalesce(boundary, F.lit(False)).alias("new_phase"))
    rows = rows.withColumn("block", F.floor(F.col("message_id") / BLOCK_ROWS))
    keys, inside = ["conv_id", "block"], Window.partitionBy("conv_id", "block").orderBy("message_id")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(~F.col("is_system"), F.col("is_user"))
    ends = rows.groupBy(*keys).agg(F.max_by("is_user", F.when(~F.col("is_system"), F.col("message_id"))).alias("said"))
    ends = ends.select(*keys, F.last("said", ignorenulls=True).over(before).alias("carried"))
    last = F.coalesce(F.last(said, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    rows = rows.join(ends, keys).withColumn("completes", ~F.col("is_system") & ~F.col("is_user") & F.coalesce(last, F.lit(False)))
    done = F.col("completes").cast("long")
    sums = rows.groupBy(*keys).agg(F.sum(done).alias("t"), F.sum("chars").alias("c"))
    sums = sums.select(*keys, *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(name) for x, name in (("t", "turns_before"), ("c", "chars_before"))))
    rows = rows.join(sums, keys)
    return rows.select("conv_id", "message_id", "chars", "completes", "new_phase", (F.col("turns_before") + F.sum(done).over(inside)).alias("turns"), (F.col("chars_before") + F.sum("chars").over(inside)).alias("total"))


def chunk_pointers(messages: DataFrame, turns: int, chars: int, boundary: Column | None = None) -> DataFrame:
    """conv_id, start_id, end_id, planned_end, next_id for each row at which a chunk can start: the first of a log, those
    after a completed turn, and boundary rows. planned_end is where the chunk would end without a phase that cuts it.

    A chunk that starts there ends at one of the next `turns` completions: the first with `chars` characters if it has just
    so many or is the first turn, else the one before it; or the last of them. Where the log ends first it ends with the log,
    or with the last completion if the rest would pass the limit.
    """
    rows = _numbered_turns(messages, boundary if boundary is not None else F.lit(False))
    ends = rows.groupBy("conv_id").agg(F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"), F.sum("chars").alias("whole"))
    none, no = F.lit(None).cast("long"), F.lit(False)
    done = rows.filter("completes")
    closed = done.select("conv_id", (F.col("turns") - 1).alias("key"), F.col("message_id").alias("at"), F.lit(False).alias("starts"), none.alias("base"), "total", no.alias("phase"))
    after = done.join(ends, "conv_id").filter("message_id < last_id").select("conv_id", F.col("turns").alias("key"), (F.col("message_id") + 1).alias("at"), F.lit(True).alias("starts"), F.col("total").alias("base"), none.alias("total"), no.alias("phase"))
    first = ends.select("conv_id", F.lit(0).cast("long").alias("key"), F.col("first_id").alias("at"), F.lit(True).alias("starts"), F.lit(0).cast("long").alias("base"), none.alias("total"), no.alias("phase"))
    cuts = rows.filter("new_phase").select("conv_id", (F.col("turns") - F.col("completes").cast("long")).alias("key"), F.col("message_id").alias("at"), F.lit(True).alias("starts"), (F.col("total") - F.col("chars")).alias("base"), none.alias("total"), F.lit(True).alias("phase"))
    every = closed.unionByName(after).unionByName(first).unionByName(cuts)
    # the first turns behind a block are shown to it too
    own = F.floor(F.col("key") / BLOCK_TURNS)
    shown = every.withColumn("block", F.explode(F.when((own > 0) & (F.col("key") % BLOCK_TURNS < turns), F.array(own, own - 1)).otherwise(F.array(own)))).withColumn("here", F.col("block") == own)
    block = Window.partitionBy("conv_id", "block")
    ahead = F.collect_list(F.when(~F.col("starts"), F.struct("key", "total", F.col("at").alias("at")))).over(block.orderBy("key").rangeBetween(0, turns - 1))
    cut = F.min(F.when(F.col("phase"), F.col("at"))).over(block.orderBy("at").rangeBetween(1, Window.unboundedFollowing))
    placed = shown.withColumn("ahead", ahead).withColumn("cut", cut).filter("starts and here")
    placed = placed.groupBy("conv_id", "at").agg(*(F.first(c).alias(c) for c in ("key", "base", "ahead", "cut"))).join(ends, "conv_id")
    turns_ahead = F.array_sort("ahead", lambda a, b: (a["key"] - b["key"]).cast("int"))
    placed = placed.withColumn("ahead", turns_ahead)
    limit = F.col("base") + chars
    full = F.filter("ahead", lambda x: x["total"] >= limit)
    hit = F.get(full, F.lit(0))
    before_hit = F.get("ahead", F.size("ahead") - F.size(full) - 1)["at"]
    by_limit = F.when((F.size("ahead") == F.size(full)) | (hit["total"] == limit), hit["at"]).otherwise(before_hit)
    last = F.get("ahead", F.size("ahead") - 1)["at"]
    tail = F.when(F.col("whole") - F.col("base") > chars, F.coalesce(last, F.col("last_id"))).otherwise(F.col("last_id"))
    planned = F.when(F.size(full) > 0, by_limit).when(F.size("ahead") == turns, last).otherwise(tail)
    out = placed.withColumn("planned_end", planned).withColumn("end_id", F.when(F.col("cut") <= F.col("planned_end"), F.col("cut") - 1).otherwise(F.col("planned_end")))
    return out.select("conv_id", F.col("at").alias("start_id"), "end_id", "planned_end", F.when(F.col("end_id") < F.col("last_id"), F.col("end_id") + 1).alias("next_id"), (F.col("at") == F.col("first_id")).alias("first"))


def followed(pointers: DataFrame) -> DataFrame:
    """conv_id, chunk, start_id: the rows reached from each log's first by its pointers (conv_id, start_id, next_id, first),
    in turn. Jumps are doubled, so the longest log takes as many rounds as its number of chunks has bits; each round is two
    joins by equal keys and a stored table."""
    reached = pointers.filter("first").select("conv_id", F.lit(0).cast("long").alias("chunk"), "start_id")
    jumps, step = stored(pointers.filter("next_id is not null").select("conv_id", "start_id", "next_id")), 1
    while True:
        further = reached.join(jumps, ["conv_id", "start_id"]).select("conv_id", (F.col("chunk") + step).alias("chunk"), F.col("next_id").alias("start_id"))
        more = stored(further)
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        twice = jumps.select("conv_id", F.col("start_id").alias("next_id"), F.col("next_id").alias("then")).join(jumps, ["conv_id", "next_id"])
        doubled = stored(twice.select("conv_id", "start_id", F.col("then").alias("next_id")))
        dropped(jumps)
        jumps, step = doubled, 2 * step


def plan_chunks(messages: DataFrame, turns: int, chars: int, boundary: Column | None = None) -> DataFrame:
    """conv_id, chunk, start_id, end_id, planned_end: a chunk closes at so many completed turns or at a completion with so many
    characters; a turn that would pass the limit starts a new chunk, but the first turn is never split; a boundary row
    starts a new one, and planned_end is where the chunk would have ended without it.

    Where a chunk that starts at some row ends is found for all such rows at once; the chunks are those reached from a
    log's first row. No row and no task holds a whole log.
    """
    pointers = stored(chunk_pointers(messages, max(1, turns), chars, boundary))
    return followed(pointers).join(pointers, ["conv_id", "start_id"]).select("conv_id", "chunk", "start_id", "end_id", "planned_end")


def chunk_sizes(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, messages, chars: system rows included, characters as UTF-16 code units."""
    placed = chunk_rows(messages, chunks).withColumn("size", utf16_length(F.coalesce("text", F.lit(""))))
    return placed.groupBy("conv_id", "chunk").agg(F.count("*").alias("messages"), F.sum("size").alias("chars"))


def chunk_rows(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the range they are in: each range is spread over its ids, so the join has plain equal keys."""
    ids = ranges.withColumn("message_id", F.explode(F.sequence("start_id", "end_id")))
    return messages.join(ids, ["conv_id", "message_id"])


def ready_chunks(messages: DataFrame, chunks: DataFrame, turns: int, chars: int, visible: Column) -> DataFrame:
    """The chunks of each conversation before its first one that isn't ready. Ready: all turns there; or the plan ended
    before the log did; or a phase cut it, and it has visible non-system text; or complete turns over the limit.

    chunks may have planned_end, where a chunk would have ended without the phase that cut it; else none is taken as cut.
    """
    planned = F.col("planned_end") if "planned_end" in chunks.columns else F.col("end_id")
    ranges = chunks.select("conv_id", "chunk", "start_id", "end_id", planned.alias("planned"))
    marked = chunk_rows(turn_flags(messages).withColumn("size", utf16_length(F.coalesce("text", F.lit("")))).withColumn("seen", visible & ~F.col("is_system")), ranges)
    facts = marked.groupBy("conv_id", "chunk", "start_id", "end_id", "planned").agg(F.count_if("completes").alias("t"), F.sum("size").alias("chars"), F.bool_or("seen").alias("seen"))
    last = facts.withColumn("last", F.max("end_id").over(by()))
    cut = (F.col("end_id") < F.col("planned")) & F.col("seen")
    ready = (F.col("t") >= turns) | (F.col("planned") < F.col("last")) | cut | ((F.col("t") > 0) & (F.col("chars") > chars))
    first_open = F.min(F.when(~ready, F.col("chunk"))).over(by())
    return last.withColumn("stop", first_open).filter(F.col("stop").isNull() | (F.col("chunk") < F.col("stop"))).select("conv_id", "chunk", "start_id", "end_id")
