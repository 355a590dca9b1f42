"""Tiered roll-up: runs of summaries of one level become one of the next, so live entries grow with the logarithm of the log."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.operators.lineage import RECORD, ordered_text, payload
from convlog.store import stored

LEVELS = 32


def _capacity(level: int, group_1: int, group_n: int) -> int:
    return group_1 if level == 1 else group_n


def level_counts(entries: DataFrame) -> DataFrame:
    """Entries of each level, deleted ones included."""
    return entries.groupBy("conv_id", "level").agg(F.count("*").alias("n"))


def rollup_due(entries: DataFrame, group_1: int, group_n: int) -> DataFrame:
    """conv_id, level of the lowest level with more entries than it may hold."""
    full = level_counts(entries).filter(F.col("n") > F.when(F.col("level") == 1, group_1).otherwise(group_n))
    return full.groupBy("conv_id").agg(F.min("level").alias("level"))


def joined_texts(texts: Column) -> Column:
    """The default summariser of roll-ups: the children's texts, a line each."""
    return F.array_join(texts, "\n")


def _parents(children: DataFrame, keys: list[str], level: Column, summariser: Callable[[Column], Column] | None) -> DataFrame:
    """A parent of each group of children: their range, a digest of them, and a text by the summariser, which gets the
    children's texts in order, those of deleted ones empty; where all are deleted it isn't asked, and the parent is."""
    child = payload(F.col("level"), F.col("start_id"), F.col("end_id"), F.col("source_hash"), F.col("text"), F.col("deleted"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("start_id", F.when(~F.col("deleted"), F.col("text")).otherwise("").alias("t")))), lambda x: x["t"])
    made = children.groupBy(*keys).agg(
        F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"), F.every("deleted").alias("deleted"), texts.alias("texts"), F.sha2(ordered_text(child, F.col("start_id"), RECORD), 256).alias("source_hash")
    )
    text = F.when(F.col("deleted"), F.lit("")).otherwise((summariser or joined_texts)(F.col("texts")))
    return made.select("conv_id", (level + 1).cast("int").alias("level"), "start_id", "end_id", "deleted", text.alias("text"), "source_hash")


def _levels(entries: DataFrame, least_group: int) -> int:
    """Up to which level entries can come, from one count of them."""
    r = entries.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("level").alias("top")).agg(F.max("n"), F.max("top")).first()
    return min(LEVELS, r[1] + int(math.log(r[0], least_group)) + 1) if r[0] else 1


def roll_up(entries: DataFrame, group_1: int, group_n: int, levels: int | None = None, summariser: Callable[[Column], Column] | None = None) -> DataFrame:
    """entries (conv_id, level, start_id, end_id, deleted, text, source_hash) with every due run replaced by its parent, one
    ascending pass a level, up to `levels` or until none is due. A parent covers its children's range, carries a digest of
    them, has a text by the summariser, and is deleted if all of them are. Runs must be neighbours; check with run_errors()."""
    live = stored(entries.select("conv_id", "level", "start_id", "end_id", "deleted", "text", "source_hash"))
    out, parents = None, None
    for level in range(1, levels or _levels(live, min(group_1, group_n))):
        cap = _capacity(level, group_1, group_n)
        here = live.filter(F.col("level") == level)
        here = here if parents is None else here.unionByName(parents)
        w = Window.partitionBy("conv_id").orderBy("start_id")
        n = F.count("*").over(Window.partitionBy("conv_id"))
        placed = here.withColumn("rn", F.row_number().over(w) - 1).withColumn("runs", F.floor((n - 1) / cap)).withColumn("run", F.floor(F.col("rn") / cap))
        placed = stored(placed)  # a level is worked out once, and its sorts end before the next begins
        parents = stored(_parents(placed.filter("run < runs"), ["conv_id", "run"], F.lit(level), summariser))
        left = placed.filter("run >= runs").select(*live.columns)
        out = left if out is None else out.unionByName(left)
    if out is None:
        return live
    above = live.filter(~F.col("level").between(1, level)).unionByName(parents)
    return out.unionByName(above)


def roll_up_once(entries: DataFrame, group_1: int, group_n: int, summariser: Callable[[Column], Column] | None = None) -> DataFrame:
    """entries after one roll-up of each log where one is due: of its lowest level that holds too many, the oldest run. A run
    whose entries aren't neighbours stays as it is."""
    live = entries.select("conv_id", "level", "start_id", "end_id", "deleted", "text", "source_hash")
    cap = F.when(F.col("level") == 1, group_1).otherwise(group_n)
    w = Window.partitionBy("conv_id", "level").orderBy("start_id")
    due = live.join(rollup_due(live, group_1, group_n), ["conv_id", "level"]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap)
    gap = F.col("start_id") != F.lag("end_id").over(w) + 1
    broken = F.max(F.coalesce(gap, F.lit(False))).over(Window.partitionBy("conv_id"))
    due = due.withColumn("gap", gap).withColumn("broken", broken).filter("not broken")
    parents = _parents(due, ["conv_id", "level"], F.col("level"), summariser)
    return live.join(due.select("conv_id", "level", "start_id"), ["conv_id", "level", "start_id"], "left_anti").unionByName(parents)


def run_errors(entries: DataFrame) -> DataFrame:
    """Entries that don't follow on the one before: conv_id, start_id, expected."""
    expected = F.coalesce(F.lag("end_id").over(Window.partitionBy("conv_id").orderBy("start_id")) + 1, F.lit(0))
    return entries.withColumn("expected", expected).filter("start_id <> expected").select("conv_id", "start_id", "expected")


def closed_frontier(counts: DataFrame, group_1: int, group_n: int, levels: int | None = None) -> DataFrame:
    """conv_id, level, first, last (ordinals of level-1 entries): what roll-ups leave of n (conv_id, n) entries that came one
    by one, up to `levels`, the last of which keeps all its nodes, or until none is due. Integer arithmetic: a level has
    (n - before) div width nodes; width is the entries that one of them covers, before the widths of the levels below it."""
    most = 2**63 - 1 if group_n > 1 else counts.agg(F.max("n")).first()[0] or 0  # groups of one: as many levels as entries
    steps, width, before = [], 1, 0
    while not steps or (before + width <= most and len(steps) != levels):
        steps.append({"level": len(steps) + 1, "cap": _capacity(len(steps) + 1, group_1, group_n), "width": width, "before": before, "least": before + width})
        before, width = before + width, width * steps[-1]["cap"]
    known = F.array(*(F.struct(*(F.lit(v).cast("int" if k == "level" else "long").alias(k) for k, v in s.items())) for s in steps))
    whole = counts.select("conv_id", F.col("n").cast("long").alias("n"))
    held = whole.select("conv_id", "n", F.explode(F.filter(known, lambda s: s["least"] <= F.col("n"))).alias("s")).select("conv_id", "n", "s.*")
    last = held.withColumn("c", F.expr("(n - before) div width - 1"))
    oldest = F.when(F.col("level") == F.lit(levels), F.lit(0).cast("long")).otherwise(F.col("c") - F.col("c") % F.col("cap"))
    nodes = last.select("conv_id", "level", "width", F.explode(F.sequence(oldest, F.col("c"))).alias("j"))
    return nodes.select("conv_id", "level", (F.col("j") * F.col("width")).alias("first"), ((F.col("j") + 1) * F.col("width") - 1).alias("last"))
