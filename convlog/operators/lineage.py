"""Content hashes of ranges of a log, and what an edit invalidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.operators.chunks import chunk_rows
from convlog.operators.turns import by

UNIT, RECORD = "\x1f", "\x1e"
def payload(*cols: Column) -> Column:
    """A row's fields in one string, null and empty told apart."""
    return F.concat_ws(UNIT, *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols))


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """Strings of a group joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), value.alias("v")))), lambda x: x["v"]), separator)


def range_hashes(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (conv_id, start_id, end_id) with source_hash: SHA-256 of the ordered rows' id, flags, name and text."""
    rows = chunk_rows(messages, ranges.select("conv_id", "start_id", "end_id").distinct())
    one = payload(F.col("message_id"), F.col("is_user"), F.col("is_system"), F.col("name"), F.col("text"))
    hashed = rows.groupBy("conv_id", "start_id", "end_id").agg(F.sha2(ordered_text(one, F.col("message_id"), RECORD), 256).alias("source_hash"))
    return ranges.join(hashed, ["conv_id", "start_id", "end_id"])


def frontier_signature(entries: DataFrame) -> DataFrame:
    """conv_id, signature: the entries' level:start:end:hash in order of their ranges."""
    one = F.concat_ws(":", F.col("level").cast("string"), F.col("start_id").cast("string"), F.col("end_id").cast("string"), F.col("source_hash"))
    return entries.groupBy("conv_id").agg(ordered_text(one, F.col("start_id"), "|").alias("signature"))


def valid_prefix(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """The entries (conv_id, seq, start_id, end_id, source_hash) before the first whose rows changed or are gone. An empty
    stored hash is filled in and counts as right. All hashes are computed at once; a window finds the first bad one."""
    now = range_hashes(messages, entries.select("conv_id", "start_id", "end_id")).withColumnRenamed("source_hash", "now")
    size = messages.groupBy("conv_id").agg(F.max("message_id").alias("last"))
    joined = entries.join(now.distinct(), ["conv_id", "start_id", "end_id"], "left").join(size, "conv_id", "left")
    stored = F.nullif("source_hash", F.lit(""))
    bad = F.col("now").isNull() | F.col("last").isNull() | (F.col("end_id") > F.col("last")) | F.coalesce(stored != F.col("now"), F.lit(False))
    first_bad = F.min(F.when(bad, F.col("seq"))).over(by())
    kept = joined.withColumn("first_bad", first_bad).filter(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad")))
    return kept.withColumn("source_hash", F.coalesce(stored, "now")).select(*entries.columns)


def contiguous_prefix(entries: DataFrame) -> DataFrame:
    """The entries (conv_id, seq, start_id, end_id) before the first gap; the first starts at 0."""
    gap = F.col("start_id") != F.coalesce(F.lag("end_id").over(by().orderBy("seq")) + 1, F.lit(0))
    first = F.min(F.when(gap, F.col("seq"))).over(by())
    return entries.withColumn("gap", gap).withColumn("first", first).filter(F.col("first").isNull() | (F.col("seq") < F.col("first"))).drop("gap", "first")


def changed_from(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """conv_id, changed_from: the first row that differs between two states of a log, missing rows included."""
    cols = ["is_user", "is_system", "name", "text"]
    a = snapshot.select("conv_id", "message_id", F.lit(True).alias("here"), *cols)
    b = live.select("conv_id", "message_id", F.lit(True).alias("there"), *(F.col(c).alias(f"{c}_now") for c in cols))
    same = F.col("here") & F.col("there")
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_now"))
    return a.join(b, ["conv_id", "message_id"], "full").filter(~F.coalesce(same, F.lit(False))).groupBy("conv_id").agg(F.min("message_id").alias("changed_from"))


def carried_text(entries: DataFrame, most: int, notice: str = "") -> DataFrame:
    """entries with carried: the text of the last entry before that isn't deleted, its last characters, the notice ahead
    where it is cut counting too."""
    before = F.last(F.when(~F.col("deleted"), F.col("text")), ignorenulls=True).over(by().orderBy("start_id").rowsBetween(Window.unboundedPreceding, -1))
    text = F.coalesce(before, F.lit(""))
    cut = F.concat(F.lit(notice), F.substring(text, -(most - len(notice)), most - len(notice)))
    return entries.withColumn("carried", F.when(F.length(text) <= most, text).otherwise(cut))
