"""The live entries as a table: edits, deletions, branches, joins by age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCK = ["conv_id", "level", "start_id", "end_id", "updated_at"]


def apply_edits(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the new texts of edits (LOCK, new_text) that meet exactly one live, undeleted entry; and the edits that
    meet none."""
    live = entries.filter(~F.col("deleted"))
    hit = edits.join(live.select(*LOCK), LOCK, "left_semi")
    out = entries.join(hit.select(*LOCK, "new_text"), LOCK, "left")
    changed = F.col("new_text").isNotNull()
    out = out.withColumn("text", F.coalesce("new_text", "text")).withColumn("manually_edited", changed | F.col("manually_edited")).select(*entries.columns)
    return out, edits.join(hit.select(*LOCK), LOCK, "left_anti")


def apply_deletes(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    """The last entry of a log goes, so its rows are raw again; any other stays as a tombstone that still covers its rows."""
    last = F.max("start_id").over(Window.partitionBy("conv_id"))
    marked = entries.withColumn("last", last).join(deletes.select(*LOCK, F.lit(True).alias("gone")), LOCK, "left")
    gone = F.coalesce("gone", F.lit(False)) & ~F.col("deleted")
    kept = marked.filter(~(gone & (F.col("start_id") == F.col("last"))))
    return kept.withColumn("text", F.when(gone, F.lit("")).otherwise(F.col("text"))).withColumn("deleted", F.col("deleted") | gone).select(*entries.columns)


def latest_record(records: DataFrame, logs: DataFrame) -> DataFrame:
    """As-of: for each log (conv_id, last_id) the record (conv_id, mes_id, pos, ...) appended last with mes_id <= last_id."""
    valid = records.join(logs, "conv_id").filter("mes_id is not null and mes_id >= 0 and mes_id <= last_id")
    return valid.groupBy("conv_id").agg(F.max_by("mes_id", "pos").alias("mes_id"), F.max("pos").alias("pos"))


def latest_within(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each left row (key, id, at) with the latest right row (key, other, captured) of the same key that is at most so many
    seconds older, in whole seconds; no row where there is none. An as-of join: one sorted pass over a key's rows."""
    one = left.select(*left.columns, F.unix_timestamp("at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["captured"].dataType).alias("captured"), F.lit(None).cast(right.schema["other"].dataType).alias("other"))
    two = right.select(key, "other", "captured", F.unix_timestamp("captured").alias("_t"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "captured", "other").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("captured", "other", "_t")), ignorenulls=True).over(w)
    met = one.unionByName(two, allowMissingColumns=True).withColumn("_seen", seen).filter((F.col("_side") == 1) & (F.col("_t") - F.col("_seen._t") <= seconds))
    return met.select(*left.columns, F.col("_seen.other").alias("other"), F.col("_seen.captured").alias("captured"))


def matched_once(left: DataFrame, right: DataFrame, key: str, seconds: int, prepared: DataFrame | None = None) -> DataFrame:
    """Each left row (key, id, at) with the latest right row (key, other, captured) since the left row before it of the same
    key, if that is at most so many seconds older: a left row uses up all that was captured before it, matched or not, so a
    right row is used once. With prepared (key, at) there must be such a row, too, since the left row before. Left rows
    without a match have no row; of left rows at one time that of smaller id comes first. One sorted pass over a key's rows.
    """
    fields = [c for c in left.columns if c != key]
    none = F.lit(None)
    taken, held = left.select(F.struct(*fields)).schema[0].dataType, right.select(F.struct("captured", "other")).schema[0].dataType
    rows = left.select(key, F.unix_micros("at").alias("_t"), F.lit(2).alias("_side"), F.struct(*fields).alias("_left"), none.cast(held).alias("_right"), F.col("id").alias("_o"))
    rows = rows.unionByName(right.select(key, F.unix_micros("captured").alias("_t"), F.lit(1).alias("_side"), none.cast(taken).alias("_left"), F.struct("captured", "other").alias("_right"), none.cast(left.schema["id"].dataType).alias("_o")))
    if prepared is not None:
        rows = rows.unionByName(prepared.select(key, F.unix_micros("at").alias("_t"), F.lit(0).alias("_side"), none.cast(taken).alias("_left"), none.cast(held).alias("_right"), none.cast(left.schema["id"].dataType).alias("_o")))
    before = Window.partitionBy(key).orderBy("_t", "_side", "_o", "_right").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_turn", F.coalesce(F.count_if(F.col("_side") == 2).over(before), F.lit(0)))
    last = F.last(F.when(F.col("_side") == 1, F.struct("_turn", "_t", "_right")), ignorenulls=True).over(before)
    ready = F.last(F.when(F.col("_side") == 0, F.col("_turn")), ignorenulls=True).over(before)
    met = rows.withColumn("_last", last).withColumn("_ready", ready).filter("_side = 2 and _last._turn = _turn").filter(F.col("_t") - F.col("_last._t") <= seconds * 1_000_000)
    if prepared is not None:
        met = met.filter("_ready = _turn")
    return met.select(key, *(F.col(f"_left.{c}").alias(c) for c in fields), F.col("_last._right.other").alias("other"), F.col("_last._right.captured").alias("captured"))


def branch(entries: DataFrame, branches: DataFrame) -> DataFrame:
    """entries and copies of those of each branch's source (conv_id, new_id) up to the row at which it leaves (upto)."""
    copies = entries.join(branches, "conv_id").filter("end_id <= upto").withColumn("conv_id", F.col("new_id"))
    return entries.unionByName(copies.select(*entries.columns))


def renamed(entries: DataFrame, names: DataFrame) -> DataFrame:
    """entries under the new ids of names (conv_id, owner, new_id) where the stored owner is the one that renames."""
    joined = entries.join(names.select("conv_id", "owner", "new_id"), ["conv_id", "owner"], "left")
    return joined.withColumn("conv_id", F.coalesce("new_id", "conv_id")).select(*entries.columns)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Newest first, page clamped to those there are, of each log."""
    size = max(1, size)
    w = Window.partitionBy("conv_id")
    placed = rows.withColumn("rn", F.row_number().over(w.orderBy(F.col("start_id").desc())) - 1).withColumn("pages", F.ceil(F.count("*").over(w) / size))
    wanted = F.least(F.greatest(F.lit(number), F.lit(1)), "pages") - 1
    return placed.filter(F.floor(F.col("rn") / size) == wanted).drop("rn", "pages")


def normalised(states: DataFrame) -> DataFrame:
    """Entries from untrusted JSON (conv_id, state): numbers floored, levels 1 to 32, texts trimmed, deleted ones empty; the
    entries before the first invalid or non-contiguous one."""
    from convlog.functions.text import trim
    from convlog.operators.lineage import contiguous_prefix

    parsed = F.from_json("state", "entries array<struct<level:double,start:double,end:double,text:string,deleted:boolean>>")
    rows = states.select("conv_id", F.posexplode(parsed["entries"]).alias("seq", "e"))
    deleted = F.coalesce("e.deleted", F.lit(False))
    out = rows.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), F.least(F.greatest(F.floor(F.coalesce("e.level", F.lit(1.0))), F.lit(1)), F.lit(32)).alias("level"),
        F.floor("e.start").alias("start_id"), F.floor("e.end").alias("end_id"), F.when(deleted, F.lit("")).otherwise(trim(F.coalesce("e.text", F.lit("")))).alias("text"), deleted.alias("deleted"),
    )
    bad = F.col("start_id").isNull() | F.col("end_id").isNull() | (F.col("end_id") < F.col("start_id")) | (~F.col("deleted") & (F.col("text") == ""))
    first_bad = F.min(F.when(bad, F.col("seq"))).over(Window.partitionBy("conv_id"))
    good = out.withColumn("first_bad", first_bad).filter(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")
    return contiguous_prefix(good)
