"""Stored states of any version as entries: every field is read as it may be, whatever it should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions.text import trim
from convlog.operators.usage import NUMERIC

# fixed values: versions that can be read, names of fields, and the time of entries that have none
VERSIONS = [1, 2, 3]
FIELDS = {"text": "text", "level": "level", "start": "sourceStartMessageId", "end": "sourceEndMessageId", "hash": "sourceHash", "updated": "updatedAt", "edited": "manuallyEdited", "deleted": "deleted"}
COVERED_END, COVERED_HASH = "coveredThroughMessageId", "coveredThroughHash"
NO_TIME = "1970-01-01T00:00:00.000Z"
LEVELS = 32


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_field(v: Column, name: str) -> Column:
    """A string; null for anything else."""
    x = _at(v, name)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def flag_field(v: Column, name: str) -> Column:
    """Whether a field is just true."""
    x = _at(v, name)
    return F.coalesce((F.schema_of_variant(x) == "BOOLEAN") & F.try_variant_get(x, "$", "boolean"), F.lit(False))


def whole_field(v: Column, name: str, other: int) -> Column:
    """A number rounded down: a number or a text that is one, 0 for null and blank, 1 or 0 for a truth value; else `other`."""
    x = _at(v, name)
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    of_text = F.when(trim(text) == "", F.lit(0.0)).when(text.rlike(NUMERIC), text.try_cast("double"))
    plain = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    n = F.when(kind == "VOID", F.lit(0.0)).when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).when(kind == "STRING", of_text).when(plain, F.try_variant_get(x, "$", "double"))
    return F.coalesce(F.when(F.abs(n) < float("inf"), F.floor(n).cast("long")), F.lit(other).cast("long"))


def normalised_entry(v: Column) -> Column:
    """A stored entry as a struct (level, start_id, end_id, text, char_count, source_hash, updated_at, manually_edited,
    deleted); null if it has no text and isn't deleted, or no range. Levels are 1 to 32, deleted ones have no text."""
    f = FIELDS
    deleted, text = flag_field(v, f["deleted"]), trim(F.coalesce(text_field(v, f["text"]), F.lit("")))
    start, end = whole_field(v, f["start"], -1), whole_field(v, f["end"], -1)
    kept = F.when(deleted, F.lit("")).otherwise(text)
    entry = F.struct(
        F.least(F.greatest(whole_field(v, f["level"], 1), F.lit(1)), F.lit(LEVELS)).cast("int").alias("level"), start.alias("start_id"), end.alias("end_id"), kept.alias("text"), F.length(kept).cast("long").alias("char_count"),
        F.coalesce(text_field(v, f["hash"]), F.lit("")).alias("source_hash"), F.coalesce(text_field(v, f["updated"]), F.lit(NO_TIME)).alias("updated_at"), flag_field(v, f["edited"]).alias("manually_edited"), deleted.alias("deleted"),
    )
    record = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(record & ((text != "") | deleted) & (start >= 0) & (end >= start), entry)


def migrated(states: DataFrame) -> DataFrame:
    """conv_id, owner, seq and the fields of normalised_entry: the live entries of stored states (conv_id, state: JSON).

    A state counts if it has a known version, an id and an owner. Of its entries those before the first that is invalid or
    doesn't follow on the one before; if there is none, a text from before there were entries becomes one of level 1. One
    row of a window a log; a state's own list is spread over rows.
    """
    v = F.col("v")
    known = states.select("conv_id", F.try_parse_json("state").alias("v")).filter(whole_field(v, "schemaVersion", 0).isin(VERSIONS) & text_field(v, "chatUuid").isNotNull() & text_field(v, "ownerChatId").isNotNull())
    summary = known.select("conv_id", text_field(v, "ownerChatId").alias("owner"), _at(v, "stageSummary").alias("s"))
    listed = summary.select("conv_id", "owner", F.posexplode(F.try_variant_get(_at(F.col("s"), "entries"), "$", "array<variant>")).alias("seq", "e")).select("conv_id", "owner", "seq", normalised_entry(F.col("e")).alias("e"))
    by = Window.partitionBy("conv_id").orderBy("seq")
    follows = F.col("e.start_id") == F.coalesce(F.lag("e.end_id").over(by) + 1, F.lit(0))
    bad = F.coalesce(~follows, F.lit(True))
    first_bad = F.min(F.when(F.col("bad"), F.col("seq"))).over(Window.partitionBy("conv_id"))
    kept = listed.withColumn("bad", bad).withColumn("first_bad", first_bad).filter("first_bad is null or seq < first_bad").select("conv_id", "owner", F.col("seq").cast("long").alias("seq"), "e.*")
    s = F.col("s")
    text, end = trim(F.coalesce(text_field(s, "text"), F.lit(""))), whole_field(s, COVERED_END, -1)
    old = summary.filter((text != "") & (end >= 0)).join(kept.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", "owner", F.lit(0).cast("long").alias("seq"), F.lit(1).alias("level"), F.lit(0).cast("long").alias("start_id"), end.alias("end_id"), text.alias("text"), F.length(text).cast("long").alias("char_count"),
        F.coalesce(text_field(s, COVERED_HASH), F.lit("")).alias("source_hash"), F.coalesce(text_field(s, FIELDS["updated"]), F.lit(NO_TIME)).alias("updated_at"), F.lit(False).alias("manually_edited"), F.lit(False).alias("deleted"),
    )
    return kept.unionByName(old)
