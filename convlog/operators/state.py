"""What a store of logs takes in: prompts made plain, placeholders filled in, reports made regular, writes guarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["summary", "interceptor", "error"]  # fixed values: of a trace


def prompt_text(payload: Column, depth: int = 3) -> Column:
    """The text of a JSON prompt: a text as it is; of a list its parts that have any, a line each; of an object its content,
    else its text. Nesting beyond the depth has no text; what isn't JSON has none either."""
    return text_of(F.try_parse_json(payload), depth)


def text_of(v: Column, depth: int) -> Column:
    """prompt_text of a parsed value."""
    kind = F.schema_of_variant(v)
    own = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    text = F.try_variant_get(v, "$.text", "variant")
    of_text = F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get(text, "$", "string"))
    if depth == 0:
        return F.coalesce(own, of_text, F.lit(""))
    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: text_of(x, depth - 1)), lambda t: t != "")
    content = F.try_variant_get(v, "$.content", "variant")
    return F.coalesce(own, F.when(kind.startswith("ARRAY"), F.array_join(parts, "\n")), F.when(content.isNotNull(), text_of(content, depth - 1)), of_text, F.lit(""))


def substituted(text: Column, values: dict[str, str]) -> Column:
    """The text with each {{name}} that has a value replaced by it; others stay as they are."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return text


def guarded(updates: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) of updates (conv_id, owner, ...): kept are those whose owner is the one that the store (conv_id, owner)
    has for the log just now, so that a job that lost its log to another writes nothing."""
    same = owners.select("conv_id", "owner")
    return updates.join(same, ["conv_id", "owner"], "left_semi"), updates.join(same, ["conv_id", "owner"], "left_anti")


def regular_reports(reports: DataFrame, most_warnings: int = 100) -> DataFrame:
    """Reports (conv_id, created_at, kind, retained_start, retained_end, removed, tokens_removed, tokens_injected, tokens_saved,
    covered, duration_ms, warnings) without those of no time; a missing kind is normal, counts are 0 at least, missing ends
    -1, warnings at most so many."""
    count = lambda c: F.greatest(F.coalesce(F.floor(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
    end = lambda c: F.coalesce(F.floor(c), F.lit(-1)).cast("long").alias(c)
    warnings = F.slice(F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.isNotNull()), 1, most_warnings)
    return reports.filter("created_at is not null").select(
        "conv_id", "created_at", F.coalesce("kind", F.lit("normal")).alias("kind"), F.coalesce(F.floor("retained_start"), F.lit(0)).cast("long").alias("retained_start"), end("retained_end"),
        *map(count, ("removed", "tokens_removed", "tokens_injected", "tokens_saved")), end("covered"), count("duration_ms"), warnings.alias("warnings"),
    )


def regular_traces(traces: DataFrame, most: int = 50) -> DataFrame:
    """The last traces (conv_id, pos, id, created_at, stage, message) of each log that are whole and of a known stage."""
    whole = traces.filter("id is not null and created_at is not null and message is not null").filter(F.col("stage").isin(STAGES))
    return whole.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("pos").desc()))).filter(F.col("k") <= most).drop("k")
