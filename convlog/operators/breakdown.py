"""Where the tokens of a prompt went: shares of a record's counted parts, by the form of the record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlog.functions.text import trim
from convlog.operators.state import text_of
from convlog.operators.tokens import counted_tokens

CATEGORIES = ["system", "character", "world_info", "examples", "recent_context", "summary", "other", "unclassified"]
COUNTED = ["raw", "summary", "character", "world_info", "examples", "anchors", "instruction", "story", "chat"]


def with_shares(rows: DataFrame, name: str, tokens: list[Column], budget: Column) -> DataFrame:
    """rows with an array of shares of the budget: the tokens if they fit it, else shares in proportion, rounded down, and
    what is left to the largest remainders, first ones first. A row's parts are a handful, so no row leaves its place."""
    t, b, n = f"_{name}_t", f"_{name}_b", len(tokens)
    out = rows.withColumn(t, F.array(*(F.greatest(F.lit(0), F.floor(x + 0.5)) for x in tokens))).withColumn(b, F.greatest(F.lit(0), F.floor(budget + 0.5)))
    total = F.aggregate(t, F.lit(0).cast("long"), lambda x, y: x + y)
    out = out.withColumn("_total", total).withColumn("_exact", F.transform(t, lambda x: F.when(F.col("_total") > 0, x * F.col(b) / F.col("_total")).otherwise(0.0)))
    out = out.withColumn("_low", F.transform("_exact", lambda x: F.floor(x))).withColumn("_rest", F.zip_with("_exact", "_low", lambda x, y: x - y))
    left = F.col(b) - F.aggregate("_low", F.lit(0).cast("long"), lambda x, y: x + y)
    place = [sum((F.when((F.col("_rest")[j] > F.col("_rest")[i]) | ((F.col("_rest")[j] == F.col("_rest")[i]) & F.lit(j < i)), 1).otherwise(0) for j in range(n) if j != i), F.lit(1)) for i in range(n)]
    share = [F.when((F.col("_total") == 0) | (F.col(b) == 0), F.lit(0)).when(F.col("_total") <= F.col(b), F.col(t)[i]).otherwise(F.col("_low")[i] + F.when(place[i] <= left, 1).otherwise(0)).cast("long") for i in range(n)]
    return out.withColumn(name, F.array(*share)).drop(t, b, "_total", "_exact", "_low", "_rest")


def _sum(shares: str) -> Column:
    return F.aggregate(shares, F.lit(0).cast("long"), lambda x, y: x + y)


def token_breakdown(records: DataFrame) -> DataFrame:
    """record_id, total, the tokens of CATEGORIES, context_tokens, detailed, measured: one row per record with any tokens.

    records: record_id, main_api, the counted tokens of the parts in COUNTED, and of chat completions stored_total and
    system, examples and conversation counters (oai_system, oai_examples, oai_conversation). Chat completions with a stored
    total are split by their counters; text prompts by story, examples and chat; all others by their parts alone, and
    what these don't explain is unclassified. Missing or negative counts are 0.
    """
    c = F.col
    counts = {x: F.greatest(F.coalesce(c(x), F.lit(0)), F.lit(0)) for x in (*COUNTED, "stored_total", "oai_system", "oai_examples", "oai_conversation")}
    rows = records.select("record_id", "main_api", *(v.alias(k) for k, v in counts.items()))
    chat = F.coalesce(c("main_api") == "openai", F.lit(False))
    form = F.when(chat & (c("stored_total") > 0), "chat").when(~chat & ((c("story") > 0) | (c("chat") > 0)), "text").otherwise("parts")
    rows = rows.withColumn("form", form).withColumn("total", F.when(c("form") == "chat", c("stored_total")).otherwise(c("raw")).cast("long")).filter("total > 0")

    def by_form(chat: Column | None, text: Column | None, parts: Column | None) -> Column:
        return F.coalesce(F.when(c("form") == "chat", chat if chat is not None else F.lit(0)).when(c("form") == "text", text if text is not None else F.lit(0)).otherwise(parts if parts is not None else F.lit(0)), F.lit(0))

    outer = [by_form(c("oai_system"), c("story"), c("instruction")), by_form(c("oai_examples"), c("examples"), c("character")), by_form(c("oai_conversation"), c("chat"), c("world_info"))]
    outer += [by_form(None, None, c(x)) for x in ("examples", "summary", "anchors")]
    rows = with_shares(rows, "outer", outer, c("total"))
    rows = rows.withColumn("spare", F.greatest(c("total") - _sum("outer"), F.lit(0)))
    rows = with_shares(rows, "inner", [by_form(None, c("instruction"), None), by_form(c("character"), c("character"), None), by_form(c("world_info"), c("world_info"), None)], by_form(c("spare"), c("outer")[0], None))
    rows = with_shares(rows, "talk", [by_form(c("summary"), c("summary"), None), by_form(c("anchors"), c("anchors"), None)], by_form(c("outer")[2], c("outer")[2], None))
    context = F.greatest(c("outer")[2] - _sum("talk"), F.lit(0))
    o, i, t = (c(x) for x in ("outer", "inner", "talk"))
    shares = {
        "system": by_form(o[0], i[0], o[0]),
        "character": by_form(i[1], i[1], o[1]),
        "world_info": by_form(i[2], i[2], o[2]),
        "examples": by_form(o[1], o[1], o[3]),
        "recent_context": by_form(context, context, None),
        "summary": by_form(t[0], t[0], o[4]),
        "other": by_form(F.greatest(c("spare") - _sum("inner"), F.lit(0)) + t[1], t[1], o[5]),
        "unclassified": by_form(None, c("spare") + o[0] - _sum("inner"), c("spare")),
    }
    return rows.select(
        "record_id", "total", *(v.cast("long").alias(k) for k, v in shares.items()),
        F.when(c("form") != "parts", context).cast("long").alias("context_tokens"), (c("form") != "parts").alias("detailed"), (c("form") == "chat").alias("measured"),
    )


BUCKETS = ["system", "recent_context", "summary", "other"]


def message_buckets(snapshots: DataFrame, tag: str = "log_summary") -> DataFrame:
    """record_id, bucket, text: the texts of a list of messages by what they are for.

    snapshots: record_id, messages (a JSON array of objects with role and content, nested as prompts are), tools (a JSON
    array). Blocks in the tag are split off first, as `summary`; what is left of a message goes by its role: system and
    developer to system, user and assistant to recent_context, any other to other, and so do the tools.
    """
    messages = snapshots.select("record_id", F.posexplode(F.try_variant_get(F.try_parse_json("messages"), "$", "array<variant>")).alias("at", "m"))
    plain = F.lower(F.when(F.schema_of_variant(F.try_variant_get("m", "$.role", "variant")) == "STRING", F.try_variant_get("m", "$.role", "string")))
    rows = messages.select("record_id", "at", text_of(F.col("m"), 3).alias("text"), F.coalesce(plain, F.lit("")).alias("role")).filter(trim(F.col("text")) != "")
    rows = rows.withColumn("blocks", F.array_join(F.regexp_extract_all("text", F.lit(rf"(?is)<{tag}>.*?</{tag}>"), 0), "\n"))
    rest = trim(F.when(trim(F.col("blocks")) != "", F.replace("text", F.col("blocks"), F.lit(""))).otherwise(F.col("text")))
    bucket = F.when(F.col("role").isin("system", "developer"), "system").when(F.col("role").isin("user", "assistant"), "recent_context").otherwise("other")
    parts = F.array(F.struct(F.lit("summary").alias("bucket"), F.col("blocks").alias("t")), F.struct(bucket.alias("bucket"), rest.alias("t")))
    told = rows.select("record_id", "at", F.explode(parts).alias("p")).select("record_id", "at", "p.*").filter("t <> ''")
    tools = F.try_parse_json("tools")
    more = snapshots.filter(F.size(F.try_variant_get(tools, "$", "array<variant>")) > 0).select("record_id", F.lit(2**31 - 1).alias("at"), F.lit("other").alias("bucket"), F.to_json(tools).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])
    return told.unionByName(more).groupBy("record_id", "bucket").agg(F.array_join(ordered, "\n").alias("text"))


def message_breakdown(snapshots: DataFrame, counter: Callable[[str], float] | None = None, tag: str = "log_summary") -> DataFrame:
    """record_id, total, the tokens of BUCKETS, unclassified, measured: where the tokens of a list of messages went.

    snapshots: as for message_buckets, with actual_tokens, what the provider measured (null: not yet). The buckets' counts
    are scaled down to what was measured where they are more; what they don't explain of it is unclassified. Without a
    measure the total is theirs. Records without any tokens are left out.
    """
    counted = counted_tokens(message_buckets(snapshots, tag), counter=counter)
    seeds = counted.groupBy("record_id").agg(*(F.sum(F.when(F.col("bucket") == b, F.col("tokens"))).alias(f"_{b}") for b in BUCKETS))
    seeds = snapshots.select("record_id", "actual_tokens").join(seeds, "record_id", "left").withColumns({f"_{b}": F.coalesce(f"_{b}", F.lit(0)) for b in BUCKETS})
    found = sum((F.col(f"_{b}") for b in BUCKETS), F.lit(0))
    rows = seeds.withColumn("total", F.coalesce("actual_tokens", found).cast("long")).filter("total > 0")
    rows = with_shares(rows, "shares", [F.col(f"_{b}") for b in BUCKETS], F.col("total"))
    shares = [F.col("shares")[k].alias(b) for k, b in enumerate(BUCKETS)]
    return rows.select("record_id", "total", *shares, F.greatest(F.col("total") - _sum("shares"), F.lit(0)).alias("unclassified"), F.col("actual_tokens").isNotNull().alias("measured"))
