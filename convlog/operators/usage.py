"""Usage logs of model calls: counters from provider payloads, event streams, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions.text import redacted, trim
from convlog.store import stored

# fixed values: where providers put a counter, most telling first; statuses worth another try; events that end a stream
PATHS = {
    "prompt_tokens": ["$.usage.prompt_tokens", "$.usage.input_tokens", "$.usageMetadata.promptTokenCount"],
    "completion_tokens": ["$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount"],
    "reasoning_tokens": ["$.usage.completion_tokens_details.reasoning_tokens", "$.usage.output_tokens_details.reasoning_tokens", "$.usage.reasoning_tokens", "$.usageMetadata.thoughtsTokenCount"],
    "total_tokens": ["$.usage.total_tokens", "$.usageMetadata.totalTokenCount"],
    "finish_reason": ["$.choices[0].finish_reason", "$.choices[0].stop_reason", "$.finish_reason", "$.stop_reason", "$.stopReason", "$.candidates[0].finishReason"],
}
RETRIABLE = ["408", "502", "503", "504", "520", "521", "522", "523", "524"]
BLANK_LINE = r"\r\n\r\n|\n\n|\r\r"
UNIT_BYTES = 1 << 16  # of a stream, in one row while it is put together
STREAM_ENDS = ["message_stop", "message-end", "response.completed"]
ERROR_TEXT = r"(?i)^\s*\[(?:API(?:[\s_-]+)?(?:Error|错误|錯誤)|[^\]]*\bAPI)\]"
STREAM_REASON = ["$.choices[0].finish_reason", "$.choices[0].stop_reason", "$.finish_reason", "$.stop_reason", "$.stopReason", "$.delta.stop_reason", "$.candidates[0].finishReason"]


NUMERIC = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _number(v: Column) -> Column:
    """A finite number of 0 or more from a variant: a number, or a string that is one; nothing else counts."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    other = kind.isin("BOOLEAN", "VOID") | kind.startswith("OBJECT") | kind.startswith("ARRAY")
    n = F.when(kind == "STRING", F.when(text.rlike(NUMERIC), text.try_cast("double"))).when(~other, F.try_variant_get(v, "$", "double"))
    return F.when((n >= 0) & (n < float("inf")), n)


def _present(payload: Column, path: str) -> Column:
    """The value at a path; null where there is none or it is null."""
    v = F.try_variant_get(payload, path, "variant")
    return F.when(~F.is_variant_null(v), v)


def _count(payload: Column, paths: list[str]) -> Column:
    """The first number of 0 or more, rounded down, in a parsed payload."""
    return F.coalesce(*(F.floor(_number(F.try_variant_get(payload, p, "variant"))) for p in paths))


def _bounded(text: Column, most: int = 200) -> Column:
    """Trimmed and cut; null where it is blank."""
    return F.substring(F.nullif(trim(text), F.lit("")), 1, most)


def _string(payload: Column, paths: list[str], most: int = 200) -> Column:
    """The first value that is there, if it is a string that isn't blank, trimmed and cut."""
    v = F.coalesce(*(_present(payload, p) for p in paths))
    return _bounded(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), most)


def completion_metadata(calls: DataFrame) -> DataFrame:
    """calls (…, payload, response) with counters, finish_reason, model and response_characters; total is the sum where it
    isn't given. A payload that isn't JSON has none; a model it doesn't name is that of the column model, if there is one.
    Each payload is parsed once."""
    p = F.col("_parsed")
    out = calls.withColumn("_parsed", F.try_parse_json("payload"))
    counters = {name: _count(p, PATHS[name]) for name in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")}
    out = out.withColumns(counters | {"finish_reason": _string(p, PATHS["finish_reason"]), "model": _string(p, ["$.model"]) if "model" not in calls.columns else F.when(_present(p, "$.model").isNotNull(), _string(p, ["$.model"])).otherwise(_bounded(F.col("model"))), "response_characters": F.length("response").cast("long")})
    return out.withColumn("total_tokens", F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))).drop("_parsed")


def response_text(payload: Column) -> Column:
    """The answer's text, wherever the provider put it; of a list of parts, their texts in turn."""
    v = F.try_parse_json(payload)
    content = "$.choices[0].message.content"
    parts = F.transform(F.try_variant_get(v, content, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit("")))
    return F.coalesce(F.array_join(parts, ""), *(F.try_variant_get(v, p, "string") for p in (content, "$.choices[0].text", "$.content")))


# fixed values: where a provider names the tokens of an input; names of fields that hold reasoning
INPUT_TOTAL = ["total_input_tokens", "totalInputTokens", "prompt_tokens", "promptTokens", "prompt_token_count", "promptTokenCount"]
INPUT_FRESH = ["input_tokens", "inputTokens"]
INPUT_CACHED = [["cache_creation_input_tokens", "cacheCreationInputTokens"], ["cache_read_input_tokens", "cacheReadInputTokens"]]
REASONING = r"(?i)(?:reason|thinking|thought|analysis)"
PROVIDERS = ["main", "openai-compatible"]


def input_tokens(payload: Column) -> Column:
    """Tokens of an input, rounded: a stated total, else the fresh ones with what caches took and gave; null where none is
    stated. Looked for in the innermost of usage and usageMetadata that are objects, else at the top."""
    v = F.try_parse_json(payload)

    def record(of: Column, path: str) -> Column:
        inner = F.try_variant_get(of, path, "variant")
        return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner)

    usage = F.coalesce(record(v, "$.usage"), record(v, "$"))
    at = F.coalesce(record(usage, "$.usageMetadata"), usage)
    rounded = lambda n: F.floor(n + 0.5)

    def count(name: str) -> Column:
        return rounded(_number(F.try_variant_get(at, f"$.{name}", "variant")))

    cached = sum((F.coalesce(rounded(_number(F.coalesce(*(_present(at, f"$.{x}") for x in names)))), F.lit(0)) for names in INPUT_CACHED), F.lit(0))
    return F.coalesce(*map(count, INPUT_TOTAL), *(count(x) + cached for x in INPUT_FRESH))


def stored_metadata(calls: DataFrame) -> DataFrame:
    """calls (…, provider, requested_max_tokens, response_characters, counters, finish_reason, source, model, fallback_from)
    that are valid: a known provider, and numbers of 0 or more for the limit and the length. Counters are rounded down; what
    isn't a number of 0 or more, or a string that is one, blank texts and unknown fall-backs become null."""
    kinds = dict(calls.dtypes)

    def whole(name: str) -> Column:
        c = F.when(F.col(name).rlike(NUMERIC), F.col(name).try_cast("double")) if kinds[name] == "string" else F.lit(None) if kinds[name] == "boolean" else F.col(name)
        return F.when((c >= 0) & (c < float("inf")), F.floor(c).cast("long"))

    counters = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "requested_max_tokens", "response_characters")
    texts = {name: _bounded(F.col(name)) for name in ("finish_reason", "source", "model") if name in kinds}
    kept = calls.filter(F.col("provider").isin(PROVIDERS)).withColumns({name: whole(name) for name in counters} | texts)
    kept = kept.withColumn("fallback_from", F.when(F.col("fallback_from").isin(PROVIDERS), F.col("fallback_from")))
    return kept.filter("requested_max_tokens is not null and response_characters is not null")


def value_type(payload: Column, path: str | None = None) -> Column:
    """missing, null, array, object, string, number or boolean, of a JSON text or a path in it."""
    v = F.try_parse_json(payload)
    v = F.try_variant_get(v, path, "variant") if path else v
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")


def field_names(json: Column, secrets: list[str], most: int = 24, chars: int = 80) -> Column:
    """The first names of an object's fields, without control characters and secrets, cut and sorted."""
    names = F.slice(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), 1, most)
    return F.array_sort(F.filter(F.transform(names, lambda k: F.substring(redacted(F.regexp_replace(k, r"[\p{Cc}\p{Cf}]", ""), secrets), 1, chars)), lambda k: k != ""))


def has_reasoning(payload: Column) -> Column:
    """Whether a field, at any depth, or the type of a part in a list is named after reasoning."""
    text = F.to_json(F.try_parse_json(payload))
    word = REASONING.removeprefix("(?i)")
    key = text.rlike(rf'(?i)"(?:[^"\\]|\\.)*{word}(?:[^"\\]|\\.)*":')
    return F.coalesce(key | text.rlike(rf'(?i)"type":"(?:[^"\\]|\\.)*{word}'), F.lit(False))


def response_shape(answers: DataFrame, secrets: list[str]) -> DataFrame:
    """answers (…, payload) with what a diagnostic may tell of a payload without its content: types and names of fields."""
    p = F.col("payload")
    choice, message = F.get_json_object(p, "$.choices[0]"), F.get_json_object(p, "$.choices[0].message")
    return answers.withColumns({
        "response_type": value_type(p), "root_fields": field_names(p, secrets), "choice_fields": field_names(choice, secrets), "message_fields": field_names(message, secrets),
        "content_type": value_type(p, "$.choices[0].message.content"), "text_type": value_type(p, "$.choices[0].text"), "root_content_type": value_type(p, "$.content"), "has_reasoning": has_reasoning(p),
    })


def stream_error(event: Column, data: Column, id_prefix: str = "error-") -> Column:
    """Whether an event of a stream reports an error: by its name or type, a field error or detail, a message that is a
    text, or an id with a prefix that says so."""
    v = F.try_parse_json(data)
    there = [F.try_variant_get(v, f"$.{x}", "variant").isNotNull() for x in ("error", "detail")]
    text = F.schema_of_variant(F.try_variant_get(v, "$.message", "variant")) == "STRING"
    said = (F.try_variant_get(v, "$.type", "string") == "error") | F.try_variant_get(v, "$.id", "string").startswith(id_prefix)
    return F.coalesce(event == "error", F.lit(False)) | there[0] | there[1] | F.coalesce(text, F.lit(False)) | F.coalesce(said, F.lit(False))


def retriable(status: Column, message: Column) -> Column:
    """Whether the status, or one that the message names as HTTP or status, is worth another try."""
    said = F.regexp_extract_all(message, F.lit(r"(?i)\b(?:HTTP|status)\s*[:=]?\s*(\d{3})\b"), 1)
    return F.coalesce(status.cast("string").isin(RETRIABLE), F.lit(False)) | F.coalesce(F.exists(said, lambda s: s.isin(RETRIABLE)), F.lit(False))


def stream_events(pieces: DataFrame) -> DataFrame:
    """conv_id, no, event, data from chunks (conv_id, seq, bytes as text) of event streams: blocks end at a blank line,
    comments are left out, several data lines are joined. Streams may have any length: they are put together in units of some
    UNIT_BYTES that begin where text goes on behind a blank line, so that no row holds a whole long stream."""
    stream = Window.partitionBy("conv_id")
    placed = pieces.filter("piece <> ''").select("conv_id", "piece", F.row_number().over(stream.orderBy("seq", "piece")).alias("at"))
    parts = placed.select("conv_id", "at", F.posexplode(F.split("piece", rf"(?<={BLANK_LINE})(?=[^\r\n])", 2)).alias("k", "part"))
    order = stream.orderBy("at", "k")
    before, size = F.lag("part").over(order), F.sum(F.octet_length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ended = before.endswith("\r\n\r\n") | before.endswith("\n\n") | before.endswith("\r\r")
    begun = parts.withColumns({"begins": ended & ~F.substring("part", 1, 1).isin("\r", "\n"), "unit": F.floor(size / UNIT_BYTES)})
    units = begun.withColumn("unit", F.max(F.when(F.col("begins"), F.col("unit"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    units = units.withColumn("unit", F.coalesce("unit", F.lit(0)))
    whole = units.groupBy("conv_id", "unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "k", "part"))), lambda x: x["part"]), "").alias("s"))
    held = whole.select("conv_id", "unit", F.split("s", BLANK_LINE).alias("blocks"))
    first = F.sum(F.size("blocks") - 1).over(stream.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))  # a unit's last one is empty or the stream's
    blocks = held.withColumn("first", F.coalesce(first, F.lit(0))).select("conv_id", "first", F.posexplode("blocks").alias("k", "block"))
    lines = F.split("block", r"\r\n|\n|\r")
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", ""))
    named = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.regexp_replace(x, "^event: ?", ""))
    told = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("message"))
    return blocks.select("conv_id", (F.col("first") + F.col("k")).cast("int").alias("no"), told.alias("event"), F.array_join(data, "\n").alias("data")).filter("data <> ''")


USAGE_DEPTH = 5  # levels of a usage map


def merged_usage(usages: DataFrame, depth: int = USAGE_DEPTH) -> DataFrame:
    """conv_id, root, path, number, text: what the usage maps (conv_id, no, root, map: a variant) of a stream say together, by
    the path of keys to each value: the largest number of 0 or more, or where there is none the first text or boolean."""
    spark, at, leaves = usages.sparkSession, usages.select("conv_id", "no", "root", F.lit("").alias("path"), F.col("map").alias("value")), None
    for _ in range(depth):
        inner = at.filter(F.schema_of_variant("value").startswith("OBJECT"))
        step = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("held")))
        at = step.select("conv_id", "no", "root", F.concat("path", F.lit("."), F.col("key")).alias("path"), F.col("held").alias("value"))
        kind = F.schema_of_variant("value")
        here = at.filter(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"))
        leaves = here if leaves is None else leaves.unionByName(here)
    number = _number(F.col("value"))
    told = leaves.select("conv_id", "no", "root", "path", number.alias("number"), F.when(number.isNull(), F.try_variant_get("value", "$", "string")).alias("text"))
    merged = told.groupBy("conv_id", "root", "path").agg(F.max("number").alias("number"), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("no"))).alias("text"))
    return merged.select("conv_id", "root", F.substr("path", F.lit(2)).alias("path"), "number", F.when(F.col("number").isNull(), F.col("text")).alias("text"))


def ended_events(events: DataFrame, id_prefix: str = "error-") -> DataFrame:
    """events (conv_id, no, event, data) of whole streams up to the event that ends each, with parsed (variant), reason and
    ends. A stream ends at [DONE], at an event or type that says so, or with done = true; a finish reason makes it whole
    too, but what follows still counts. Streams without an end, with an error or with data that isn't JSON are left out."""
    done = F.col("data") == "[DONE]"
    kind = F.coalesce(_string(F.col("parsed"), ["$.type"]), F.nullif(trim(F.col("event")), F.lit("")))
    true = F.schema_of_variant(F.try_variant_get("parsed", "$.done", "variant")) == "BOOLEAN"
    ends = done | F.coalesce(kind.isin(STREAM_ENDS), F.lit(False)) | F.coalesce(true & F.try_variant_get("parsed", "$.done", "boolean"), F.lit(False))
    read = events.withColumn("parsed", F.try_parse_json("data")).withColumns({"ends": ends, "reason": _string(F.col("parsed"), STREAM_REASON)})
    stream = Window.partitionBy("conv_id")
    upto = F.min(F.when(F.col("ends"), F.col("no"))).over(stream)
    kept = read.withColumn("upto", upto).filter("upto is null or no <= upto")
    bad = ~done & (F.col("parsed").isNull() | stream_error(F.col("event"), F.col("data"), id_prefix))
    told = kept.withColumn("bad", F.max(bad).over(stream)).withColumn("whole", F.max(F.col("ends") | F.col("reason").isNotNull()).over(stream))
    return told.filter("whole and not bad").drop("bad", "whole", "upto")


def stream_completion(events: DataFrame) -> DataFrame:
    """conv_id, response, finish_reason, model and counters of streams that came to their end (see ended_events).

    Usage maps, also those under message or response, are merged key by key before a counter is looked for, so that no key's
    number stands for another's. A stream whose text begins as an error report does is left out too.
    """
    v = F.col("parsed")
    parsed = stored(ended_events(events))  # each level of the usage maps reads it
    text = F.coalesce(*(F.try_variant_get(v, p, "string") for p in ("$.choices[0].delta.content", "$.delta.text")), F.lit(""))
    told = parsed.select("conv_id", "no", text.alias("t"), "reason", _string(v, ["$.model", "$.message.model", "$.response.model"]).alias("model"))
    inner = told.groupBy("conv_id", F.shiftright("no", 10).alias("part")).agg(  # by a thousand events first: a long stream's are not all held at once
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "").alias("t"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("no"))).alias("reason"), F.max(F.when(F.col("reason").isNotNull(), F.col("no"))).alias("reason_no"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("no"))).alias("model"), F.min(F.when(F.col("model").isNotNull(), F.col("no"))).alias("model_no"),
    )
    rolled = inner.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "").alias("response"),
        F.max_by("reason", "reason_no").alias("finish_reason"),
        F.min_by("model", "model_no").alias("model"),
    )
    roots = F.array(*(F.struct(F.lit(root).alias("root"), F.try_variant_get(v, p, "variant").alias("map")) for root, p in (("usage", "$.usage"), ("usage", "$.message.usage"), ("usage", "$.response.usage"), ("usageMetadata", "$.usageMetadata"))))
    maps = parsed.select("conv_id", "no", F.explode(roots).alias("u")).select("conv_id", "no", "u.root", "u.map").filter("map is not null")
    named = merged_usage(maps).filter("number is not null").select("conv_id", F.concat_ws(".", F.lit("$"), "root", "path").alias("path"), F.floor("number").alias("n"))
    counters = ("prompt_tokens", "completion_tokens")
    wanted = named.filter(F.col("path").isin([p for name in counters for p in PATHS[name]]))
    found = wanted.groupBy("conv_id").agg(*(F.coalesce(*(F.max(F.when(F.col("path") == p, F.col("n"))) for p in PATHS[name])).alias(name) for name in counters))
    return rolled.filter(~F.col("response").rlike(ERROR_TEXT)).join(found, "conv_id", "left")


def keep_latest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_k") <= n).drop("_k")


def merge_by_id(first: DataFrame, second: DataFrame, key: str, id_: str, n: int) -> DataFrame:
    """Rows of both (key, id, pos, value): the place of an id's first row, the value of its last; then the latest n."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    at = F.struct("side", "pos")
    merged = both.groupBy(key, id_).agg(F.min(at).alias("at"), F.max_by("value", at).alias("value"))
    return keep_latest(merged, key, "at", n).select(key, id_, "value", F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long").alias("place"))


def run_metrics(attempts: DataFrame) -> DataFrame:
    """conv_id and counters of attempts (conv_id, task, status, duration_ms, messages)."""
    done = F.col("status") == "success"
    out = attempts.groupBy("conv_id").agg(
        F.count_if(done & (F.col("task") == "summary")).alias("summaries"),
        F.count_if(done & (F.col("task") == "rollup")).alias("rollups"),
        F.count_if(~done).alias("failures"),
        F.coalesce(F.sum(F.when(done, F.col("duration_ms"))), F.lit(0)).alias("total_ms"),
        F.coalesce(F.sum(F.when(done, F.col("messages"))), F.lit(0)).alias("messages"),
    )
    updates = F.col("summaries") + F.col("rollups")
    return out.withColumn("average_ms", F.when(updates > 0, F.floor(F.col("total_ms") / updates + 0.5)).otherwise(0))
