"""Queries of the jobs and of the smaller operators, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions import text as X
from convlog.operators import breakdown, chunks, context, jobs, rollup, state, tokens, turns, usage
from convlog.operators.lineage import frontier_signature, ordered_text
from convlog.plans import log_queries as L
from convlog.sources.messages import from_conversations, from_events


def _boundary():
    return (F.col("name") == "click") & (F.col("message_id") % 9 == 4)


def w9_phase_chunks(spark, d):
    return chunks.plan_by_turns(from_events(spark, d), L.TURNS, _boundary())


def w18_phase_start(spark, d):
    return context.phase_start(from_events(spark, d), _boundary())


def p13_request_types(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", "swipe").when(F.col("event_type") == "error", "quiet").otherwise("normal")
    return t.select("event_id", kind.alias("kind")).filter(F.col("kind").isNull() | F.col("kind").isin("normal", "regenerate", "swipe"))


def j7_unselected(spark, d):
    book = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id")
    picked = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 100).alias("item_id"))
    return book.join(picked.filter("item_id % 3 = 0"), "item_id", "left_anti")


def j8_unfinished(spark, d):
    c = L._hashed(spark, d)
    drafts = c.filter("chunk < conv_id % 6").withColumn("source_hash", F.when((F.col("chunk") == 2) & (F.col("conv_id") % 2 == 0), F.lit("old")).otherwise(F.col("source_hash")))
    return jobs.unfinished(c, drafts).select("conv_id", "chunk", "start_id", "end_id")


def j10_consumed(spark, d):
    e = L._entries(spark, d)
    return e.join(rollup.roll_up(e, *L.CAPS, levels=2).filter("level = 1").select("conv_id", "start_id"), ["conv_id", "start_id"], "left_anti").select("conv_id", "start_id")


def a5_parent_digest(spark, d):
    return rollup.roll_up(L._entries(spark, d), *L.CAPS, levels=2).filter("level = 2").select("conv_id", "start_id", "source_hash")


def a8_net_saved(spark, d):
    m = from_events(spark, d)
    w = turns.recent_window(m, L.SIZE)
    gone = m.join(w, "conv_id").filter("message_id < retained_start and not is_system").groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text"))).alias("removed"), F.count("*").alias("n"))
    return gone.select("conv_id", F.greatest(F.lit(0), F.col("removed") - F.col("n") * 7).cast("long").alias("net_saved"))


def a11_role_buckets(spark, d):
    m = from_conversations(spark, d)
    bucket = F.when(F.col("name").isin("system", "developer"), "system").when(F.col("name").isin("user", "assistant"), "chat").otherwise("other")
    return m.groupBy("conv_id", bucket.alias("bucket")).agg(ordered_text(F.col("text"), F.col("message_id"), "\n").alias("text"))


def a13_token_breakdown(spark, d):
    """Words by role as seeds, a budget of a third of all, split in proportion."""
    m = from_conversations(spark, d)
    seeds = m.groupBy("conv_id", "name").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))
    seeds = seeds.withColumn("idx", F.when(F.col("name") == "system", 1).when(F.col("name") == "user", 2).otherwise(3)).withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy("conv_id")) / 3))
    return tokens.allocate(seeds, ["conv_id"]).select("conv_id", "name", "tokens", "share")


def a20_injected_blocks(spark, d):
    e = L._entries(spark, d)
    block = X.summary_block(F.col("text"), F.col("start_id"), F.col("end_id"), F.col("level"))
    return e.groupBy("conv_id").agg(F.sum(F.regexp_count(block, F.lit(r"<[a-z_]*summary>"))).cast("long").alias("blocks"))


def a21_report_counts(spark, d):
    return jobs.report_counts(rollup.roll_up(L._entries(spark, d), *L.CAPS))


def model_bodies(t):
    """Response bodies of up to 1,000 parts each, so that none grows with the table."""
    listed = t.groupBy(F.floor(F.col("p_partkey") / 1000).alias("k")).agg(F.collect_list(F.struct(F.concat(F.lit("m"), (F.col("p_partkey") % 57).cast("string")).alias("id"))).alias("data"))
    return listed.select(F.to_json(F.struct("data")).alias("body"))


def t3_models(spark, d):
    body = model_bodies(spark.read.parquet(f"{d}/part.parquet"))
    names = body.select(F.explode(F.from_json("body", "data array<struct<id:string,model:string,name:string>>")["data"]).alias("m")).select(X.trim(F.coalesce("m.id", "m.model", "m.name")).alias("model"))
    return names.filter(F.length("model").between(1, 200)).distinct().orderBy("model")


def t4_newest(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def u4_frontiers_differ(spark, d):
    e = L._entries(spark, d)
    other = e.withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("start_id") == 0), F.lit("new")).otherwise(F.col("text"))).filter("conv_id % 7 <> 0 or start_id > 0")
    return jobs.frontiers_differ(e, other, ["level", "start_id", "end_id", "source_hash", "text"])


def u5_splice(spark, d):
    e = L._entries(spark, d)
    parents = rollup.roll_up(e, *L.CAPS, levels=2).filter("level = 2 and conv_id % 2 = 0")
    return jobs.splice(e, parents).select("conv_id", "level", "start_id", "end_id")


def f4_history(spark, d):
    e = L._entries(spark, d)
    block = X.summary_block(F.col("text"), F.col("start_id"), F.col("end_id"), F.col("level"))
    return e.filter("text <> ''").groupBy("conv_id").agg(F.concat(F.lit("Earlier history:\n"), ordered_text(block, F.col("start_id"), "\n")).alias("history"))


def f6_tagged_blocks(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return t.select("page_id", F.size(X.tagged_blocks(F.col("html"), "p")).cast("long").alias("blocks"))


ANSWERS = ['{"choices":[{"message":{"content":"a#"}}]}', '{"choices":[{"text":"b#"}]}', '{"content":"c#"}', '{"choices":[{"message":{"content":[{"type":"text","text":"d"},{"type":"image"},{"text":"#"}]},"text":"no"}]}', '{"choices":[{"message":{"content":"[#]"}}]}', "not json #"]


def f11_response_text(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    p = F.replace(F.get(F.array(*map(F.lit, ANSWERS)), (F.col("event_id") % len(ANSWERS)).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    return t.select("event_id", usage.response_text(p).alias("response"))


def f16_generation_signature(spark, d):
    m = from_conversations(spark, d)
    return m.select("conv_id").distinct().select("conv_id", F.sha2(F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit(3000).alias("tokens"), F.lit("default").alias("model"))), 256).alias("signature"))


def s4_valid_provenance(spark, d):
    e = L._entries(spark, d)
    run = e.withColumn("run", F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("start_id")) - 1) / 3)).filter("conv_id % 4 <> 0 or start_id % 5 <> 0")
    parents = run.groupBy("conv_id", "run").agg(F.lit(2).alias("level"), F.min("start_id").alias("start_id"), F.max("end_id").alias("end_id"), F.sort_array(F.collect_list(F.struct("start_id", "end_id", "level"))).alias("sources"))
    return jobs.valid_provenance(parents).select("conv_id", "run", F.coalesce(F.size("sources"), F.lit(-1)).cast("long").alias("sources"))


def s5_whole_checkpoints(spark, d):
    e = L._plan(spark, d).withColumn("text", F.when((F.col("chunk") == 3) & (F.col("conv_id") % 3 == 0), "").otherwise("t")).filter("conv_id % 5 <> 0 or chunk <> 2")
    return jobs.whole_checkpoints(e.select("conv_id", F.col("chunk").alias("seq"), "start_id", "end_id", "text")).select("conv_id", "seq")


def s14_recent_errors(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'")
    return usage.keep_latest(t, "user_id", "event_id", 3).select("user_id", "event_id", X.redacted(F.col("props"), ["a", "1"]).alias("props"))


def x2_chunk_prompts(spark, d):
    m = from_conversations(spark, d)
    return jobs.chunk_prompts(m, chunks.plan_by_turns(m, 1))


def x3_summarise(spark, d):
    m = from_conversations(spark, d)
    return jobs.summarise(m, chunks.plan_by_turns(m, 1)).select("conv_id", "start_id", "end_id", "text")


def x4_roll_up_all(spark, d):
    m = from_events(spark, d)
    return rollup.roll_up(jobs.summarise(m, chunks.plan_by_turns(m, L.TURNS)), *L.CAPS).select("conv_id", "level", "start_id", "end_id")


def x1_plan_ready(spark, d):
    """Phases begin at some of the rows; the limit on characters binds for some chunks."""
    return jobs.plan_ready(from_events(spark, d), L.SIZE, L.TURNS, L.LIMIT, F.col("name") != "view", _boundary())


def x5_rollup_prompts(spark, d):
    e = L._entries(spark, d)
    return jobs.rollup_prompts(e, rollup.roll_up(e, *L.CAPS, levels=2).filter("level = 2"))


def x8_rebuild(spark, d):
    """A third of the logs has drafts of its first chunks; some chunks see no text, so their logs stay as they were."""
    m = from_events(spark, d)
    c = L._hashed(spark, d)
    drafts = c.filter("chunk < 2 and conv_id % 3 = 0").select("conv_id", F.lit(1).alias("level"), "start_id", "end_id", F.lit(False).alias("deleted"), F.lit("draft").alias("text"), F.when(F.col("conv_id") % 2 == 0, F.col("source_hash")).otherwise("old").alias("source_hash"))
    seen = m.withColumn("text", F.when(F.col("conv_id") % 5 > 0, F.col("text")).otherwise(F.lit("")))
    entries, waiting = jobs.rebuild(L._entries(spark, d), seen, c, drafts, lambda texts: F.size(texts).cast("string"))
    both = entries.select("conv_id", "start_id", "text", F.lit("entry").alias("kind")).unionByName(waiting.select("conv_id", "start_id", "text", F.lit("draft").alias("kind")))
    return both.withColumn("text", F.when(F.col("text") == "draft", "draft").when(F.length("text") < 4, "new").otherwise("old"))


PROMPTS = ['"one #"', '[{"content":"two"},{"text":"#"},{"image":1}]', '{"content":[{"type":"text","text":"three #"},"four"]}', '{"content":null,"text":"no"}', "{{user}} #", '[["a",[" b #"]],""]', '{"text":5}']


def f7_prompt_text(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", state.prompt_text(_pick(PROMPTS)).alias("text"))


def h3_substituted(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select("event_id", state.substituted(F.concat(F.lit("{{user}} and {{ user }}, {{other}}: "), F.col("event_type")), {"user": "U", "kind": "K"}).alias("text"))


def s7_guarded(spark, d):
    e = L._entries(spark, d).select("conv_id", "start_id", (F.col("conv_id") % 4).alias("owner"))
    owners = from_events(spark, d).select("conv_id", (F.col("conv_id") % 3).alias("owner")).distinct()
    kept, refused = state.guarded(e, owners)
    return kept.withColumn("kept", F.lit(True)).unionByName(refused.withColumn("kept", F.lit(False))).select("conv_id", "start_id", "kept")


def s6_regular_reports(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("event_id")
    r = t.select(
        F.col("user_id").alias("conv_id"), F.when(v % 5 > 0, v).alias("created_at"), F.when(v % 2 == 0, "swipe").alias("kind"), F.when(v % 3 > 0, v / 2).alias("retained_start"), F.when(v % 3 == 0, v).alias("retained_end"), (v % 7 - 3).alias("removed"), (v % 9 - 4.5).alias("tokens_removed"),
        F.lit(None).cast("long").alias("tokens_injected"), v.alias("tokens_saved"), F.lit(None).cast("long").alias("covered"), (v % 100).alias("duration_ms"), F.when(v % 4 == 0, F.array(F.lit("a"), F.lit(None), F.lit("b"), F.lit("c"))).alias("warnings"),
    )
    return state.regular_reports(r, 2).withColumn("warnings", F.array_join("warnings", ","))


def s6_regular_traces(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("event_id")
    traces = t.select(F.col("user_id").alias("conv_id"), v.alias("pos"), F.when(v % 11 > 0, v).alias("id"), F.col("ts").alias("created_at"), F.when(v % 3 == 0, "error").when(v % 3 == 1, "summary").otherwise("other").alias("stage"), F.col("event_type").alias("message"))
    return state.regular_traces(traces, 5).select("conv_id", "pos", "stage")


def r6_still_valid(spark, d):
    """Results of chunks whose rows changed, or whose log's entries did, since they were begun."""
    e = L._entries(spark, d)
    begun = e.join(frontier_signature(e), "conv_id").select("conv_id", "start_id", "end_id", F.when(F.col("start_id") % 3 == 0, "old").otherwise(F.col("source_hash")).alias("source_hash"), F.when(F.col("conv_id") % 4 == 0, "old").otherwise(F.col("signature")).alias("signature"))
    return jobs.still_valid(begun, from_events(spark, d), e).select("conv_id", "start_id")


def j11_preferred_snapshots(spark, d):
    m = from_events(spark, d)
    v = F.col("message_id")
    logs = m.groupBy("conv_id").agg((F.max("message_id") % 3).alias("last_id"), F.max(F.when(F.col("conv_id") % 3 == 0, "r1")).alias("run_id"), F.max(F.col("conv_id") % 4).alias("sequence"))
    snapshots = m.select("conv_id", v.alias("snapshot_id"), F.when(F.col("name") != "click", F.concat(F.lit("r"), (v % 5).cast("string"))).alias("run_id"), (v % 3).alias("expected_id"), (v % 4).alias("sequence"), (v * 7 % 11).alias("captured_at"))
    return jobs.preferred_snapshots(logs, snapshots)


def x7_inspections(spark, d):
    return context.inspections(from_events(spark, d), L._first_entries(spark, d), L.SIZE, _boundary(), F.col("message_id") % 2 == 0, (4, 2)).withColumn("warnings", F.array_join("warnings", ","))


def _records(spark, d):
    """Records of the events' counts: chat completions with and without a total, text prompts, and prompts of neither."""
    t = spark.read.parquet(f"{d}/events.parquet")
    v, u = F.col("event_id"), F.col("user_id")
    api = F.when(v % 4 < 2, "openai").when(v % 4 == 2, "text")
    part = {"raw": v % 900, "summary": v % 71, "character": v % 53, "world_info": u % 47, "examples": v % 29, "anchors": v % 31, "instruction": u % 37, "story": F.when(v % 5 > 0, v % 300).otherwise(0), "chat": F.when(v % 5 > 0, v % 500).otherwise(0)}
    part |= {"stored_total": F.when(v % 4 == 0, v % 800), "oai_system": v % 61 - 5, "oai_examples": v % 23, "oai_conversation": v % 700}
    return t.select(v.alias("record_id"), api.alias("main_api"), *(x.alias(k) for k, x in part.items()))


def a14_token_breakdown(spark, d):
    return breakdown.token_breakdown(_records(spark, d))


INPUTS = [
    '{"usage":{"total_input_tokens":"#","prompt_tokens":1}}', '{"promptTokenCount":#.5}', '{"usage":{"usageMetadata":{"prompt_token_count":#}}}', '{"usage":{"input_tokens":#,"cache_creation_input_tokens":3,"cacheReadInputTokens":"4"}}',
    '{"usageMetadata":{"inputTokens":#}}', '{"usage":{"prompt_tokens":-#,"input_tokens":null}}', "no json #", '{"usage":{"prompt_tokens":true,"inputTokens":#}}',
    '{"usage":null,"prompt_tokens":#}', '{"usage":"x","prompt_tokens":#}',
]


def _pick(texts: list[str]) -> Column:
    return F.replace(F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts)).cast("int")), F.lit("#"), F.col("event_id").cast("string"))


def f10_input_tokens(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", usage.input_tokens(_pick(INPUTS)).alias("tokens"))


def f9_stored_metadata(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("event_id")
    calls = t.select(
        "event_id", F.get(F.array(F.lit("main"), F.lit("openai-compatible"), F.lit("other"), F.lit(None)), (v % 4).cast("int")).alias("provider"), (v % 10 - 1).alias("requested_max_tokens"), (F.col("user_id") / 2).alias("response_characters"), (v % 7 - 3).alias("prompt_tokens"),
        (v % 9).alias("completion_tokens"), F.lit(None).cast("long").alias("reasoning_tokens"), (v % 5 + 0.5).alias("total_tokens"), F.when(v % 3 == 0, "  ").otherwise(" stop ").alias("finish_reason"), F.when(v % 2 == 0, "main").otherwise("x").alias("fallback_from"),
        F.lit(" s ").alias("source"), F.when(v % 2 == 0, " ").otherwise("m").alias("model"),
    )
    return usage.stored_metadata(calls)


SHAPES = [
    '{"id":#,"choices":[{"message":{"content":[{"type":"thinking"}],"role":"a"},"index":0}]}', '{"choices":[{"text":"t#","finish_reason":"stop"}],"usage":{}}', '{"content":"#","secret-k":null}', "[#]", '"#"', "#", "null", "no json",
    '{"choices":[{"message":{"reasoning_content":"x","content":null}}]}', '{"choices":[],"content":{"a":["the reason is \\"x\\": #"]}}',
]


def f12_response_shape(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", _pick(SHAPES).alias("payload"))
    return usage.response_shape(t, ["secret"]).select("event_id", "response_type", *(F.array_join(c, ",").alias(c) for c in ("root_fields", "choice_fields", "message_fields")), "content_type", "text_type", "root_content_type", "has_reasoning")


FAULTS = ['{"type":"error"}', '{"error":null}', '{"message":"#"}', '{"message":{"role":"a"}}', '{"detail":#}', '{"id":"error-#"}', '{"id":"#"}', "[DONE]", '{"type":"ping"}']


def p15_stream_error(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select("event_id", usage.stream_error(F.when(F.col("event_id") % 11 == 0, "error").otherwise("message"), _pick(FAULTS)).alias("fault"))


PAST = ("(?:last|previous|first) (?:time|part|chapter)|before that", "who|what|which|where|recall|remember", "recall|remember|sum up", "earlier|before|so far")


def p5_earlier_phase(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", X.earlier_phase(F.coalesce("text", F.lit("")), *PAST).alias("asks"))


QUERIES = {f.__name__: f for f in (
    w9_phase_chunks, w18_phase_start, p13_request_types, j7_unselected, j8_unfinished, j10_consumed, a5_parent_digest, a8_net_saved, a11_role_buckets, a13_token_breakdown, a20_injected_blocks,
    a21_report_counts, t3_models, t4_newest, u4_frontiers_differ, u5_splice, f4_history, f6_tagged_blocks, f11_response_text, a14_token_breakdown, f10_input_tokens, f9_stored_metadata, f12_response_shape, p15_stream_error, p5_earlier_phase, f16_generation_signature, s4_valid_provenance, s5_whole_checkpoints,
    s14_recent_errors, x2_chunk_prompts, x3_summarise, x4_roll_up_all, x1_plan_ready, x5_rollup_prompts, x8_rebuild, f7_prompt_text, h3_substituted, s7_guarded, s6_regular_reports, s6_regular_traces, r6_still_valid, j11_preferred_snapshots, x7_inspections,
)}

_TEXT = "regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')"
_CONV_CHUNKS = L.CHUNKS_SQL.replace(f"// {L.TURNS}", "// 1")
_RUNS = f"{L.STACK}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_id) - 1 AS rn, (count(*) OVER (PARTITION BY conv_id) - 1) // 2 AS k FROM entries)"
_BLOCK = "'<log_summary>' || chr(10) || 'level L1' || chr(10) || 'messages ' || start_id || '-' || end_id || chr(10) || text || chr(10) || '</log_summary>'"

def _shares(t: str, b: str) -> str:
    """Shares of a budget b among a list t, in SQL."""
    exact = lambda k: f"({t}[{k}] * {b} / list_sum({t}))"
    ahead = f"{exact('j')} - floor({exact('j')}) > {exact('i')} - floor({exact('i')}) OR ({exact('j')} - floor({exact('j')}) = {exact('i')} - floor({exact('i')}) AND j < i)"
    left = f"{b} - list_sum(list_transform({t}, lambda x: floor(x * {b} / list_sum({t}))))"
    each = f"CASE WHEN list_sum({t}) = 0 OR {b} = 0 THEN 0 WHEN list_sum({t}) <= {b} THEN {t}[i] ELSE floor({exact('i')}) + CASE WHEN 1 + len(list_filter(range(1, len({t}) + 1), lambda j: {ahead})) <= {left} THEN 1 ELSE 0 END END"
    return f"list_transform(range(1, len({t}) + 1), lambda i: {each})"


SQL = {
    "w9_phase_chunks": f"""WITH {L.LOGS}, {L.FLAGS}, ph AS (SELECT *, sum((name = 'click' AND message_id % 9 = 4)::INT) OVER (PARTITION BY conv_id ORDER BY message_id) AS phase FROM f),
      b AS (SELECT *, coalesce(sum(completes::INT) OVER (PARTITION BY conv_id, phase ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM ph),
      p AS (SELECT conv_id, phase, t // {L.TURNS} AS part, min(message_id) AS start_id, max(message_id) AS end_id, count(*) FILTER (WHERE completes) AS turns_done FROM b GROUP BY ALL)
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_id) - 1 AS chunk, start_id, end_id, turns_done FROM p""",
    "w18_phase_start": f"WITH {L.LOGS}, c AS (SELECT conv_id, max(message_id) AS ci FROM m WHERE is_user AND NOT is_system GROUP BY conv_id) SELECT conv_id, max(message_id) AS phase_start FROM m JOIN c USING (conv_id) WHERE name = 'click' AND message_id % 9 = 4 AND message_id <= ci GROUP BY conv_id",
    "p13_request_types": "SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'swipe' ELSE 'normal' END AS kind FROM events WHERE event_type <> 'error'",
    "j7_unselected": "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id % 100 FROM documents WHERE doc_id % 100 % 3 = 0)",
    "j8_unfinished": f"WITH {L.LOGS}, {L.FLAGS}, {L.CHUNKS_SQL} SELECT conv_id, chunk, start_id, end_id FROM chunks WHERE chunk >= CASE WHEN conv_id % 2 = 0 THEN least(conv_id % 6, 2) ELSE conv_id % 6 END",
    "j10_consumed": f"{_RUNS} SELECT conv_id, start_id FROM r WHERE rn // 2 < k",
    "a5_parent_digest": f"""{_RUNS} SELECT conv_id, min(start_id) AS start_id, sha256(string_agg('=1' || chr(31) || '=' || start_id || chr(31) || '=' || end_id || chr(31) || '=' || source_hash || chr(31) || '=' || text || chr(31) || '=' || deleted, chr(30) ORDER BY start_id)) AS source_hash
      FROM r WHERE rn // 2 < k GROUP BY conv_id, rn // 2""",
    "a8_net_saved": f"WITH {L.LOGS}, {L.window_sql('turns', L.SIZE)} SELECT m.conv_id, greatest(0, sum(ceil(length(text) / 4.0)) - count(*) * 7)::BIGINT AS net_saved FROM m JOIN win USING (conv_id) WHERE message_id < retained_start AND NOT is_system GROUP BY m.conv_id",
    "a11_role_buckets": f"WITH {L.CONV} SELECT conv_id, CASE WHEN name = 'system' THEN 'system' ELSE 'chat' END AS bucket, string_agg(text, chr(10) ORDER BY message_id) AS text FROM m GROUP BY ALL",
    "a13_token_breakdown": f"""WITH {L.CONV}, s AS (SELECT conv_id, name, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, CASE name WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS idx FROM m GROUP BY ALL),
      x AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, floor(sum(tokens) OVER (PARTITION BY conv_id) / 3.0)::BIGINT AS b FROM s), y AS (SELECT *, tokens::DOUBLE * b / total AS exact FROM x),
      z AS (SELECT *, floor(exact) AS low, b - sum(floor(exact)) OVER (PARTITION BY conv_id) AS left_, row_number() OVER (PARTITION BY conv_id ORDER BY exact - floor(exact) DESC, idx) AS place FROM y)
      SELECT conv_id, name, tokens, (CASE WHEN total <= b THEN tokens ELSE low + CASE WHEN place <= left_ THEN 1 ELSE 0 END END)::BIGINT AS share FROM z""",
    "a20_injected_blocks": f"{L.STACK} SELECT conv_id, count(*) FILTER (WHERE text <> '') AS blocks FROM entries GROUP BY conv_id",
    "a21_report_counts": f"""WITH RECURSIVE {L.STACK_IN}, {L.NODES}
      SELECT conv_id, count(*) FILTER (WHERE NOT deleted) AS active, count(*) FILTER (WHERE deleted) AS deleted_entries, count(DISTINCT level) AS levels, max(end_id) AS covered, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM frontier GROUP BY conv_id""",
    "t3_models": "SELECT DISTINCT 'm' || p_partkey % 57 AS model FROM part",
    "t4_newest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "u4_frontiers_differ": f"{L.STACK} SELECT DISTINCT conv_id FROM entries WHERE conv_id % 5 = 0 OR conv_id % 7 = 0",
    "u5_splice": f"{_RUNS} SELECT conv_id, 1 AS level, start_id, end_id FROM r WHERE rn // 2 >= k OR conv_id % 2 = 1 UNION ALL SELECT conv_id, 2, min(start_id), max(end_id) FROM r WHERE rn // 2 < k AND conv_id % 2 = 0 GROUP BY conv_id, rn // 2",
    "f4_history": f"{L.STACK} SELECT conv_id, 'Earlier history:' || chr(10) || string_agg({_BLOCK}, chr(10) ORDER BY start_id) AS history FROM entries WHERE text <> '' GROUP BY conv_id",
    "f6_tagged_blocks": "SELECT page_id, len(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>.*?</p\\s*>')) AS blocks FROM pages",
    "a14_token_breakdown": f"""WITH r AS (SELECT event_id AS record_id, event_id % 4 AS k, event_id % 900 AS raw, event_id % 71 AS summary, event_id % 53 AS ch, user_id % 47 AS wi, event_id % 29 AS ex, event_id % 31 AS an, user_id % 37 AS ins,
        CASE WHEN event_id % 5 > 0 THEN event_id % 300 ELSE 0 END AS story, CASE WHEN event_id % 5 > 0 THEN event_id % 500 ELSE 0 END AS chat, greatest(event_id % 61 - 5, 0) AS os, event_id % 23 AS oe, event_id % 700 AS oc FROM events),
      f AS (SELECT *, CASE WHEN k = 0 AND record_id % 800 > 0 THEN 'c' WHEN k >= 2 AND (story > 0 OR chat > 0) THEN 't' ELSE 'p' END AS form FROM r),
      a AS (SELECT *, CASE WHEN form = 'c' THEN record_id % 800 ELSE raw END AS total, CASE form WHEN 'c' THEN [os, oe, oc] WHEN 't' THEN [story, ex, chat] ELSE [ins, ch, wi, ex, summary, an] END AS t1 FROM f),
      b AS (SELECT *, {_shares('t1', 'total')} AS o FROM a WHERE total > 0),
      c AS (SELECT *, greatest(total - list_sum(o), 0) AS spare, CASE form WHEN 'c' THEN [0, ch, wi] WHEN 't' THEN [ins, ch, wi] ELSE [0] END AS t2, [summary, an] AS t3 FROM b),
      d AS (SELECT *, CASE form WHEN 'c' THEN spare WHEN 't' THEN o[1] ELSE 0 END AS b2, CASE form WHEN 'p' THEN 0 ELSE o[3] END AS b3 FROM c),
      e AS (SELECT *, {_shares('t2', 'b2')} AS i2, {_shares('t3', 'b3')} AS i3 FROM d),
      g AS (SELECT *, CASE form WHEN 'p' THEN 0 ELSE greatest(o[3] - list_sum(i3), 0) END AS ctx FROM e)
      SELECT record_id, total, (CASE form WHEN 'c' THEN o[1] WHEN 't' THEN i2[1] ELSE o[1] END)::BIGINT AS system, (CASE form WHEN 'p' THEN o[2] ELSE i2[2] END)::BIGINT AS character, (CASE form WHEN 'p' THEN o[3] ELSE i2[3] END)::BIGINT AS world_info,
        (CASE form WHEN 'p' THEN o[4] ELSE o[2] END)::BIGINT AS examples, ctx::BIGINT AS recent_context, (CASE form WHEN 'p' THEN o[5] ELSE i3[1] END)::BIGINT AS summary,
        (CASE form WHEN 'c' THEN spare - list_sum(i2) + i3[2] WHEN 't' THEN i3[2] ELSE o[6] END)::BIGINT AS other, (CASE form WHEN 'c' THEN 0 WHEN 't' THEN spare + o[1] - list_sum(i2) ELSE spare END)::BIGINT AS unclassified,
        CASE WHEN form <> 'p' THEN ctx::BIGINT END AS context_tokens, form <> 'p' AS detailed, form = 'c' AS measured FROM g""",
    "f10_input_tokens": "SELECT event_id, CASE event_id % 10 WHEN 1 THEN event_id + 1 WHEN 3 THEN event_id + 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE event_id END AS tokens FROM events",
    "f9_stored_metadata": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'main' ELSE 'openai-compatible' END AS provider, event_id % 10 - 1 AS requested_max_tokens, user_id // 2 AS response_characters, CASE WHEN event_id % 7 >= 3 THEN event_id % 7 - 3 END AS prompt_tokens,
      event_id % 9 AS completion_tokens, NULL::BIGINT AS reasoning_tokens, event_id % 5 AS total_tokens, CASE WHEN event_id % 3 <> 0 THEN 'stop' END AS finish_reason, CASE WHEN event_id % 2 = 0 THEN 'main' END AS fallback_from, 's' AS source, CASE WHEN event_id % 2 = 1 THEN 'm' END AS model
      FROM events WHERE event_id % 4 < 2 AND event_id % 10 > 0""",
    "f12_response_shape": """SELECT event_id, x.* EXCLUDE (k) FROM events JOIN (VALUES (0, 'object', 'choices,id', 'index,message', 'content,role', 'array', 'missing', 'missing', true), (1, 'object', 'choices,usage', 'finish_reason,text', '', 'missing', 'string', 'missing', true),
      (2, 'object', '[REDACTED]-k,content', '', '', 'missing', 'missing', 'string', false), (3, 'array', '', '', '', 'missing', 'missing', 'missing', false), (4, 'string', '', '', '', 'missing', 'missing', 'missing', false),
      (5, 'number', '', '', '', 'missing', 'missing', 'missing', false), (6, 'null', '', '', '', 'missing', 'missing', 'missing', false), (7, 'missing', '', '', '', 'missing', 'missing', 'missing', false),
      (8, 'object', 'choices', 'message', 'content,reasoning_content', 'null', 'missing', 'missing', true), (9, 'object', 'choices,content', '', '', 'missing', 'missing', 'object', false))
      x(k, response_type, root_fields, choice_fields, message_fields, content_type, text_type, root_content_type, has_reasoning) ON event_id % 10 = k""",
    "p15_stream_error": "SELECT event_id, event_id % 11 = 0 OR event_id % 9 IN (0, 1, 2, 4, 5) AS fault FROM events",
    "p5_earlier_phase": "SELECT doc_id, " + " OR ".join(f"regexp_matches(coalesce(text, ''), '{x}')" for x in (f"(?:{PAST[0]}).{{0,32}}(?:{PAST[1]})", f"(?:{PAST[1]}).{{0,32}}(?:{PAST[0]})", f"(?:{PAST[2]}).{{0,20}}(?:{PAST[3]})")) + " AS asks FROM documents",
    "x5_rollup_prompts": f"""{_RUNS} SELECT conv_id, 2 AS level, min(start_id) AS start_id, max(end_id) AS end_id, '[' || string_agg('{{"from":' || start_id || ',"to":' || end_id || ',"text":"' || text || '"}}', ',' ORDER BY start_id) || ']' AS prompt
      FROM r WHERE rn // 2 < k GROUP BY conv_id, rn // 2""",
    "x8_rebuild": f"""{L.STACK}, c AS (SELECT h.conv_id, h.chunk, h.start_id, h.conv_id % 6 = 0 AND h.chunk < 2 AS held, count(*) FILTER (WHERE NOT is_system AND h.conv_id % 5 > 0) > 0 AS made FROM hashed h JOIN m ON m.conv_id = h.conv_id AND m.message_id BETWEEN h.start_id AND h.end_id GROUP BY ALL),
      w AS (SELECT conv_id, bool_and(held OR made) AS whole FROM c GROUP BY conv_id)
      SELECT conv_id, start_id, CASE WHEN held THEN 'draft' ELSE 'new' END AS text, CASE WHEN whole THEN 'entry' ELSE 'draft' END AS kind FROM c JOIN w USING (conv_id) WHERE held OR made
      UNION ALL SELECT conv_id, start_id, CASE WHEN deleted THEN 'new' ELSE 'old' END, 'entry' FROM entries JOIN w USING (conv_id) WHERE NOT whole""",
    "x1_plan_ready": f"""WITH RECURSIVE tg AS ({L.SQL['w7_ready_target']}), {L.LOGS.replace('m AS (', 'm0 AS (')}, m AS (SELECT m0.* FROM m0 JOIN tg USING (conv_id) WHERE message_id <= target), {L.FLAGS}, {L.greedy_sql(L.TURNS, L.LIMIT, L.MARK)},
      q AS (SELECT p.conv_id, chunk, start_id, end_id, planned_end, count(*) FILTER (WHERE completes) AS done, sum(length(text)) AS chars, bool_or(name <> 'view' AND NOT is_system) AS seen FROM plan p JOIN f ON f.conv_id = p.conv_id AND f.message_id BETWEEN start_id AND end_id GROUP BY ALL),
      k AS (SELECT *, max(end_id) OVER (PARTITION BY conv_id) AS last_ FROM q),
      o AS (SELECT *, min(CASE WHEN NOT (done >= {L.TURNS} OR planned_end < last_ OR (end_id < planned_end AND seen) OR (done > 0 AND chars > {L.LIMIT})) THEN chunk END) OVER (PARTITION BY conv_id) AS stop FROM k)
      SELECT conv_id, chunk, start_id, end_id FROM o WHERE stop IS NULL OR chunk < stop""",
    "x2_chunk_prompts": f"""WITH {L.CONV}, {L.FLAGS}, {_CONV_CHUNKS}, t AS (SELECT *, {_TEXT} AS content FROM m WHERE NOT is_system)
      SELECT c.conv_id, chunk, '[' || string_agg('{{"id":' || message_id || ',"role":"' || CASE WHEN is_user THEN 'user' ELSE 'assistant' END || '","speaker":"' || name || '","content":' || to_json(content)::VARCHAR || '}}', ',' ORDER BY message_id) || ']' AS prompt
      FROM chunks c JOIN t ON t.conv_id = c.conv_id AND message_id BETWEEN start_id AND end_id WHERE content <> '' GROUP BY c.conv_id, chunk""",
    "f7_prompt_text": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'one ' || event_id WHEN 1 THEN 'two' || chr(10) || event_id WHEN 2 THEN 'three ' || event_id || chr(10) || 'four' WHEN 5 THEN 'a' || chr(10) || ' b ' || event_id ELSE '' END AS text FROM events""",
    "h3_substituted": "SELECT event_id, 'U and {{ user }}, {{other}}: ' || event_type AS text FROM events",
    "s7_guarded": f"{L.STACK} SELECT conv_id, start_id, conv_id % 4 = conv_id % 3 AS kept FROM entries",
    "s6_regular_reports": """SELECT user_id AS conv_id, event_id AS created_at, CASE WHEN event_id % 2 = 0 THEN 'swipe' ELSE 'normal' END AS kind, CASE WHEN event_id % 3 > 0 THEN event_id // 2 ELSE 0 END AS retained_start, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS retained_end,
      greatest(event_id % 7 - 3, 0) AS removed, greatest(floor(event_id % 9 - 4.5), 0)::BIGINT AS tokens_removed, 0::BIGINT AS tokens_injected, event_id AS tokens_saved, -1::BIGINT AS covered, event_id % 100 AS duration_ms, CASE WHEN event_id % 4 = 0 THEN 'a,b' ELSE '' END AS warnings FROM events WHERE event_id % 5 > 0""",
    "s6_regular_traces": """SELECT conv_id, pos, stage FROM (SELECT user_id AS conv_id, event_id AS pos, CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'summary' END AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k
      FROM events WHERE event_id % 11 > 0 AND event_id % 3 < 2) WHERE k <= 5""",
    "r6_still_valid": f"{L.STACK} SELECT conv_id, start_id FROM entries WHERE start_id % 3 <> 0 AND conv_id % 4 <> 0",
    "j11_preferred_snapshots": f"""WITH {L.LOGS}, g AS (SELECT conv_id, max(message_id) % 3 AS last_id, CASE WHEN conv_id % 3 = 0 THEN 'r1' END AS own, conv_id % 4 AS cur FROM m GROUP BY conv_id),
      s AS (SELECT m.conv_id, message_id AS id, CASE WHEN name <> 'click' THEN 'r' || message_id % 5 END AS run, message_id % 3 AS e, message_id % 4 AS q, message_id * 7 % 11 AS c, g.* EXCLUDE (conv_id) FROM m JOIN g USING (conv_id)),
      st AS (SELECT conv_id, q, id FROM s WHERE run IS NULL AND e = last_id QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY q DESC, c DESC, id DESC) = 1),
      ow AS (SELECT conv_id, q, id FROM s WHERE run = own QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, q DESC, id DESC) = 1),
      la AS (SELECT conv_id, id FROM s WHERE run IS NOT NULL AND e = last_id AND q = cur QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY c DESC, id DESC) = 1),
      x AS (SELECT g.conv_id, coalesce(CASE WHEN own IS NOT NULL THEN CASE WHEN NOT coalesce(st.q > ow.q, false) THEN ow.id END ELSE la.id END, CASE WHEN st.q = cur THEN st.id END) AS snapshot_id FROM g LEFT JOIN st USING (conv_id) LEFT JOIN ow USING (conv_id) LEFT JOIN la USING (conv_id))
      SELECT * FROM x WHERE snapshot_id IS NOT NULL""",
    "x7_inspections": f"""{L.STACK}, {L.window_sql('turns', L.SIZE)}, e AS (SELECT * FROM entries WHERE least(chunk, 9) < 5), cov AS (SELECT conv_id, max(end_id) AS covered FROM e GROUP BY conv_id),
      st AS (SELECT conv_id, least(retained_start, greatest(0, coalesce(covered + 1, 0))) AS start FROM win LEFT JOIN cov USING (conv_id)), {L._ALIGN}, {L.PHASE_SQL},
      g AS (SELECT m.conv_id, count(*) AS removed, sum(ceil(length(text) / 4.0))::BIGINT AS tokens_removed FROM m JOIN aligned USING (conv_id) WHERE message_id < aligned AND NOT is_system GROUP BY m.conv_id),
      ca AS (SELECT e.* FROM e LEFT JOIN phase USING (conv_id) LEFT JOIN cur USING (conv_id) WHERE NOT deleted AND (phase_start IS NULL OR coalesce(current_input % 2 = 0, false) OR start_id >= phase_start)),
      h AS (SELECT conv_id, count(*) AS n, ceil(length(string_agg({_BLOCK}, chr(10) ORDER BY start_id)) / 4.0)::BIGINT AS tokens FROM ca GROUP BY conv_id), lv AS (SELECT conv_id, count(*) AS n FROM e WHERE NOT deleted GROUP BY conv_id), hd AS (SELECT conv_id, count(*) AS held FROM e GROUP BY conv_id),
      x AS (SELECT a.conv_id, 'normal' AS kind, aligned AS safe_start, current_input AS retained_end, coalesce(removed, 0) AS removed, coalesce(tokens_removed, 0) AS tokens_removed, CASE WHEN aligned > 0 THEN coalesce(h.n, 0) ELSE 0 END AS entries_carried,
        CASE WHEN aligned > 0 THEN coalesce(lv.n, 0) - coalesce(h.n, 0) ELSE 0 END AS entries_left, CASE WHEN aligned > 0 THEN coalesce(tokens, 0) ELSE 0 END AS tokens_injected, coalesce(covered, -1) AS covered, CASE WHEN held > 4 THEN 'rollup_due' ELSE '' END AS warnings
        FROM aligned a JOIN cur USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN lv USING (conv_id) LEFT JOIN cov USING (conv_id) LEFT JOIN hd USING (conv_id))
      SELECT *, greatest(tokens_removed - tokens_injected, 0) AS tokens_saved FROM x""",
    "f11_response_text": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'c' || event_id WHEN 3 THEN 'd' || event_id WHEN 4 THEN '[' || event_id || ']' END AS response FROM events",
    "f16_generation_signature": "SELECT DISTINCT conv_id, sha256('{\"id\":' || conv_id || ',\"tokens\":3000,\"model\":\"default\"}') AS signature FROM conversations",
    "s4_valid_provenance": f"""{L.STACK}, p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY start_id) - 1) // 3 AS run FROM entries), q AS (SELECT * FROM p WHERE conv_id % 4 <> 0 OR start_id % 5 <> 0),
      g AS (SELECT *, lag(end_id) OVER (PARTITION BY conv_id, run ORDER BY start_id) AS before FROM q)
      SELECT conv_id, run, CASE WHEN count(*) >= 2 AND bool_and(before IS NULL OR before + 1 = start_id) THEN count(*) ELSE -1 END AS sources FROM g GROUP BY conv_id, run""",
    "s5_whole_checkpoints": f"""WITH {L.LOGS}, {L.FLAGS}, {L.CHUNKS_SQL}, n AS (SELECT conv_id, max(chunk) AS top FROM chunks GROUP BY conv_id)
      SELECT conv_id, chunk AS seq FROM chunks JOIN n USING (conv_id) WHERE NOT (conv_id % 3 = 0 AND top >= 3) AND NOT (conv_id % 5 = 0 AND top >= 3) AND (conv_id % 5 <> 0 OR chunk <> 2)""",
    "s14_recent_errors": "SELECT user_id, event_id, replace(replace(props, 'a', '[REDACTED]'), '1', '[REDACTED]') AS props FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3",
    "x3_summarise": f"""WITH {L.CONV}, {L.FLAGS}, {_CONV_CHUNKS}, v AS (SELECT c.conv_id, c.start_id, c.end_id, message_id, substring(regexp_replace({_TEXT}, CASE WHEN is_user THEN '$^' ELSE '\\n{{3,}}' END, chr(10) || chr(10), 'g'), 1, 40) AS t
        FROM chunks c JOIN m ON m.conv_id = c.conv_id AND message_id BETWEEN c.start_id AND c.end_id WHERE NOT is_system AND {_TEXT} <> '')
      SELECT conv_id, start_id, end_id, regexp_replace(string_agg(t, chr(10) ORDER BY message_id), '^[\\s]+|[\\s]+$', '', 'g') AS text FROM v GROUP BY ALL""",
}
