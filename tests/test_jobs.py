"""Jobs on hand-made rows: message lists, counters, single entries made anew, matches that are used once, streams."""

import random

from pyspark.sql import functions as F
from test_logs import SCHEMA

from convlog.operators import breakdown, frontier, jobs, lineage, tokens, usage


def test_message_breakdown(spark):
    summary = "<log_summary>older plot</log_summary>"
    messages = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(f"system rules\n{summary}").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("continue").alias("content"))))
    one = spark.range(1).select(F.lit("a").alias("record_id"), messages.alias("messages"), F.lit('[{"type":"function"}]').alias("tools"), F.lit(500).cast("long").alias("actual_tokens"))
    rows = one.unionByName(one.withColumns({"record_id": F.lit("b"), "actual_tokens": F.lit(None).cast("long")})).unionByName(one.withColumns({"record_id": F.lit("c"), "actual_tokens": F.lit(20).cast("long")}))
    rows = rows.unionByName(one.withColumns({"record_id": F.lit("d"), "messages": F.lit("no json"), "tools": F.lit(None).cast("string"), "actual_tokens": F.lit(None).cast("long")}))
    got = {r.record_id: r for r in breakdown.message_breakdown(rows, counter=len).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.total, a.summary, a.recent_context, a.system, a.other, a.measured) == (500, len(summary), len("continue"), len("system rules"), len('[{"type":"function"}]'), True)
    for r in got.values():
        assert r.system + r.recent_context + r.summary + r.other + r.unclassified == r.total
    assert a.unclassified > 0 and got["b"].unclassified == 0 and not got["b"].measured and got["c"].total == 20


def test_counted_tokens(spark):
    def counter(t):
        if t == "bad":
            raise ValueError
        return {"nan": float("nan"), "minus": -1}.get(t, len(t) + 0.5)

    rows = spark.createDataFrame([(k, t) for k, t in enumerate([None, " ", "abc", " abc", "bad", "nan", "minus"])], "k int, text string")
    got = [(r.tokens, r.estimated) for r in tokens.counted_tokens(rows, counter=counter).orderBy("k").collect()]
    assert got == [(0, False), (0, False), (4, False), (4, False), (1, True), (1, True), (2, True)]
    assert [(r.tokens, r.estimated) for r in tokens.counted_tokens(rows).orderBy("k").collect()][:3] == [(0, False), (0, False), (1, True)]


def test_usage_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for text, n in (('{"usage":null,"prompt_tokens":5}', 5), ('{"usage":"x","prompt_tokens":5}', 5), ('{"usage":{"prompt_tokens":" 7 "}}', 7), ('{"prompt_tokens":"1d"}', None), ("[5]", None)):
        assert one(usage.input_tokens(F.lit(text))) == n
    calls = spark.createDataFrame([('{"usage":{"prompt_tokens":true,"completion_tokens":2.7},"finish_reason":5,"stop_reason":"x","model":null}', "é😀", "m")], "payload string, response string, model string")
    r = usage.completion_metadata(calls).first()
    assert (r.prompt_tokens, r.completion_tokens, r.total_tokens, r.finish_reason, r.model, r.response_characters) == (None, 2, None, None, "m", 2)
    stored = usage.stored_metadata(spark.createDataFrame([("main", "8.5", 2.5, None, 1.9, -1.0, True, " a ", " ", "main", "x")], "provider string, requested_max_tokens string, response_characters double, prompt_tokens string, completion_tokens double, reasoning_tokens double, total_tokens boolean, source string, finish_reason string, fallback_from string, model string"))
    r = stored.first()
    assert (r.requested_max_tokens, r.response_characters, r.prompt_tokens, r.completion_tokens, r.reasoning_tokens, r.total_tokens, r.source, r.finish_reason, r.fallback_from, r.model) == (8, 2, None, 1, None, None, "a", None, "main", "x")


def events(spark, *streams):
    rows = [(c, n, e, d) for c, stream in enumerate(streams) for n, (e, d) in enumerate(stream)]
    return spark.createDataFrame(rows, "conv_id long, no int, event string, data string")


def test_streams(spark):
    said = '{"choices":[{"delta":{"content":"a"}}],"usage":{"prompt_tokens":3,"input_tokens":50,"d":{"x":1,"s":"t"}}}'
    m = "message"
    e = events(
        spark, [(m, said), (m, '{"usage":{"prompt_tokens":"4","d":{"x":0.5}}}'), (m, "[DONE]"), (m, said)], [(m, said)], [(m, said), (m, '{"error":null}'), (m, "[DONE]")], [(m, "{oops"), (m, "[DONE]")], [(m, said), (m, "[DONE]"), (m, "{oops")],
        [("message_stop", "{}"), (m, said)], [(m, '{"choices":[{"delta":{"content":" [API Error] x"}}]}'), (m, "[DONE]")], [(m, '{"finish_reason":"stop"}'), (m, said)], [(m, '{"done":"true"}')], [(m, "5"), (m, '{"done":true}')])
    got = {r.conv_id: (r.response, r.prompt_tokens) for r in usage.stream_completion(e).collect()}
    assert got == {0: ("a", 4), 4: ("a", 3), 5: ("", None), 7: ("a", 3), 9: ("", None)}
    maps = e.filter("conv_id = 0 and no < 2").select("conv_id", "no", F.lit("usage").alias("root"), F.expr("try_variant_get(try_parse_json(data), '$.usage', 'variant')").alias("map"))
    merged = {r.path: (r.number, r.text) for r in usage.merged_usage(maps).collect()}
    assert merged == {"prompt_tokens": (4.0, None), "input_tokens": (50.0, None), "d.x": (1.0, None), "d.s": (None, "t")}


def test_regenerate(spark):
    rows = spark.createDataFrame([(1, i, i % 2 == 0, False, "n", f"t{i}") for i in range(8)], SCHEMA)
    ranges = spark.createDataFrame([(1, 2 * k, 2 * k + 1) for k in range(4)], "conv_id long, start_id long, end_id long")
    first = lineage.range_hashes(rows, ranges).selectExpr("conv_id", "1 level", "start_id", "end_id", "'old' text", "source_hash", "false deleted", "'u' updated_at").orderBy("start_id")
    children = first.filter("start_id < 4").selectExpr("conv_id", "2 parent_level", "0L parent_start", "level", "start_id", "end_id", "source_hash", "text", "deleted")
    line = lineage.payload(*map(F.col, ("level", "start_id", "end_id", "source_hash", "text", "deleted")))
    digest = children.agg(F.sha2(lineage.ordered_text(line, F.col("start_id"), lineage.RECORD), 256).alias("h")).first().h
    parent = spark.createDataFrame([(1, 2, 0, 3, "old", digest, False, "u")], first.schema)
    entries = parent.unionByName(first.filter("start_id >= 4"))
    edited = rows.withColumn("text", F.when(F.col("message_id") == 7, "edited").otherwise(F.col("text")))
    ask = spark.createDataFrame([(1, 2, 0, 3, "u"), (1, 1, 4, 5, "u"), (1, 1, 6, 7, "u"), (1, 1, 4, 5, "stale")], "conv_id long, level int, start_id long, end_id long, updated_at string")
    results, refused = jobs.regenerate(ask, entries, edited, children)
    assert sorted((r.level, r.start_id, r.text) for r in results.collect()) == [(1, 4, "t4\nt5"), (2, 0, "old\nold")]
    assert sorted((r.start_id, r.updated_at, r.reason) for r in refused.collect()) == [(4, "stale", "changed"), (6, "u", "source")]
    results, refused = jobs.regenerate(ask.limit(1), entries, edited, children.withColumn("text", F.lit("other")))
    assert results.count() == 0 and [r.reason for r in refused.collect()] == ["children"]


def test_matched_once_like_a_loop(spark):
    rnd, rows, want = random.Random(9), [], []
    for c in range(60):
        pending, ready = None, False
        for n in range(rnd.randint(1, 25)):
            t, kind = 300 * n + rnd.randint(0, 200), rnd.choice("mcp")
            rows.append((c, kind, n, t))
            if kind == "c":
                pending = (n, t)
            elif kind == "p":
                ready = True
            else:
                if pending and ready and t - pending[1] <= 600:
                    want.append((c, n, pending[0]))
                pending, ready = None, False
    df = spark.createDataFrame(rows, "chat long, kind string, n long, t long").withColumn("at", F.timestamp_seconds("t"))
    of = lambda k: df.filter(F.col("kind") == k)
    got = frontier.matched_once(of("m").select("chat", F.col("n").alias("id"), "at"), of("c").select("chat", F.col("n").alias("other"), F.col("at").alias("captured")), "chat", 600, of("p").select("chat", "at"))
    assert sorted((r.chat, r.id, r.other) for r in got.collect()) == sorted(want) and want
