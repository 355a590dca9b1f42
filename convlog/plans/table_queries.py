"""Queries over entries, dictionaries, usage logs and records, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlog.functions import text as X
from convlog.operators import context, frontier, lorebook, tokens, turns, usage
from convlog.plans import log_queries as L
from convlog.sources.messages import from_conversations, from_events


def _events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _lock(e: DataFrame) -> DataFrame:
    return e.withColumn("updated_at", F.concat(F.lit("v"), F.col("start_id").cast("string"))).withColumn("manually_edited", F.lit(False))


def j9_apply_edits(spark, d):
    e = _lock(L._entries(spark, d))
    edits = e.filter("start_id % 3 = 0").select("conv_id", "level", "start_id", "end_id", F.when(F.col("conv_id") % 2 == 0, F.col("updated_at")).otherwise(F.lit("old")).alias("updated_at"), F.lit("new").alias("new_text"))
    return frontier.apply_edits(e, edits)[0].select("conv_id", "start_id", "text", "manually_edited")


def j9_rejected_edits(spark, d):
    e = _lock(L._entries(spark, d))
    edits = e.filter("start_id % 3 = 0").select("conv_id", "level", "start_id", "end_id", F.when(F.col("conv_id") % 2 == 0, F.col("updated_at")).otherwise(F.lit("old")).alias("updated_at"), F.lit("new").alias("new_text"))
    return frontier.apply_edits(e, edits)[1].select("conv_id", "start_id")


def p17_apply_deletes(spark, d):
    e = _lock(L._entries(spark, d))
    last = F.max("start_id").over(Window.partitionBy("conv_id"))
    gone = e.withColumn("last", last).filter("(start_id = last and conv_id % 2 = 0) or start_id = 0").select(*frontier.LOCK)
    return frontier.apply_deletes(e, gone).select("conv_id", "start_id", "deleted", "text")


def j4_latest_record(spark, d):
    m = from_events(spark, d)
    records = m.filter("name = 'click'").select("conv_id", (F.col("message_id") + F.col("message_id") % 5).alias("mes_id"), F.col("message_id").alias("pos"))
    logs = m.groupBy("conv_id").agg((F.max("message_id") - 3).alias("last_id"))
    return frontier.latest_record(records, logs)


def j5_latest_within(spark, d):
    t = _events(spark, d)
    left = t.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    right = t.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("captured"))
    return frontier.latest_within(left, right, "user_id", 43_200).select("user_id", "id", "other")


def s8_branch(spark, d):
    e = L._entries(spark, d)
    b = e.select("conv_id").distinct().filter("conv_id % 10 = 3").select("conv_id", (F.col("conv_id") + 1_000_000).alias("new_id"), F.lit(20).alias("upto"))
    return frontier.branch(e, b).select("conv_id", "start_id", "end_id", "text")


def s9_renamed(spark, d):
    e = L._entries(spark, d).withColumn("owner", F.col("conv_id") % 4)
    names = e.select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("owner"), (F.col("conv_id") + 500_000).alias("new_id"))
    return frontier.renamed(e, names).select("conv_id", "start_id", "owner")


def t1_page(spark, d):
    return frontier.page(L._entries(spark, d), 2, 3).select("conv_id", "start_id", "end_id")


def s2_normalised_state(spark, d):
    """State documents made of each user's events; a range that ends early and a blank text make some of them invalid."""
    m = from_events(spark, d)
    e = L._plan(spark, d)
    odd = F.when((F.col("chunk") == 4) & (F.col("conv_id") % 3 == 0), F.col("start_id") + 1).otherwise(F.col("start_id"))
    one = F.to_json(F.struct((F.col("chunk") % 40).alias("level"), (odd + 0.5).alias("start"), F.col("end_id").alias("end"), F.when((F.col("chunk") == 5) & (F.col("conv_id") % 4 == 0), F.lit("  ")).otherwise(F.lit(" t ")).alias("text"), (F.col("chunk") == 1).alias("deleted")))
    docs = e.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", one.alias("j")))).alias("a"))
    state = docs.select("conv_id", F.concat(F.lit('{"entries":['), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]}")).alias("state"))
    del m
    return frontier.normalised(state)


def p2_visible_text(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return t.select("page_id", X.visible_text(F.col("html"), F.lit(False)).alias("text"))


def p3_summary_text(spark, d):
    m = from_conversations(spark, d)
    raw = F.concat(F.lit("```text\n<log_summary>\n"), "text", F.lit("\n</log_summary>\n```"))
    return m.select("conv_id", "message_id", X.summary_text(raw).alias("summary"))


def p4_phase_boundary(spark, d):
    """Sentences of documents that name a small word, unless it comes after another in the same sentence."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", X.phase_boundary(F.coalesce("text", F.lit("")), ["of that", "to the", "on the"], r"\bfor\b", r"\bwas\b.{0,20}\bthe\b", ".!?\n").alias("boundary"))


REASONS = [" Max-Tokens ", "LENGTH", "max token", "max_output_tokens", "Token Limit", "output-token-limit", "model_length", "incomplete", "stop", "lengthy", "max_", None]


def p6_truncated(spark, d):
    t = _events(spark, d)
    reason = F.get(F.array(*map(F.lit, REASONS)), (F.col("event_id") % len(REASONS)).cast("int"))
    return t.select("event_id", X.truncated(reason, F.col("user_id") % 2 == 0).alias("truncated"))


def p7_search(spark, d):
    e = L._entries(spark, d).filter("not deleted")
    hay = F.lower(F.concat_ws("\n", F.concat(F.lit("L"), F.col("level").cast("string")), F.concat(F.col("start_id").cast("string"), F.lit("-"), F.col("end_id").cast("string")), "source_hash", "text"))
    return e.filter(hay.contains("ab1")).select("conv_id", "start_id")


def f3_summary_block(spark, d):
    e = L._entries(spark, d)
    return e.select("conv_id", "start_id", X.summary_block(F.col("text"), F.col("start_id"), F.col("end_id"), F.col("level")).alias("block"))


def f5_escaped(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return t.select("page_id", X.escaped(F.col("html")).alias("text"))


def f14_bounded_error(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    return t.select("page_id", X.bounded_error(F.col("html")).alias("error"), X.redacted(F.col("url"), ["example", "http"]).alias("url"))


def u1_trimmed_distinct(spark, d):
    m = from_conversations(spark, d)
    return m.select("conv_id", "message_id", F.array_join(X.trimmed_distinct(F.split("text", "[.,]")), "|").alias("parts"))


def u2_merge_by_id(spark, d):
    t = _events(spark, d).withColumn("pos", F.col("event_id"))
    one = t.filter("event_type in ('view', 'click')").select("user_id", (F.col("event_id") % 40).alias("id"), "pos", F.col("event_type").alias("value"))
    two = t.filter("event_type in ('purchase', 'error')").select("user_id", (F.col("event_id") % 40).alias("id"), "pos", F.col("event_type").alias("value"))
    return usage.merge_by_id(one, two, "user_id", "id", 10)


def w16_keep_latest(spark, d):
    return usage.keep_latest(_events(spark, d), "user_id", "event_id", 5).select("user_id", "event_id", "event_type")


def a12_allocate(spark, d):
    t = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("tokens"))
    seeds = t.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type"))).withColumn("budget", F.col("user_id") % 90)
    return tokens.allocate(seeds, ["user_id"]).select("user_id", "event_type", "share")


def a17_percentages(spark, d):
    t = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("share"))
    return tokens.percentages(t, ["user_id"]).select("user_id", "event_type", "share", F.round("percent", 6).alias("percent"))


def a7_run_metrics(spark, d):
    t = _events(spark, d)
    a = t.select(
        F.col("user_id").alias("conv_id"), F.when(F.col("event_type") == "purchase", "rollup").otherwise("summary").alias("task"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        (F.col("event_id") % 977).alias("duration_ms"), (F.col("event_id") % 7).alias("messages"),
    )
    return usage.run_metrics(a)


def _payload():
    v = F.col("event_id")
    one = F.concat(F.lit('{"usage":{"prompt_tokens":'), (v % 900).cast("string"), F.lit(',"completion_tokens":"'), (v % 70).cast("string"), F.lit('","completion_tokens_details":{"reasoning_tokens":'), (v % 9).cast("string"), F.lit('}},"choices":[{"finish_reason":" stop "}]}'))
    two = F.concat(F.lit('{"usage":{"input_tokens":-1},"usageMetadata":{"promptTokenCount":'), (v % 800).cast("string"), F.lit('.7,"totalTokenCount":'), (v % 5000).cast("string"), F.lit('},"stop_reason":"max_tokens"}'))
    three = F.concat(F.lit('{"usage":{"prompt_tokens":true,"input_tokens":" '), (v % 300).cast("string"), F.lit(' ","completion_tokens":"","output_tokens":"1e2"},"finish_reason":5,"stop_reason":"x","model":" m "}'))
    return F.when(v % 3 == 0, one).when(v % 3 == 1, two).when(v % 6 == 2, three).otherwise(F.lit("not json"))


def f8_completion_metadata(spark, d):
    t = _events(spark, d).select("event_id", _payload().alias("payload"), F.col("props").alias("response"))
    return usage.completion_metadata(t).drop("payload", "response")


SAID = ["call failed: HTTP {}", "status={}", "(HTTP{})", "HTTP {}0", "xhttp: {}", "Status : {}, giving up", "code {}"]


def p14_retriable(spark, d):
    t = _events(spark, d)
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID)).cast("int"))
    return t.select("event_id", usage.retriable(F.col("event_id") % 600, F.replace(said, F.lit("{}"), (F.col("event_id") % 40 + 490).cast("string"))).alias("retriable"))


def s12_stream_events(spark, d):
    m = from_conversations(spark, d)
    piece = F.concat(F.lit(": note\ndata: {\"n\":"), F.col("message_id").cast("string"), F.lit("}\ndata: x\n\nevent: end\ndata: "), "name", F.lit("\n\n"))
    return usage.stream_events(m.select("conv_id", F.col("message_id").alias("seq"), piece.alias("piece")))


ENDS = ["data: [DONE]", 'data: {"type":"response.completed","response":{"usage":{"output_tokens":9}}}', "event: message-end\ndata: {}", 'data: {"done":true}', 'data: {"delta":{"stop_reason":" end_turn "}}', 'data: {"candidates":[{"finishReason":"STOP"}]}', 'data: {"done":false}', ""]


def stream_pieces(m: DataFrame) -> DataFrame:
    """conv_id, seq, piece: a stream a conversation, in some with a fault, ended in several ways or not at all."""
    last = F.max("message_id").over(Window.partitionBy("conv_id"))
    fault = F.when(F.col("conv_id") % 11 == 3, 'data: {"error":null}\n\n').when(F.col("conv_id") % 13 == 5, "data: {oops\n\n").otherwise("")
    opening = F.when(F.col("message_id") == 0, F.concat(F.lit('data: {"message":{"model":"m","usage":{"input_tokens":30}}}\n\n'), fault)).otherwise("")
    late = F.lit('data: {"usage":{"prompt_tokens":99},"choices":[{"delta":{"content":"late"}}]}\n\n')  # behind an end it doesn't count
    body = F.concat(F.lit('data: {"usage":{"prompt_tokens":'), (F.col("message_id") * 3 % 7).cast("string"), F.lit('},"choices":[{"delta":{"content":"'), F.col("name"), F.lit('"}}]}\n\n'))
    end = F.when(F.col("message_id") == last, F.concat(F.get(F.array(*map(F.lit, ENDS)), (F.col("conv_id") % len(ENDS)).cast("int")), F.lit("\n\n"), F.when(F.col("conv_id") % 8 < 4, late).otherwise(""))).otherwise("")
    return m.select("conv_id", F.col("message_id").alias("seq"), F.concat(opening, body, end).alias("piece"))


def a19_stream_completion(spark, d):
    return usage.stream_completion(usage.stream_events(stream_pieces(from_conversations(spark, d))))


def _book(spark, d) -> DataFrame:
    """A dictionary of the benchmark's items; some of them twice, with other keys or as constants."""
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    words = F.split(F.regexp_replace("text", r"[^A-Za-z ]", ""), " +")
    none = F.array().cast("array<string>")
    uid = F.col("item_id")
    book = b.select(
        uid.alias("uid"), F.lit("w").alias("world"), F.lit(None).cast("string").alias("comment"), F.col("text").alias("content"),
        F.when(uid % 6 == 0, F.array(F.lit("/(?<x>licen[sc]e)d? /i"))).when(uid % 6 == 1, F.array(F.get(words, 1))).otherwise(F.array(F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, 4, 2), " "))).alias("key"),
        F.when(uid % 3 == 0, F.array(F.get(words, 1), F.get(words, 2))).otherwise(none).alias("keysecondary"), (uid % 2 == 0).alias("selective"),
        (uid % 4).cast("int").alias("selectiveLogic"), (uid % 19 == 0).alias("constant"), (uid % 4 == 0).alias("caseSensitive"), (uid % 5 < 2).alias("matchWholeWords"), (uid % 17 == 1).alias("disable"), none.alias("decorators"), none.alias("triggers"),
        F.when(uid % 7 == 3, F.array(F.lit("en"))).otherwise(none).alias("only_names"), F.when(uid % 7 == 5, F.array(F.lit("latin"))).otherwise(none).alias("only_tags"), (uid % 2 == 1).alias("exclude"),
    )
    again = book.filter("uid % 5 = 0").withColumn("key", F.array(F.get(F.split(F.regexp_replace("content", r"[^A-Za-z ]", ""), " +"), 4))).withColumn("constant", F.col("constant") | (F.col("uid") % 10 == 0))
    return book.withColumn("pos", 2 * F.col("uid")).unionByName(again.withColumn("pos", 2 * F.col("uid") + 1))


def p9_available(spark, d):
    return lorebook.available(_book(spark, d)).select("uid").distinct()


def _matched(spark, d) -> DataFrame:
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text", F.array("lang").alias("names"))
    tags = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("name"), F.lit("latin").alias("tag")).filter("name in ('en', 'de')").distinct()
    return lorebook.match(texts, lorebook.available(_book(spark, d)), 2, tags)


def x13_match_lorebook(spark, d):
    return _matched(spark, d).select("text_id", "uid", "place", "constant", F.array_join("matched_keys", "|").alias("matched_keys"), "truncated")


def x13_references(spark, d):
    r = lorebook.references(_matched(spark, d), lorebook.available(_book(spark, d)), 400)
    return r.select("text_id", F.length("text").cast("long").alias("chars"), "tokens", "constant_chars", "matched_chars", "n_entries", "truncated")


def w19_budgeted(spark, d):
    e = L._entries(spark, d)
    blocks = e.select(F.col("conv_id").alias("text_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("start_id")).alias("place"), (F.length("text") + F.col("start_id") % 11).alias("chars"))
    return lorebook.budgeted(blocks, 60)


def x7_assembled_context(spark, d):
    """Entries of the first chunks; phases begin at some rows, and every other input asks for an earlier one."""
    m = from_events(spark, d)
    boundary = (F.col("name") == "click") & (F.col("message_id") % 9 == 4)
    return context.assembled(m, L._first_entries(spark, d), L.SIZE, boundary, F.col("message_id") % 2 == 0)


QUERIES = {f.__name__: f for f in (
    j9_apply_edits, j9_rejected_edits, p17_apply_deletes, j4_latest_record, j5_latest_within, s8_branch, s9_renamed, t1_page, s2_normalised_state, p2_visible_text, p3_summary_text, p4_phase_boundary,
    p6_truncated, p7_search, f3_summary_block, f5_escaped, f14_bounded_error, u1_trimmed_distinct, u2_merge_by_id, w16_keep_latest, a12_allocate, a17_percentages, a7_run_metrics,
    f8_completion_metadata, p14_retriable, s12_stream_events, a19_stream_completion, p9_available, x13_match_lorebook, x13_references, w19_budgeted, x7_assembled_context,
)}

_K = f"{L.STACK}, k AS (SELECT *, max(start_id) OVER (PARTITION BY conv_id) AS last_ FROM entries)"
_TRIM = "regexp_replace({0}, '^[\\s\\x{{00A0}}\\x{{FEFF}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}\\x{{3000}}]+$', '', 'g')"


# a dictionary against all texts, without any index
_FOUND_SQL = r"""WITH w AS (SELECT item_id AS uid, text AS content, string_split_regex(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +') AS words FROM benchmark WHERE item_id % 17 <> 1 AND trim(text) <> ''),
      copies AS (SELECT *, 0 AS again FROM w UNION ALL SELECT *, 1 FROM w WHERE uid % 5 = 0),
      book AS (SELECT uid, again, content, uid % 19 = 0 OR (again = 1 AND uid % 10 = 0) AS constant, uid % 4 = 0 AS cased, uid % 5 < 2 AS whole, uid % 2 = 0 AS selective, uid % 4 AS logic, uid % 2 = 1 AS exclude, uid % 7 AS f,
        CASE WHEN again = 1 THEN [words[5]] WHEN uid % 6 = 0 THEN ['/(?<x>licen[sc]e)d? /i'] WHEN uid % 6 = 1 THEN [words[2]] ELSE [array_to_string(words[1:3], ' '), array_to_string(words[4:5], ' ')] END AS keys, CASE WHEN uid % 3 = 0 THEN [words[2], words[3]] ELSE [] END AS seconds FROM copies),
      k AS (SELECT uid, again, cased, whole, true AS first_, unnest(keys) AS raw, generate_subscripts(keys, 1) AS no FROM book WHERE NOT constant UNION ALL SELECT uid, again, cased, whole, false, unnest(seconds), generate_subscripts(seconds, 1) FROM book WHERE NOT constant),
      t AS (SELECT doc_id AS text_id, text, lower(text) AS low, lang FROM documents),
      h AS (SELECT text_id, uid, again, first_, no, raw FROM t, k WHERE raw <> '' AND CASE WHEN raw LIKE '/%' THEN regexp_matches(text, 'licen[sc]e', 'i') AND regexp_matches(text, 'licen[sc]ed? ', 'i')
        WHEN NOT contains(CASE WHEN cased THEN text ELSE low END, CASE WHEN cased THEN raw ELSE lower(raw) END) THEN false WHEN NOT whole OR contains(raw, ' ') THEN true
        ELSE regexp_matches(CASE WHEN cased THEN text ELSE low END, '(?:^|[^\p{L}\p{N}_])' || CASE WHEN cased THEN raw ELSE lower(raw) END || '(?:$|[^\p{L}\p{N}_])') END),
      c AS (SELECT text_id, uid, again, count(*) FILTER (WHERE first_) AS one, count(*) FILTER (WHERE NOT first_) AS two, string_agg(raw, '|' ORDER BY no) FILTER (WHERE first_) AS matched_keys FROM h GROUP BY text_id, uid, again),
      s AS (SELECT text_id, uid, again, false AS constant, matched_keys FROM c JOIN book USING (uid, again) WHERE one > 0 AND (NOT selective OR len(seconds) = 0 OR CASE logic WHEN 1 THEN two < len(seconds) WHEN 2 THEN two = 0 WHEN 3 THEN two = len(seconds) ELSE two > 0 END)
        UNION ALL SELECT text_id, uid, again, true, '' FROM t, book WHERE constant),
      p0 AS (SELECT s.* FROM s JOIN book USING (uid, again) JOIN t USING (text_id) WHERE CASE f WHEN 3 THEN coalesce(lang = 'en', false) <> exclude WHEN 5 THEN coalesce(lang IN ('en', 'de'), false) <> exclude ELSE true END),
      p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id, uid ORDER BY constant DESC, again) AS nth FROM p0) WHERE nth = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY text_id, constant ORDER BY uid) AS rn, count(*) OVER (PARTITION BY text_id, constant) AS n FROM p),
      placed AS (SELECT text_id, uid, constant, matched_keys, row_number() OVER (PARTITION BY text_id ORDER BY constant DESC, uid) AS place, bool_or(NOT constant AND n > 2) OVER (PARTITION BY text_id) AS truncated FROM r WHERE constant OR rn <= 2)"""


def _paired(tag: str) -> str:
    return f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>"


def _visible_sql() -> str:
    c = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in X.HIDDEN:
        c = f"regexp_replace({c}, '{_paired(tag)}', ' ', 'g')"
    bodies = [f"list_filter(list_transform(regexp_extract_all(c, '{_paired(t)}', 1), lambda x: {_TRIM.format('x')}), lambda x: x <> '')" for t in X.WRAPPERS]
    picks = ", ".join(f"CASE WHEN len({b}) > 0 THEN array_to_string({b}, chr(10) || chr(10)) END" for b in bodies)
    body = f"regexp_replace(coalesce({picks}, c), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, {_TRIM.format(body)} AS text FROM (SELECT page_id, {c} AS c FROM pages)"


SQL = {
    "j9_apply_edits": f"{L.STACK} SELECT conv_id, start_id, CASE WHEN hit THEN 'new' ELSE text END AS text, hit AS manually_edited FROM (SELECT *, start_id % 3 = 0 AND conv_id % 2 = 0 AND NOT deleted AS hit FROM entries)",
    "j9_rejected_edits": f"{L.STACK} SELECT conv_id, start_id FROM entries WHERE start_id % 3 = 0 AND (conv_id % 2 = 1 OR deleted)",
    "p17_apply_deletes": f"""{_K} SELECT conv_id, start_id, deleted OR start_id = 0 AS deleted, CASE WHEN start_id = 0 THEN '' ELSE text END AS text FROM k
      WHERE deleted OR NOT (start_id = last_ AND (conv_id % 2 = 0 OR start_id = 0))""",
    "j4_latest_record": f"""WITH {L.LOGS}, l AS (SELECT conv_id, max(message_id) - 3 AS last_id FROM m GROUP BY conv_id)
      SELECT m.conv_id, arg_max(message_id + message_id % 5, message_id) AS mes_id, max(message_id) AS pos FROM m JOIN l USING (conv_id) WHERE name = 'click' AND message_id + message_id % 5 <= last_id GROUP BY m.conv_id""",
    "j5_latest_within": """SELECT user_id, id, other FROM (SELECT a.user_id, a.event_id AS id, b.event_id AS other, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS k
      FROM events a JOIN events b ON a.user_id = b.user_id AND floor(epoch(a.ts)) - floor(epoch(b.ts)) BETWEEN 0 AND 43200 WHERE a.event_type = 'purchase' AND b.event_type = 'click') WHERE k = 1""",
    "s8_branch": f"{L.STACK} SELECT conv_id, start_id, end_id, text FROM entries UNION ALL SELECT conv_id + 1000000, start_id, end_id, text FROM entries WHERE conv_id % 10 = 3 AND end_id <= 20",
    "s9_renamed": f"{L.STACK} SELECT CASE WHEN conv_id % 4 = 1 THEN conv_id + 500000 ELSE conv_id END AS conv_id, start_id, conv_id % 4 AS owner FROM entries",
    "t1_page": f"""{L.STACK}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_id DESC) - 1 AS rn, ceil(count(*) OVER (PARTITION BY conv_id) / 3.0) AS pages FROM entries)
      SELECT conv_id, start_id, end_id FROM p WHERE rn // 3 = least(2, pages) - 1""",
    "s2_normalised_state": f"""WITH {L.LOGS}, {L.FLAGS}, {L.CHUNKS_SQL}, bad AS (SELECT conv_id, min(chunk) AS b FROM chunks WHERE (chunk = 4 AND conv_id % 3 = 0) OR (chunk = 5 AND conv_id % 4 = 0) GROUP BY conv_id)
      SELECT conv_id, chunk AS seq, least(greatest(chunk % 40, 1), 32) AS level, start_id, end_id, CASE WHEN chunk = 1 THEN '' ELSE 't' END AS text, chunk = 1 AS deleted FROM chunks LEFT JOIN bad USING (conv_id) WHERE b IS NULL OR chunk < b""",
    "p2_visible_text": _visible_sql(),
    "p3_summary_text": f"WITH {L.CONV} SELECT conv_id, message_id, nullif({_TRIM.format('text')}, '') AS summary FROM m",
    "p6_truncated": "SELECT event_id, event_id % 12 < 6 AND user_id % 2 = 1 AS truncated FROM events",
    "p4_phase_boundary": r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[.!?\n]')) AS sentence, generate_subscripts(string_split_regex(coalesce(text, ''), '[.!?\n]'), 1) AS k FROM documents),
      r AS (SELECT unnest(['of that', 'to the', 'on the']) AS rule),
      f AS (SELECT doc_id, rule, arg_min(substring(sentence, 1, strpos(sentence, rule) + length(rule) - 1), k) AS upto FROM s, r WHERE contains(sentence, rule) GROUP BY ALL)
      SELECT doc_id, coalesce(bool_or(NOT regexp_matches(upto, '\bfor\b') AND NOT regexp_matches(upto, '\bwas\b.{0,20}\bthe\b')), false) AS boundary FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "p7_search": f"{L.STACK} SELECT conv_id, start_id FROM entries WHERE NOT deleted AND contains('l1' || chr(10) || start_id || '-' || end_id || chr(10) || source_hash || chr(10) || text, 'ab1')",
    "f3_summary_block": f"{L.STACK} SELECT conv_id, start_id, CASE WHEN text = '' THEN '' ELSE '<log_summary>' || chr(10) || 'level L1' || chr(10) || 'messages ' || start_id || '-' || end_id || chr(10) || text || chr(10) || '</log_summary>' END AS block FROM entries",
    "f5_escaped": "SELECT page_id, " + _TRIM.format("regexp_replace(translate(html, '<>', '＜＞'), '\\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM pages",
    "f14_bounded_error": "SELECT page_id, substring(" + _TRIM.format("regexp_replace(html, '\\s+', ' ', 'g')") + ", 1, 500) AS error, replace(replace(url, 'example', '[REDACTED]'), 'http', '[REDACTED]') AS url FROM pages",
    "u1_trimmed_distinct": f"WITH {L.CONV}, p AS (SELECT conv_id, message_id, list_transform(string_split_regex(text, '[.,]'), lambda x: " + _TRIM.format("x") + f") AS l FROM m) SELECT conv_id, message_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS parts FROM p",
    "u2_merge_by_id": """WITH b AS (SELECT user_id, event_id % 40 AS id, event_id + CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1000000000 END AS at_, event_type AS value FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
      g AS (SELECT user_id, id, min(at_) AS at_, arg_max(value, at_) AS value FROM b GROUP BY user_id, id), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ DESC) AS r FROM g)
      SELECT user_id, id, value, row_number() OVER (PARTITION BY user_id ORDER BY at_) AS place FROM k WHERE r <= 10""",
    "w16_keep_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "a12_allocate": """WITH s AS (SELECT user_id, event_type, count(*) AS t, user_id % 90 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS idx FROM events GROUP BY user_id, event_type),
      x AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS total, t::DOUBLE * b / sum(t) OVER (PARTITION BY user_id) AS exact FROM s),
      y AS (SELECT *, floor(exact) AS low, exact - floor(exact) AS rest FROM x), z AS (SELECT *, b - sum(low) OVER (PARTITION BY user_id) AS left_, row_number() OVER (PARTITION BY user_id ORDER BY rest DESC, idx) AS place FROM y)
      SELECT user_id, event_type, (CASE WHEN b = 0 THEN 0 WHEN total <= b THEN t ELSE low + CASE WHEN place <= left_ THEN 1 ELSE 0 END END)::BIGINT AS share FROM z""",
    "a17_percentages": "SELECT user_id, event_type, count(*) AS share, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 6) AS percent FROM events GROUP BY user_id, event_type",
    "a7_run_metrics": """SELECT *, CASE WHEN summaries + rollups > 0 THEN floor(total_ms / (summaries + rollups)::DOUBLE + 0.5)::BIGINT ELSE 0 END AS average_ms FROM (
      SELECT user_id AS conv_id, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS summaries, count(*) FILTER (WHERE event_type = 'purchase') AS rollups, count(*) FILTER (WHERE event_type = 'error') AS failures,
      coalesce(sum(event_id % 977) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS total_ms, coalesce(sum(event_id % 7) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS messages FROM events GROUP BY user_id)""",
    "f8_completion_metadata": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 900 WHEN event_id % 3 = 1 THEN event_id % 800 WHEN event_id % 6 = 2 THEN event_id % 300 END AS prompt_tokens,
      CASE WHEN event_id % 3 = 0 THEN event_id % 70 WHEN event_id % 6 = 2 THEN 100 END AS completion_tokens, CASE WHEN event_id % 6 = 2 THEN 'm' END AS model,
      CASE event_id % 3 WHEN 0 THEN event_id % 9 END AS reasoning_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 900 + event_id % 70 WHEN event_id % 3 = 1 THEN event_id % 5000 WHEN event_id % 6 = 2 THEN event_id % 300 + 100 END AS total_tokens,
      CASE event_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'max_tokens' END AS finish_reason, length(props) AS response_characters FROM events""",
    "p14_retriable": "SELECT event_id, event_id % 600 IN (408, 502, 503, 504, 520, 521, 522, 523, 524) OR (event_id % 7 IN (0, 1, 2, 5) AND event_id % 40 + 490 IN (502, 503, 504, 520, 521, 522, 523, 524)) AS retriable FROM events",
    "s12_stream_events": f"""WITH {L.CONV} SELECT conv_id, (2 * message_id)::INT AS no, 'message' AS event, '{{"n":' || message_id || '}}' || chr(10) || 'x' AS data FROM m
      UNION ALL SELECT conv_id, (2 * message_id + 1)::INT, 'end', name FROM m""",
    "a19_stream_completion": f"""WITH {L.CONV} SELECT conv_id, string_agg(name, '' ORDER BY message_id) AS response, CASE conv_id % 8 WHEN 4 THEN 'end_turn' WHEN 5 THEN 'STOP' END AS finish_reason, 'm' AS model,
      max(message_id * 3 % 7) AS prompt_tokens, CASE conv_id % 8 WHEN 1 THEN 9 END::BIGINT AS completion_tokens FROM m WHERE conv_id % 8 < 6 AND conv_id % 11 <> 3 AND conv_id % 13 <> 5 GROUP BY conv_id""",
    "p9_available": "SELECT item_id AS uid FROM benchmark WHERE item_id % 17 <> 1 AND trim(text) <> ''",
    "x13_match_lorebook": f"{_FOUND_SQL} SELECT text_id, uid, place, constant, matched_keys, truncated FROM placed",
    "x13_references": f"""{_FOUND_SQL}, bl AS (SELECT text_id, constant, truncated, n, length('[entry ' || n || '|w#' || uid || '|' || CASE WHEN constant THEN 'constant' ELSE 'keys=' || replace(matched_keys, '|', ',') END || ']') + 1 + length(trim(content)) AS chars,
        '[entry ' || n || '|w#' || uid || '|' || CASE WHEN constant THEN 'constant' ELSE 'keys=' || replace(matched_keys, '|', ',') END || ']' || chr(10) || trim(content) AS block FROM (SELECT *, row_number() OVER (PARTITION BY text_id, constant ORDER BY place) AS n FROM placed) JOIN (SELECT uid, content FROM book WHERE again = 0) USING (uid)),
      us AS (SELECT *, sum(chars + CASE WHEN n > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY text_id, constant ORDER BY n) AS used FROM bl),
      sp AS (SELECT text_id, coalesce(max(used) FILTER (WHERE constant AND used <= 400), 0) AS spent FROM us GROUP BY text_id),
      kept AS (SELECT us.* FROM us JOIN sp USING (text_id) WHERE CASE WHEN constant THEN used <= 400 ELSE used <= 400 - spent END),
      agg AS (SELECT text_id, coalesce(max(used) FILTER (WHERE constant), 0) AS constant_chars, coalesce(max(used) FILTER (WHERE NOT constant), 0) AS matched_chars, count(*) AS n_entries FROM kept GROUP BY text_id),
      told AS (SELECT text_id, count(*) AS n_all, bool_or(truncated) AS over FROM bl GROUP BY text_id)
      SELECT text_id, chars::BIGINT AS chars, ceil(chars / 4.0)::BIGINT AS tokens, constant_chars::BIGINT AS constant_chars, matched_chars::BIGINT AS matched_chars, n_entries, over OR n_all > n_entries AS truncated FROM (
        SELECT text_id, over, n_all, coalesce(constant_chars, 0) AS constant_chars, coalesce(matched_chars, 0) AS matched_chars, coalesce(n_entries, 0) AS n_entries,
          coalesce(constant_chars + matched_chars + CASE WHEN constant_chars > 0 AND matched_chars > 0 THEN 2 ELSE 0 END, 0) AS chars FROM told LEFT JOIN agg USING (text_id))""",
    "w19_budgeted": f"""{L.STACK}, bl AS (SELECT conv_id AS text_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_id) AS place, length(text) + start_id % 11 AS chars FROM entries)
      SELECT * FROM (SELECT *, sum(chars + CASE WHEN place > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY place)::BIGINT AS used FROM bl) WHERE used <= 60""",
    "x7_assembled_context": f"""{L.STACK}, {L.window_sql('turns', L.SIZE)}, e AS (SELECT * FROM entries WHERE least(chunk, 9) < 5), cov AS (SELECT conv_id, max(end_id) AS covered FROM e GROUP BY conv_id),
      st AS (SELECT conv_id, least(retained_start, greatest(0, coalesce(covered + 1, 0))) AS start FROM win LEFT JOIN cov USING (conv_id)), {L._ALIGN}, {L.PHASE_SQL}
      SELECT m.conv_id, message_id::DOUBLE AS place, name, text FROM m JOIN aligned USING (conv_id) WHERE message_id >= aligned OR is_system UNION ALL
      SELECT e.conv_id, any_value(aligned) - 0.5::DOUBLE, 'history', string_agg('<log_summary>' || chr(10) || 'level L1' || chr(10) || 'messages ' || start_id || '-' || end_id || chr(10) || text || chr(10) || '</log_summary>', chr(10) ORDER BY start_id)
      FROM e JOIN aligned USING (conv_id) LEFT JOIN phase USING (conv_id) JOIN cur USING (conv_id) WHERE NOT deleted AND aligned > 0 AND (phase_start IS NULL OR current_input % 2 = 0 OR start_id >= phase_start) GROUP BY e.conv_id""",

}
