"""Queries of streams, typed changes and the jobs on message lists, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlog.operators import breakdown, chunks, frontier, jobs, lineage, migration, tokens, usage
from convlog.plans import job_queries as J
from convlog.plans import log_queries as L
from convlog.plans import table_queries as T
from convlog.sources.messages import from_conversations, from_events
from convlog.sources.records import latest_details
from convlog.store import shared_folder, stored
from convlog.streaming import assembly, refresh
from convlog.streaming.buckets import Buckets
from convlog.streaming.open_chunks import open_chunks, state_provider


def _streamed(spark, parts: list[DataFrame], flow) -> DataFrame:
    """Parts arrive as files one after another; each run of the stream takes in what is new and goes on from its state."""
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/source")
        with state_provider(spark):
            told = flow(spark.readStream.schema(part.schema).parquet(f"{folder}/source"))
            query = told.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(f"{folder}/told")


def r2_open_chunks(spark, d):
    """Logs of events in two parts, the second one beginning earlier for some: chunks told as soon as they close."""
    m = stored(from_events(spark, d).withColumn("late", F.col("message_id") >= 20 + F.col("conv_id") % 7))
    told = _streamed(spark, [m.filter("not late").drop("late"), m.filter("late").drop("late")], lambda rows: open_chunks(rows, 3, L.LIMIT))
    return told.filter("kind = 'closed'").select("conv_id", "chunk", "start_id", "end_id")


def r5_assembled_streams(spark, d):
    """Streams that arrive in pieces cut anywhere, the second halves later; those that close."""
    body = T.stream_pieces(from_conversations(spark, d)).withColumn("cut", F.col("seq") % 13 + 9)
    halves = F.array(F.struct((2 * F.col("seq")).alias("seq"), F.substr("piece", F.lit(1), F.col("cut").cast("int")).alias("piece")), F.struct((2 * F.col("seq") + 1).alias("seq"), F.substr("piece", (F.col("cut") + 1).cast("int")).alias("piece")))
    pieces = body.select("conv_id", F.explode(halves).alias("p")).select("conv_id", "p.seq", "p.piece")
    first = F.col("seq") < 2 + F.col("conv_id") % 3
    return assembly.completions(_streamed(spark, [pieces.filter(first), pieces.filter(~first)], assembly.assembled))


def r4_typed_changes(spark, d):
    """A tenth of the logs is renamed, a tenth branches at row 9, and one loses its row 4."""
    m = from_events(spark, d)
    one, kind = m.filter("message_id = 4"), F.col("conv_id") % 10
    said = F.when(kind == 0, "rename").when(kind == 1, "branch").when(kind == 2, "delete").otherwise("row")
    new = F.when(kind == 0, F.col("conv_id") + 100_000).when(kind == 1, F.col("conv_id") + 200_000)
    changes = one.withColumns({"changed_at": F.lit(1).cast("long"), "kind": said, "new_id": new, "upto": F.when(kind == 1, F.lit(9).cast("long"))}).withColumn("text", F.when(F.col("kind") == "delete", F.lit(None)).otherwise(F.col("text")))
    return refresh.applied(m, refresh.typed(changes)).select("conv_id", "message_id", "name")


def a16_message_breakdown(spark, d):
    """Conversations as lists of messages, a summary in the first; a third has tools, half of them a measured total."""
    m = from_conversations(spark, d)
    content = F.when(F.col("message_id") == 0, F.concat(F.lit("<log_summary>older "), F.col("conv_id").cast("string"), F.lit("</log_summary>\n"), F.col("text"))).otherwise(F.col("text"))
    one = F.struct(F.col("message_id").alias("at"), F.col("name").alias("role"), content.alias("content"))
    lists = m.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("messages"))
    tools = F.when(F.col("conv_id") % 3 == 0, '[{"name":"search"}]').otherwise("[]")
    rows = lists.select(F.col("conv_id").alias("record_id"), "messages", tools.alias("tools"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + 100).alias("actual_tokens"))
    return breakdown.message_breakdown(rows)


def h2_counted_tokens(spark, d):
    """A counter of words that fails for texts of an even number of them."""

    def words(text: str) -> float:
        n = len(text.split())
        if n % 2 == 0:
            raise ValueError(n)
        return n

    return tokens.counted_tokens(from_conversations(spark, d), counter=words).select("conv_id", "message_id", "tokens", "estimated")


def j5_matched_once(spark, d):
    """Completed messages (purchases, sign-ups) with the prompts (views) captured for them within ten minutes and since the
    one before, where an error row since then has prepared it; the table's clock runs 200 times as fast."""
    t = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 200)))
    of = lambda *kinds: t.filter(F.col("event_type").isin(*kinds))
    left = of("purchase", "signup").select("user_id", F.col("event_id").alias("id"), "at")
    right = of("view").select("user_id", F.col("event_id").alias("other"), F.col("at").alias("captured"))
    return frontier.matched_once(left, right, "user_id", 600, of("error", "click").select("user_id", "at")).select("user_id", "id", "other")


def a18_merged_usage(spark, d):
    """Usage maps of a user's events: numbers, numeric texts, texts and nested maps under the same keys."""
    t = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("event_id").cast("string")
    forms = [F.concat(F.lit('{"a":'), v, F.lit(',"b":{"c":{"d":1}}}')), F.concat(F.lit('{"a":"'), v, F.lit('","s":"x","n":null}')), F.concat(F.lit('{"b":{"c":{"d":'), v, F.lit('},"l":[1]},"a":true}')), F.lit('{"a":-5}')]
    text = F.get(F.array(*forms), (F.col("event_id") % 4).cast("int"))
    maps = t.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("no"), F.lit("usage").alias("root"), F.try_parse_json(text).alias("map"))
    return usage.merged_usage(maps).select("conv_id", "path", F.col("number").cast("long").alias("number"), "text")


def x9_regenerated(spark, d):
    """The first two chunks of each log are asked for anew; rows of some have changed, some requests are stale."""
    m = stored(from_events(spark, d))
    plan = stored(chunks.plan_by_turns(m, L.TURNS))
    entries = stored(L._named(lineage.range_hashes(m, plan.drop("turns_done"))).withColumn("updated_at", F.lit("u")))
    edited = m.withColumn("text", F.when((F.col("message_id") == 1) & (F.col("conv_id") % 3 == 0), "edited").otherwise(F.col("text")))
    first = plan.filter("chunk < 2").select("conv_id", F.lit(1).alias("level"), "start_id", "end_id", F.when((F.col("chunk") == 1) & (F.col("conv_id") % 4 == 0), "old").otherwise("u").alias("updated_at"))
    none = entries.filter(F.lit(False)).select("conv_id", F.lit(2).alias("parent_level"), F.col("start_id").alias("parent_start"), "level", "start_id", "end_id", "source_hash", "text", "deleted")
    results, refused = jobs.regenerate(first, entries, edited, none)
    return results.select("conv_id", "start_id", F.lit("made").alias("outcome")).unionByName(refused.select("conv_id", "start_id", F.col("reason").alias("outcome")))


STATES = [  # of conversation #: whole, older, broken, unknown, from before there were entries
    '{"schemaVersion":3,"chatUuid":"u","ownerChatId":"o#","stageSummary":{"entries":[{"text":" a# ","sourceStartMessageId":0,"sourceEndMessageId":"1","sourceHash":"h","updatedAt":"t","level":2.9,"manuallyEdited":true},{"deleted":true,"text":"x","sourceStartMessageId":2,"sourceEndMessageId":3,"level":40}]}}',
    '{"schemaVersion":1,"chatUuid":"u","ownerChatId":"o#","stageSummary":{"text":" old # ","coveredThroughMessageId":5.5,"coveredThroughHash":"g"}}',
    '{"schemaVersion":"2","chatUuid":"u","ownerChatId":"o#","stageSummary":{"entries":[{"text":"a","sourceStartMessageId":null,"sourceEndMessageId":1},{"text":"b","sourceStartMessageId":3,"sourceEndMessageId":4}],"text":"no"}}',
    '{"schemaVersion":9,"chatUuid":"u","ownerChatId":"o#","stageSummary":{"text":"x","coveredThroughMessageId":1}}',
    '{"schemaVersion":2,"chatUuid":"u","ownerChatId":"o#","stageSummary":{"entries":[{"text":" ","sourceStartMessageId":0,"sourceEndMessageId":1},{"text":"b","sourceStartMessageId":0,"sourceEndMessageId":4}],"text":"kept #","coveredThroughMessageId":2,"updatedAt":"w"}}',
    '{"schemaVersion":3,"chatUuid":"u","stageSummary":{"text":"x","coveredThroughMessageId":1}}',
    "no json #",
]


def s2_migrated_states(spark, d):
    form = F.get(F.array(*map(F.lit, STATES)), (F.col("conv_id") % len(STATES)).cast("int"))
    states = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct().select("conv_id", F.replace(form, F.lit("#"), F.col("conv_id").cast("string")).alias("state"))
    return migration.migrated(states)


def s11_record_details(spark, d):
    """Records of events: the index has all, details lie in buckets of users; for a fifth of the users the last one's."""
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 50).alias("mes_id"), F.col("event_id").alias("pos"), F.col("props").alias("prompt"))
    store = Buckets(spark, shared_folder(spark), {"details": "conv_id long, pos long, prompt string"}, 16)
    store.commit(0, {"details": t.filter("pos % 3 <> 0")}, list(range(16)))
    logs = t.filter("conv_id % 5 = 2").select("conv_id").distinct().withColumn("last_id", F.lit(30))
    return latest_details(t.select("conv_id", "mes_id", "pos"), store, logs)


QUERIES = {f.__name__: f for f in (r2_open_chunks, r5_assembled_streams, r4_typed_changes, a16_message_breakdown, h2_counted_tokens, j5_matched_once, a18_merged_usage, x9_regenerated, s2_migrated_states, s11_record_details)}

_A19 = T.SQL["a19_stream_completion"]
_SPACE = r"\s\x{000B}\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ENDS = f"'^[{_SPACE}]+|[{_SPACE}]+$'"


def _tokens(c: str) -> str:
    """A token for each CJK character and for each four UTF-16 units of the rest."""
    cjk, astral = L._CJK.format(c), f"length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    return f"{cjk} + ceil((length({c}) + {astral} - {cjk}) / 4.0)"


SQL = {
    "r2_open_chunks": f"WITH RECURSIVE {L.LOGS}, {L.greedy_sql(3, L.LIMIT)} SELECT conv_id, chunk, start_id, end_id FROM plan WHERE NOT open_",
    "r5_assembled_streams": _A19.replace("WHERE conv_id % 8 < 6", "WHERE conv_id % 8 < 4"),
    "r4_typed_changes": f"""WITH {L.LOGS} SELECT CASE WHEN conv_id % 10 = 0 AND n > 4 THEN conv_id + 100000 ELSE conv_id END AS conv_id, CASE WHEN conv_id % 10 = 2 AND message_id > 4 THEN message_id - 1 ELSE message_id END AS message_id, name
      FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM m) WHERE NOT (conv_id % 10 = 2 AND message_id = 4)
      UNION ALL SELECT conv_id + 200000, message_id, name FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM m) WHERE conv_id % 10 = 1 AND message_id <= 9 AND n > 4""",
    "a16_message_breakdown": f"""WITH {L.CONV}, r AS (SELECT conv_id AS record_id, message_id, lower(name) AS role, regexp_replace(text, {_ENDS}, '', 'g') AS t FROM m),
      q AS (SELECT record_id, string_agg(t, chr(10) ORDER BY message_id) FILTER (WHERE t <> '' AND role IN ('system', 'developer')) AS s, string_agg(t, chr(10) ORDER BY message_id) FILTER (WHERE t <> '' AND role IN ('user', 'assistant')) AS c,
        string_agg(t, chr(10) ORDER BY message_id) FILTER (WHERE t <> '' AND coalesce(role, '') NOT IN ('system', 'developer', 'user', 'assistant')) AS x, bool_or(message_id = 0 AND t IS NOT NULL) AS told FROM r GROUP BY record_id),
      p AS (SELECT record_id, coalesce(s, '') AS s, coalesce(c, '') AS c, CASE WHEN told THEN '<log_summary>older ' || record_id || '</log_summary>' ELSE '' END AS b, concat_ws(chr(10), x, CASE WHEN record_id % 3 = 0 THEN '[{{"name":"search"}}]' END) AS o FROM q),
      e AS (SELECT record_id, [{", ".join(map(_tokens, "scbo"))}] AS t, CASE WHEN record_id % 2 = 0 THEN record_id + 100 END AS measured_ FROM p),
      b AS (SELECT *, coalesce(measured_, list_sum(t)) AS total FROM e), g AS (SELECT *, {J._shares('t', 'total')} AS o FROM b)
      SELECT record_id, total::BIGINT AS total, o[1]::BIGINT AS system, o[2]::BIGINT AS recent_context, o[3]::BIGINT AS summary, o[4]::BIGINT AS other, greatest(total - list_sum(o), 0)::BIGINT AS unclassified, measured_ IS NOT NULL AS measured FROM g WHERE total > 0""",
    "h2_counted_tokens": f"""WITH {L.CONV}, w AS (SELECT *, len(string_split_regex(trim(text), '\\s+')) AS n FROM m)
      SELECT conv_id, message_id, CASE WHEN n % 2 = 1 THEN n ELSE ceil(length(text) / 4.0) END::BIGINT AS tokens, n % 2 = 0 AS estimated FROM w""",
    "j5_matched_once": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 200 AS t, CASE WHEN event_type IN ('purchase', 'signup') THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END AS side FROM events),
      r AS (SELECT *, count(*) FILTER (WHERE side = 2) OVER w AS turn, last_value(CASE WHEN side = 1 THEN event_id END IGNORE NULLS) OVER w AS other, last_value(CASE WHEN side = 1 THEN t END IGNORE NULLS) OVER w AS captured FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY t, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      x AS (SELECT r.*, (SELECT max(q.turn) FROM r q WHERE q.user_id = r.user_id AND q.event_id = r.other) AS other_turn, exists(SELECT 1 FROM r q WHERE q.user_id = r.user_id AND q.side = 0 AND q.turn = r.turn AND (q.t, q.side, q.event_id) < (r.t, r.side, r.event_id)) AS ready FROM r WHERE side = 2)
      SELECT user_id, event_id AS id, other FROM x WHERE other_turn = turn AND ready AND t - captured <= 600000000""",
    "a18_merged_usage": """WITH l AS (SELECT user_id AS conv_id, event_id AS no, 'a' AS path, event_id AS n, NULL AS s FROM events WHERE event_id % 4 < 2 UNION ALL SELECT user_id, event_id, 'a', NULL, CASE WHEN event_id % 4 = 2 THEN 'true' ELSE '-5' END FROM events WHERE event_id % 4 > 1
        UNION ALL SELECT user_id, event_id, 'b.c.d', CASE event_id % 4 WHEN 0 THEN 1 ELSE event_id END, NULL FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, 's', NULL, 'x' FROM events WHERE event_id % 4 = 1)
      SELECT conv_id, path, max(n) AS number, CASE WHEN max(n) IS NULL THEN arg_min(s, no) END AS text FROM l GROUP BY conv_id, path""",
    "x9_regenerated": f"""{L.STACK} SELECT conv_id, start_id, CASE WHEN (chunk = 1 AND conv_id % 4 = 0) OR deleted THEN 'changed' WHEN conv_id % 3 = 0 AND 1 BETWEEN start_id AND end_id THEN 'source' ELSE 'made' END AS outcome
      FROM entries WHERE chunk < 2""",
    "s2_migrated_states": """WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, 'o' || conv_id AS owner, x.* EXCLUDE (k) REPLACE (replace(text, '#', conv_id::VARCHAR) AS text, length(replace(text, '#', conv_id::VARCHAR)) AS char_count)
      FROM c JOIN (VALUES (0, 0::BIGINT, 2, 0::BIGINT, 1::BIGINT, 'a#', 0::BIGINT, 'h', 't', true, false), (0, 1, 32, 2, 3, '', 0, '', '1970-01-01T00:00:00.000Z', false, true), (1, 0, 1, 0, 5, 'old #', 0, 'g', '1970-01-01T00:00:00.000Z', false, false),
        (2, 0, 1, 0, 1, 'a', 0, '', '1970-01-01T00:00:00.000Z', false, false), (4, 0, 1, 0, 2, 'kept #', 0, '', 'w', false, false)) x(k, seq, level, start_id, end_id, text, char_count, source_hash, updated_at, manually_edited, deleted) ON conv_id % 7 = k""",
    "s11_record_details": """WITH l AS (SELECT user_id, max(event_id) AS pos FROM events WHERE event_id % 50 <= 30 AND user_id % 5 = 2 GROUP BY user_id)
      SELECT l.user_id AS conv_id, pos, props AS prompt FROM l JOIN events ON event_id = pos WHERE pos % 3 <> 0""",
}
