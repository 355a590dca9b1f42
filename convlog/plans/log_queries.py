"""Queries over message logs, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.functions import text as X
from convlog.operators import chunks, lineage, rollup, turns
from convlog.sources.messages import from_conversations, from_documents, from_events

CONV = """m AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_id, role = 'user' AS is_user, role = 'system' AS is_system, role AS name, text
  FROM conversations)"""
LOGS = """m AS (
  SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS message_id, event_type IN ('view', 'click') AS is_user,
         event_type = 'error' AS is_system, event_type AS name, props AS text
  FROM events)"""
FLAGS = """f AS (
  SELECT m.*, NOT is_system AND NOT is_user AND coalesce(last_value(CASE WHEN NOT is_system THEN is_user END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS completes
  FROM m)"""
MARK = "name = 'click' AND message_id % 9 = 4"
LIMIT = 100  # characters of a chunk of events
SIZE, TURNS, CAPS = 2, 2, (2, 2)  # small, so that the tables' short logs have something to roll up


def window_sql(unit: str, size: int, source: str = "m") -> str:
    counts = "NOT is_system" if unit == "messages" else "is_user AND NOT is_system"
    return f"""cur AS (SELECT conv_id, max(message_id) AS current_input FROM {source} WHERE is_user AND NOT is_system GROUP BY conv_id),
  ranked AS (SELECT conv_id, message_id, row_number() OVER (PARTITION BY conv_id ORDER BY message_id DESC) AS k
             FROM {source} JOIN cur USING (conv_id) WHERE {counts} AND message_id < current_input),
  win AS (SELECT conv_id, current_input, coalesce((SELECT message_id FROM ranked r WHERE r.conv_id = cur.conv_id AND k = {size}), 0) AS retained_start FROM cur)"""


def greedy_sql(turns: int, chars: int, boundary: str = "false", size: str = "length(text)") -> str:
    """Rows of m one by one: a chunk's start and planned end, then where a boundary row ends it, then the next one's start.
    CTEs g (numbered rows), r (a state a row read) and plan (conv_id, chunk, start_id, end_id, planned_end, open_: just the log's
    end closed it)."""
    over = "r.cc + g.size > {0} AND r.zl IS NOT NULL".format(chars)
    done = "NOT g.is_system AND NOT g.is_user AND r.w"
    full = f"({done} AND (r.t + 1 >= {turns} OR r.cc + g.size >= {chars}))"
    mark = "coalesce(r.nb, CASE WHEN g.mark AND g.message_id > r.start_id THEN g.message_id END)"
    planned = f"CASE WHEN {over} THEN r.zl WHEN {full} OR g.message_id = g.last_ THEN g.message_id END"
    return f"""g AS (SELECT conv_id, message_id, is_user, is_system, coalesce({size}, 0) AS size, {boundary} AS mark, max(message_id) OVER (PARTITION BY conv_id) AS last_ FROM m),
  r AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS start_id, 0::BIGINT AS t, 0::BIGINT AS cc, NULL::BIGINT AS zl, false AS w, NULL::BIGINT AS nb, 0::BIGINT AS chunk, NULL::BIGINT AS from_, NULL::BIGINT AS end_id, NULL::BIGINT AS planned_end, false AS open_ FROM g
    UNION ALL
    SELECT conv_id, CASE WHEN p IS NULL THEN i + 1 ELSE e + 1 END, CASE WHEN p IS NULL THEN start_id ELSE e + 1 END, CASE WHEN p IS NULL THEN t ELSE 0 END, CASE WHEN p IS NULL THEN cc ELSE 0 END, CASE WHEN p IS NULL THEN zl END, p IS NULL AND w,
      CASE WHEN p IS NULL THEN nb END, CASE WHEN p IS NULL THEN chunk ELSE chunk + 1 END, CASE WHEN p IS NOT NULL THEN start_id END, e, p, open_
    FROM (SELECT *, CASE WHEN nb <= p THEN nb - 1 ELSE p END AS e FROM (
      SELECT r.conv_id, r.i, r.start_id, r.chunk, r.t + ({done})::INT AS t, r.cc + g.size AS cc, CASE WHEN {done} THEN g.message_id ELSE r.zl END AS zl,
        CASE WHEN g.is_system THEN r.w WHEN g.is_user THEN true ELSE false END AS w, {mark} AS nb, {planned} AS p, coalesce(NOT ({over}), true) AND NOT {full} AS open_
      FROM r JOIN g ON g.conv_id = r.conv_id AND g.message_id = r.i))),
  plan AS (SELECT conv_id, chunk - 1 AS chunk, from_ AS start_id, end_id, planned_end, open_ FROM r WHERE from_ IS NOT NULL)"""


DOCS = """m AS (
  SELECT source AS conv_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS message_id, doc_id % 40 < 20 AS is_user, false AS is_system, text FROM documents)"""
CHUNKS_SQL = f"""b AS (SELECT f.*, coalesce(sum(completes::INT) OVER (PARTITION BY conv_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM f),
  parts AS (SELECT conv_id, segment // {TURNS} AS part, min(message_id) AS start_id, max(message_id) AS end_id, count(*) FILTER (WHERE completes) AS turns_done FROM b GROUP BY ALL),
  chunks AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_id) - 1 AS chunk, start_id, end_id, turns_done FROM parts)"""
HASHES_SQL = """rows_ AS (SELECT c.conv_id, c.chunk, c.start_id, c.end_id, m.message_id,
    '=' || m.message_id || chr(31) || '=' || m.is_user || chr(31) || '=' || m.is_system || chr(31) || coalesce('=' || m.name, '~') || chr(31) || coalesce('=' || m.text, '~') AS one
    FROM chunks c JOIN m ON m.conv_id = c.conv_id AND m.message_id BETWEEN c.start_id AND c.end_id),
  hashed AS (SELECT conv_id, chunk, start_id, end_id, sha256(string_agg(one, chr(30) ORDER BY message_id)) AS source_hash FROM rows_ GROUP BY ALL)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan_by_turns(from_events(spark, sf_dir), TURNS)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.range_hashes(from_events(spark, sf_dir), _plan(spark, sf_dir).drop("turns_done"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-1 summaries of all chunks: every seventh is deleted, texts name their range."""
    return _named(_hashed(spark, sf_dir))


def _named(h: DataFrame) -> DataFrame:
    gone = F.col("chunk") % 7 == 6
    return h.select("conv_id", F.lit(1).alias("level"), "start_id", "end_id", gone.alias("deleted"), F.when(gone, "").otherwise(X.range_key(F.lit(1), F.col("start_id"), F.col("end_id"))).alias("text"), "source_hash")


def _first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the first five chunks of each log, so that not all of it is covered."""
    h = _hashed(spark, sf_dir).filter("chunk < 5").select("conv_id", "start_id")
    return _entries(spark, sf_dir).join(h, ["conv_id", "start_id"], "left_semi")


PHASE_SQL = "phase AS (SELECT conv_id, max(message_id) AS phase_start FROM m JOIN cur USING (conv_id) WHERE name = 'click' AND message_id % 9 = 4 AND message_id <= current_input GROUP BY conv_id)"
ENTRIES_SQL = """entries AS (SELECT conv_id, 1 AS level, chunk, start_id, end_id, chunk % 7 = 6 AS deleted,
    CASE WHEN chunk % 7 = 6 THEN '' ELSE '1:' || start_id || ':' || end_id END AS text, source_hash FROM hashed)"""
STACK_IN = f"{LOGS}, {FLAGS}, {CHUNKS_SQL}, {HASHES_SQL}, {ENTRIES_SQL}"
STACK = f"WITH {STACK_IN}"
# all nodes that ever were, level by level, two children each; those that no parent took are the frontier
NODES = """nodes AS (
    SELECT conv_id, 1 AS level, row_number() OVER (PARTITION BY conv_id ORDER BY start_id) - 1 AS ord, count(*) OVER (PARTITION BY conv_id) AS n, start_id, end_id, deleted, text FROM entries
    UNION ALL
    SELECT conv_id, level, ord, count(*) OVER (PARTITION BY conv_id) AS n, start_id, end_id, deleted, CASE WHEN deleted THEN '' ELSE text END FROM (
      SELECT conv_id, level + 1 AS level, ord // 2 AS ord, min(start_id) AS start_id, max(end_id) AS end_id, bool_and(deleted) AS deleted, string_agg(text, chr(10) ORDER BY start_id) AS text
      FROM nodes WHERE ord // 2 < (n - 1) // 2 GROUP BY conv_id, level + 1, ord // 2)),
  frontier AS (SELECT * FROM nodes WHERE ord // 2 >= (n - 1) // 2)"""


def s1_message_scan(spark, d):
    return from_conversations(spark, d)


def p1_non_system(spark, d):
    return turns.non_system(from_conversations(spark, d)).select("conv_id", "message_id", "name")


def w1_turn_flags(spark, d):
    return turns.turn_flags(from_events(spark, d)).select("conv_id", "message_id", "completes")


def w2_turn_segments(spark, d):
    return turns.turn_segments(from_events(spark, d)).select("conv_id", "message_id", "segment")


def a1_completed_turns(spark, d):
    return turns.completed_turns(from_events(spark, d))


def w3_current_input(spark, d):
    return turns.current_input(from_conversations(spark, d))


def w4_recent_window(spark, d):
    return turns.recent_window(from_events(spark, d), SIZE)


def w4_recent_window_messages(spark, d):
    return turns.recent_window(from_events(spark, d), 5, "messages")


def w5_align_to_turn(spark, d):
    m = from_events(spark, d)
    return turns.align_to_turn(m, turns.recent_window(m, 5, "messages").select("conv_id", F.col("retained_start").alias("start")))


def w6_safe_start(spark, d):
    m = from_events(spark, d)
    covered = m.groupBy("conv_id").agg((F.floor(F.max("message_id") / 2) + F.col("conv_id") % 3 - 1).alias("covered")).filter("conv_id % 5 <> 0")
    return turns.safe_start(m, covered, SIZE)


def w7_ready_target(spark, d):
    return turns.ready_target(from_events(spark, d), SIZE)


def a10_non_system_count(spark, d):
    m = from_events(spark, d)
    return turns.non_system_count(m, m.groupBy("conv_id").agg((F.col("conv_id") % 4).alias("start"), F.floor(F.max("message_id") / 2).alias("end")))


def u3_remove_rows(spark, d):
    m = from_events(spark, d)
    w = turns.recent_window(m, SIZE)
    gone = m.join(w, "conv_id").filter("message_id < retained_start and not is_system")
    return turns.remove_rows(m, gone).select("conv_id", "message_id", "name")


def w8_chunk_plan(spark, d):
    return _plan(spark, d)


def w8_chunk_plan_limited(spark, d):
    return chunks.plan_chunks(from_documents(spark, d), 3, 20_000)


def w8_chunk_fold(spark, d):
    """A limit that binds for some chunks, and phases that cut others."""
    return chunks.plan_chunks(from_events(spark, d), 3, LIMIT, (F.col("name") == "click") & (F.col("message_id") % 9 == 4))


def a3_chunk_sizes(spark, d):
    return chunks.chunk_sizes(from_events(spark, d), _plan(spark, d))


def w10_ready_chunks(spark, d):
    """The last chunk of every other log is cut by a phase after its first row; the limit on characters binds at times."""
    plan = _plan(spark, d).withColumn("planned_end", F.col("end_id"))
    last = F.col("chunk") == F.max("chunk").over(Window.partitionBy("conv_id"))
    cut = plan.withColumn("end_id", F.when(last & (F.col("conv_id") % 2 == 0), F.col("start_id")).otherwise(F.col("end_id")))
    return chunks.ready_chunks(from_events(spark, d), cut, TURNS, 60, F.col("name") != "view")


def j1_entry_messages(spark, d):
    return chunks.chunk_rows(from_events(spark, d), _plan(spark, d)).select("conv_id", "chunk", "message_id", "name")


def a4_range_hashes(spark, d):
    return _hashed(spark, d)


def a6_frontier_signature(spark, d):
    return lineage.frontier_signature(_entries(spark, d))


def w11_valid_prefix(spark, d):
    """Row 9 of every third log is edited after the summaries were made."""
    m = from_events(spark, d)
    edited = m.withColumn("text", F.when((F.col("message_id") == 9) & (F.col("conv_id") % 3 == 0), F.lit("edited")).otherwise(F.col("text")))
    entries = _hashed(spark, d).select("conv_id", F.col("chunk").alias("seq"), "start_id", "end_id", "source_hash")
    return lineage.valid_prefix(entries, edited)


def w17_contiguous_prefix(spark, d):
    entries = _plan(spark, d).filter("chunk <> 3 or conv_id % 2 = 0").select("conv_id", F.col("chunk").alias("seq"), "start_id", "end_id")
    return lineage.contiguous_prefix(entries)


def j6_changed_from(spark, d):
    m = from_events(spark, d)
    live = m.filter("message_id < 30 or conv_id % 4 <> 0").withColumn("text", F.when((F.col("message_id") == 12) & (F.col("conv_id") % 3 == 0), F.lit(None)).otherwise(F.col("text")))
    return lineage.changed_from(m, live)


def w15_carried_text(spark, d):
    return lineage.carried_text(_entries(spark, d), 6, "..").select("conv_id", "start_id", "carried")


def a2_level_counts(spark, d):
    return rollup.level_counts(rollup.roll_up(_entries(spark, d), *CAPS))


def w12_roll_up(spark, d):
    return rollup.roll_up(_entries(spark, d), *CAPS).select("conv_id", "level", "start_id", "end_id", "deleted", "text")


def w13_closed_frontier(spark, d):
    return rollup.closed_frontier(_plan(spark, d).groupBy("conv_id").agg(F.count("*").alias("n")), *CAPS)


def w14_rollup_due(spark, d):
    return rollup.rollup_due(_entries(spark, d).filter("conv_id % 2 = 0 or start_id < 8"), *CAPS)


def w20_frontier_ordinal(spark, d):
    e = _entries(spark, d)
    return e.select("conv_id", "start_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("start_id", "end_id")).cast("long").alias("ordinal"))


def f1_token_estimate(spark, d):
    m = from_conversations(spark, d)
    return m.select("conv_id", "message_id", X.token_estimate(F.concat("text", F.lit("天地😀"))).alias("tokens"), X.utf16_length(F.concat("text", F.lit("😀"))).alias("utf16"), F.length("text").cast("long").alias("points"))


def a9_sampled_tokens(spark, d):
    """Tokens of the removable rows from at most so many evenly spaced ones."""
    from convlog.operators.tokens import sampled_tokens

    m = from_events(spark, d)
    gone = m.join(turns.recent_window(m, SIZE), "conv_id").filter("message_id < retained_start and not is_system")
    return sampled_tokens(gone, 7)


QUERIES = {f.__name__: f for f in (
    s1_message_scan, p1_non_system, w1_turn_flags, w2_turn_segments, a1_completed_turns, w3_current_input, w4_recent_window, w4_recent_window_messages, w5_align_to_turn, w6_safe_start,
    w7_ready_target, a10_non_system_count, u3_remove_rows, w8_chunk_plan, w8_chunk_plan_limited, w8_chunk_fold, a3_chunk_sizes, w10_ready_chunks, j1_entry_messages, a4_range_hashes,
    a6_frontier_signature, w11_valid_prefix, w17_contiguous_prefix, j6_changed_from, w15_carried_text, a2_level_counts, w12_roll_up, w13_closed_frontier, w14_rollup_due,
    w20_frontier_ordinal, f1_token_estimate, a9_sampled_tokens,
)}

_ALIGN = """al AS (SELECT st.conv_id, st.start, (SELECT min(message_id) FROM m WHERE m.conv_id = st.conv_id AND message_id >= st.start AND NOT is_system) AS first_,
    (SELECT max(message_id) + 1 FROM m WHERE m.conv_id = st.conv_id) AS n FROM st),
  aligned AS (SELECT conv_id, CASE WHEN start <= 0 OR start >= n OR first_ IS NULL THEN greatest(0, least(n, start))
    ELSE coalesce((SELECT max(message_id) FROM m WHERE m.conv_id = al.conv_id AND is_user AND NOT is_system AND message_id <= first_), 0) END AS aligned FROM al)"""
_CJK = "length(regexp_replace({0}, '[^㐀-鿿豈-﫿]', '', 'g'))"

# the plan of logs whose row 5 was edited: the user's is the assistant's now and the other way round, but for system rows
EDITED_SQL = f"WITH {LOGS.replace('m AS (', 'm0 AS (')}, m AS (SELECT * REPLACE (CASE WHEN message_id = 5 THEN NOT is_user AND NOT is_system ELSE is_user END AS is_user) FROM m0), {FLAGS}, {CHUNKS_SQL} SELECT * FROM chunks"
SQL = {
    "s1_message_scan": f"WITH {CONV} SELECT * FROM m",
    "p1_non_system": f"WITH {CONV} SELECT conv_id, message_id, name FROM m WHERE NOT is_system",
    "w1_turn_flags": f"WITH {LOGS}, {FLAGS} SELECT conv_id, message_id, completes FROM f",
    "w2_turn_segments": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL} SELECT conv_id, message_id, segment::BIGINT AS segment FROM b",
    "a1_completed_turns": f"WITH {LOGS}, {FLAGS} SELECT conv_id, count(*) FILTER (WHERE completes) AS turns FROM f GROUP BY conv_id",
    "w3_current_input": f"WITH {CONV} SELECT conv_id, max(message_id) AS current_input FROM m WHERE is_user AND NOT is_system GROUP BY conv_id",
    "w4_recent_window": f"WITH {LOGS}, {window_sql('turns', SIZE)} SELECT win.*, (SELECT count(*) FROM m WHERE m.conv_id = win.conv_id AND message_id < retained_start AND NOT is_system) AS removable FROM win",
    "w4_recent_window_messages": f"WITH {LOGS}, {window_sql('messages', 5)} SELECT win.*, (SELECT count(*) FROM m WHERE m.conv_id = win.conv_id AND message_id < retained_start AND NOT is_system) AS removable FROM win",
    "w5_align_to_turn": f"WITH {LOGS}, {window_sql('messages', 5)}, st AS (SELECT conv_id, retained_start AS start FROM win), {_ALIGN} SELECT * FROM aligned",
    "w6_safe_start": f"""WITH {LOGS}, {window_sql('turns', SIZE)}, cov AS (SELECT conv_id, max(message_id) // 2 + conv_id % 3 - 1 AS covered FROM m GROUP BY conv_id HAVING conv_id % 5 <> 0),
      st AS (SELECT conv_id, least(retained_start, greatest(0, coalesce(covered + 1, 0))) AS start FROM win LEFT JOIN cov USING (conv_id)), {_ALIGN}
      SELECT conv_id, aligned AS safe_start FROM aligned""",
    "w7_ready_target": f"""WITH {LOGS}, ends AS (SELECT conv_id, max(message_id) AS last_, arg_max(is_user, message_id) FILTER (WHERE NOT is_system) AS open_, count(*) FILTER (WHERE NOT is_system) AS n FROM m GROUP BY conv_id),
      mv AS (SELECT conv_id, message_id, is_user, is_system FROM m UNION ALL SELECT conv_id, last_ + 1, true, false FROM ends), {window_sql('turns', SIZE, 'mv')}
      SELECT conv_id, CASE WHEN n > 0 AND NOT open_ AND (SELECT count(*) FROM mv WHERE mv.conv_id = ends.conv_id AND message_id < retained_start AND NOT is_system) > 0 THEN retained_start - 1 ELSE -1 END AS target
      FROM ends JOIN win USING (conv_id)""",
    "a10_non_system_count": f"WITH {LOGS}, r AS (SELECT conv_id, conv_id % 4 AS start, max(message_id) // 2 AS \"end\" FROM m GROUP BY conv_id) SELECT conv_id, start, \"end\", count(*) FILTER (WHERE message_id >= start AND message_id < \"end\" AND NOT is_system) AS n FROM m JOIN r USING (conv_id) GROUP BY ALL",
    "u3_remove_rows": f"WITH {LOGS}, {window_sql('turns', SIZE)} SELECT m.conv_id, message_id, name FROM m LEFT JOIN win USING (conv_id) WHERE is_system OR retained_start IS NULL OR message_id >= retained_start",
    "w8_chunk_plan": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL} SELECT * FROM chunks",
    "w8_chunk_fold": f"WITH RECURSIVE {LOGS}, {greedy_sql(3, LIMIT, MARK)} SELECT * EXCLUDE (open_) FROM plan",
    "w8_chunk_plan_limited": f"WITH RECURSIVE {DOCS}, {greedy_sql(3, 20_000)} SELECT * EXCLUDE (open_) FROM plan",
    "a3_chunk_sizes": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL} SELECT c.conv_id, chunk, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM chunks c JOIN m ON m.conv_id = c.conv_id AND message_id BETWEEN start_id AND end_id GROUP BY ALL",
    "w10_ready_chunks": f"""WITH {LOGS}, {FLAGS}, {CHUNKS_SQL}, k AS (SELECT *, max(chunk) OVER (PARTITION BY conv_id) = chunk AND conv_id % 2 = 0 AS cut, end_id AS planned FROM chunks),
      e AS (SELECT conv_id, chunk, start_id, CASE WHEN cut THEN start_id ELSE planned END AS end_id, planned FROM k),
      facts AS (SELECT e.*, count(*) FILTER (WHERE completes) AS t, sum(length(text)) AS chars, bool_or(name <> 'view' AND NOT is_system) AS seen FROM e JOIN f ON f.conv_id = e.conv_id AND f.message_id BETWEEN e.start_id AND e.end_id GROUP BY ALL),
      g AS (SELECT *, max(end_id) OVER (PARTITION BY conv_id) AS last_ FROM facts),
      h AS (SELECT *, t >= {TURNS} OR planned < last_ OR (end_id < planned AND seen) OR (t > 0 AND chars > 60) AS ready FROM g),
      o AS (SELECT *, min(CASE WHEN NOT ready THEN chunk END) OVER (PARTITION BY conv_id) AS stop FROM h)
      SELECT conv_id, chunk, start_id, end_id FROM o WHERE stop IS NULL OR chunk < stop""",
    "j1_entry_messages": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL} SELECT c.conv_id, chunk, message_id, name FROM chunks c JOIN m ON m.conv_id = c.conv_id AND message_id BETWEEN start_id AND end_id",
    "a4_range_hashes": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL}, {HASHES_SQL} SELECT * FROM hashed",
    "a6_frontier_signature": f"{STACK} SELECT conv_id, string_agg('1:' || start_id || ':' || end_id || ':' || source_hash, '|' ORDER BY start_id) AS signature FROM entries GROUP BY conv_id",
    "w11_valid_prefix": f"""WITH {LOGS}, {FLAGS}, {CHUNKS_SQL}, {HASHES_SQL}, bad AS (SELECT conv_id, min(chunk) AS b FROM chunks WHERE conv_id % 3 = 0 AND 9 BETWEEN start_id AND end_id GROUP BY conv_id)
      SELECT conv_id, chunk AS seq, start_id, end_id, source_hash FROM hashed LEFT JOIN bad USING (conv_id) WHERE b IS NULL OR chunk < b""",
    "w17_contiguous_prefix": f"WITH {LOGS}, {FLAGS}, {CHUNKS_SQL} SELECT conv_id, chunk AS seq, start_id, end_id FROM chunks WHERE conv_id % 2 = 0 OR chunk < 3",
    "j6_changed_from": f"""WITH {LOGS}, c AS (SELECT conv_id, message_id FROM m WHERE (message_id >= 30 AND conv_id % 4 = 0) OR (message_id = 12 AND conv_id % 3 = 0 AND text IS NOT NULL))
      SELECT conv_id, min(message_id) AS changed_from FROM c GROUP BY conv_id""",
    "w15_carried_text": f"""{STACK}, c AS (SELECT conv_id, start_id, coalesce(last_value(CASE WHEN NOT deleted THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY start_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS t FROM entries)
      SELECT conv_id, start_id, CASE WHEN length(t) <= 6 THEN t ELSE '..' || right(t, 4) END AS carried FROM c""",
    "a2_level_counts": f"WITH RECURSIVE {STACK_IN}, {NODES} SELECT conv_id, level, count(*) AS n FROM frontier GROUP BY conv_id, level",
    "w12_roll_up": f"WITH RECURSIVE {STACK_IN}, {NODES} SELECT conv_id, level, start_id, end_id, deleted, text FROM frontier",
    "w13_closed_frontier": f"""WITH RECURSIVE {LOGS}, {FLAGS}, {CHUNKS_SQL}, lv AS (
        SELECT conv_id, 1 AS level, count(*) AS c, greatest((count(*) - 1) // 2, 0) AS nxt, 1::BIGINT AS w FROM chunks GROUP BY conv_id
        UNION ALL SELECT conv_id, level + 1, nxt, greatest((nxt - 1) // 2, 0), w * 2 FROM lv WHERE nxt > 0)
      SELECT conv_id, level, j * w AS first, (j + 1) * w - 1 AS last FROM (SELECT *, unnest(range(nxt * 2, c)) AS j FROM lv)""",
    "w14_rollup_due": f"{STACK} SELECT conv_id, 1 AS level FROM entries WHERE conv_id % 2 = 0 OR start_id < 8 GROUP BY conv_id HAVING count(*) > 2",
    "w20_frontier_ordinal": f"{STACK} SELECT conv_id, start_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_id, end_id) AS ordinal FROM entries",
    "f1_token_estimate": f"WITH {CONV} SELECT conv_id, message_id, 2 + ceil((length(text) + 2) / 4.0)::BIGINT AS tokens, length(text) + 2 AS utf16, length(text) AS points FROM m",
    "a9_sampled_tokens": f"""WITH {LOGS}, {window_sql('turns', SIZE)}, g AS (SELECT m.conv_id, text, row_number() OVER (PARTITION BY m.conv_id ORDER BY message_id) - 1 AS i, count(*) OVER (PARTITION BY m.conv_id) AS n
        FROM m JOIN win USING (conv_id) WHERE message_id < retained_start AND NOT is_system),
      p AS (SELECT conv_id, n, k, CASE WHEN k = 1 THEN 0 ELSE floor(s * (n - 1) / (k - 1.0) + 0.5)::BIGINT END AS i FROM (SELECT conv_id, n, least(n, 7) AS k, unnest(range(0, least(n, 7))) AS s FROM (SELECT DISTINCT conv_id, n FROM g)))
      SELECT p.conv_id, floor(sum(ceil(length(text) / 4.0)) * any_value(p.n) / any_value(k) + 0.5)::BIGINT AS tokens FROM p JOIN g ON g.conv_id = p.conv_id AND g.i = p.i GROUP BY p.conv_id""",
}
