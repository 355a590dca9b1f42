"""Hand-sized logs with known answers, and random ones against a plain greedy twin."""

import random

import pytest
from pyspark.sql import functions as F

from convlog.functions import text as X
from convlog.operators import chunks, jobs, lineage, rollup, turns
from convlog.params import Params
from convlog.plans.job_queries import model_bodies
from convlog.streaming.refresh import run_refresh

SCHEMA = "conv_id long, message_id long, is_user boolean, is_system boolean, name string, text string"


def log(spark, *kinds, texts=None):
    rows = [(1, i, k == "u", k == "s", k, (texts or {}).get(i, k)) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [(r.start_id, r.end_id) for r in df.orderBy("start_id").collect()]


def test_turns(spark):
    assert turns.completed_turns(log(spark, *"auauaua")).first().turns == 3
    assert turns.completed_turns(log(spark, *"auauauau")).first().turns == 3
    assert pairs(chunks.plan_by_turns(log(spark, *"auauaua"), 2)) == [(0, 4), (5, 6)]


@pytest.mark.parametrize(("size", "unit", "start", "gone"), [(1, "turns", 3, 3), (2, "messages", 3, 3), (20, "turns", 0, 0), (0, "turns", 5, 5)])
def test_window(spark, size, unit, start, gone):
    r = turns.recent_window(log(spark, *"auauau"), size, unit).first()
    assert (r.retained_start, r.removable) == (start, gone)


def test_system_rows_stay(spark):
    r = turns.recent_window(log(spark, *"sauauau"), 1).first()
    assert (r.retained_start, r.removable) == (4, 3)


def test_no_user_row(spark):
    assert turns.recent_window(log(spark, *"asa"), 1).count() == 0
    assert turns.current_input(log(spark, *"asa")).count() == 0


def test_align(spark):
    at = lambda m, s: turns.align_to_turn(m, m.sparkSession.createDataFrame([(1, s)], "conv_id long, start long")).first().aligned
    assert at(log(spark, *"auauau"), 2) == 1
    assert at(log(spark, *"auauau"), 3) == 3
    assert at(log(spark, *"usau"), 1) == 0


def test_limit_never_splits_the_first_turn(spark):
    m = log(spark, *"uau", texts={0: "x" * 800, 1: "x" * 400, 2: "x" * 100})
    assert pairs(chunks.plan_chunks(m, 5, 1000)) == [(0, 1), (2, 2)]


def twin(rows, n, limit):
    """(start, end, planned end) of the chunks of rows (user, system, characters, new phase), row by row."""
    out, i = [], 0
    while i < len(rows):
        t, chars, last, waits, planned = 0, 0, None, False, len(rows) - 1
        for j in range(i, len(rows)):
            user, system, size, _ = rows[j]
            if chars + size > limit and last is not None:
                planned = last
                break
            chars += size
            if user and not system:
                waits = True
            elif not system and waits:
                waits, t, last = False, t + 1, j
                if t >= n or chars >= limit:
                    planned = j
                    break
        end = next((q - 1 for q in range(i + 1, planned + 1) if rows[q][3]), planned)
        out.append((i, end, planned))
        i = end + 1
    return out


def ready_twin(rows, seen, n, limit):
    """The chunks of rows before the first that must wait."""
    out = []
    for start, end, planned in twin(rows, n, limit):
        part, t, waits = rows[start : end + 1], 0, False
        for user, system, _, _ in part:
            if user and not system:
                waits = True
            elif not system and waits:
                waits, t = False, t + 1
        cut = end < planned and any(v and not r[1] for r, v in zip(part, seen[start : end + 1], strict=True))
        if not (t >= n or planned < len(rows) - 1 or cut or (t > 0 and sum(r[2] for r in part) > limit)):
            break
        out.append((start, end))
    return out


def random_logs(seed, count=200, rows=40, phases=0.05):
    rnd, logs = random.Random(seed), []
    for _ in range(count):
        r = [(rnd.random() < 0.45, rnd.random() < 0.1, rnd.choice([0, 10, 200, 500, 600, 1000]), rnd.random() < phases) for _ in range(rnd.randint(1, rows))]
        logs.append([(u and not s, s, n, b and u and not s) for u, s, n, b in r])
    return logs


def table_of(spark, logs):
    rows = [(c, i, u, s, "n", "x" * n, b) for c, r in enumerate(logs) for i, (u, s, n, b) in enumerate(r)]
    return spark.createDataFrame(rows, SCHEMA + ", b boolean")


def by_log(df, *columns):
    got = {}
    for r in df.orderBy("conv_id", "start_id").collect():
        got.setdefault(r.conv_id, []).append(tuple(r[c] for c in columns))
    return got


@pytest.mark.parametrize("blocks", [False, True])
def test_chunks_like_the_twin(spark, monkeypatch, blocks):
    if blocks:  # many blocks a log
        monkeypatch.setattr(chunks, "BLOCK_ROWS", 5)
        monkeypatch.setattr(chunks, "BLOCK_TURNS", 4)
    logs = random_logs(5)
    m = table_of(spark, logs)
    plan = chunks.plan_chunks(m, 3, 1000, F.col("b"))
    assert by_log(plan, "start_id", "end_id", "planned_end") == {c: twin(r, 3, 1000) for c, r in enumerate(logs)}
    assert all(k == i for part in by_log(plan, "chunk").values() for i, (k,) in enumerate(part))
    if not blocks:
        got = by_log(chunks.plan_by_turns(m, 3, F.col("b")), "start_id", "end_id")
        assert got == {c: [x[:2] for x in twin(r, 3, 10**9)] for c, r in enumerate(logs)}


def test_one_long_log(spark, monkeypatch):
    """A log of many blocks and chunks; no boundary, and nothing but boundaries."""
    monkeypatch.setattr(chunks, "BLOCK_ROWS", 100)
    monkeypatch.setattr(chunks, "BLOCK_TURNS", 50)
    logs = random_logs(6, 2, 4000, 0.01) + [[(True, False, 1, True)] * 60, [(False, True, 5, False)] * 9]
    plan = chunks.plan_chunks(table_of(spark, logs), 7, 3000, F.col("b"))
    assert by_log(plan, "start_id", "end_id", "planned_end") == {c: twin(r, 7, 3000) for c, r in enumerate(logs)}
    empty = spark.createDataFrame([], SCHEMA)
    assert chunks.plan_chunks(empty, 7, 3000).count() == 0


def test_ready_like_the_twin(spark):
    """Chunks that may be summarised, with phases, texts without visible parts and a limit that binds."""
    logs = random_logs(7, 400, 30, 0.15)
    m = table_of(spark, logs).withColumn("v", F.col("message_id") % 3 == 0)
    targets = {r.conv_id: r.target for r in turns.ready_target(m, 2).collect()}
    want = {}
    for c, r in enumerate(logs):
        upto = r[: targets.get(c, -1) + 1]
        if found := ready_twin(upto, [i % 3 == 0 for i in range(len(upto))], 2, 1000):
            want[c] = found
    assert by_log(jobs.plan_ready(m, 2, 2, 1000, F.col("v"), F.col("b")), "start_id", "end_id") == want


def entries(spark, *levels, width=1):
    rows, at = [], 0
    for level in levels:
        size = 10 if level == 2 else 1
        rows.append((1, level, at, at + size - 1, False, f"t{at}", "h"))
        at += size
    return spark.createDataFrame(rows, "conv_id long, level int, start_id long, end_id long, deleted boolean, text string, source_hash string")


def test_rollup_due(spark):
    assert rollup.rollup_due(entries(spark, *[1] * 11), 10, 5).first().level == 1
    assert rollup.rollup_due(entries(spark, *[2] * 6, 1), 10, 5).first().level == 2
    assert rollup.rollup_due(entries(spark, *[1] * 10), 10, 5).count() == 0


def test_frontier_of_61(spark):
    want = [(3, 0, 49), (2, 50, 59), (1, 60, 60)]
    live = rollup.roll_up(entries(spark, *[1] * 61), 10, 5).orderBy("start_id").collect()
    assert [(r.level, r.start_id, r.end_id) for r in live] == want
    closed = rollup.closed_frontier(spark.createDataFrame([(1, 61)], "conv_id long, n long"), 10, 5, 8).orderBy("first").collect()
    assert [(r.level, r.first, r.last) for r in closed] == want


def test_deleted_run(spark):
    e = entries(spark, *[1] * 3).withColumn("deleted", F.lit(True)).withColumn("text", F.lit(""))
    parent = rollup.roll_up(e, 2, 2).filter("level = 2").first()
    assert parent.deleted and parent.text == ""


def test_gap_is_an_error(spark):
    e = entries(spark, *[1] * 4).filter("start_id <> 2")
    assert [(r.start_id, r.expected) for r in rollup.run_errors(e).collect()] == [(3, 2)]


def test_edit_invalidates(spark):
    m = log(spark, *"uaua")
    e = lineage.range_hashes(m, spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3)], "conv_id long, seq long, start_id long, end_id long"))
    assert lineage.valid_prefix(e, m).count() == 2
    assert lineage.valid_prefix(e, m.withColumn("text", F.when(F.col("message_id") == 0, "new").otherwise(F.col("text")))).count() == 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(X.token_estimate(F.lit(t))) for t in ("天地", "abcdefgh", "天地abcd")] == [2, 2, 3]
    assert one(X.utf16_length(F.lit("a😀"))) == 3
    shown = "<think>a</think><正文> X </正文><status>b</status>"
    assert one(X.visible_text(F.lit(shown), F.lit(False))) == "X"
    assert one(X.visible_text(F.lit(f" {shown}　"), F.lit(True))) == shown
    assert one(X.visible_text(F.lit("a<!-- b -->c<analysis>d</analysis>"), F.lit(False))) == "a c"
    assert one(X.summary_text(F.lit("```md\n<log_summary> s </log_summary>\n```"))) == "s"
    assert one(X.summary_text(F.lit(" \n"))) is None
    rules = (["new chapter"], r"\bif\b", r"\bnot\b")
    assert one(X.phase_boundary(F.lit("Done. A new chapter starts."), *rules))
    assert not one(X.phase_boundary(F.lit("What if a new chapter starts."), *rules))
    assert one(X.phase_boundary(F.lit("Not now. If so! A new chapter starts."), *rules))


def test_params():
    p = Params(window_size=-3, turns_per_chunk=1e9, group_1=1, window_unit="days")
    assert (p.window_size, p.turns_per_chunk, p.group_1, p.window_unit) == (0, 100, 2, "turns")


def test_model_bodies_are_bounded(spark):
    bodies = model_bodies(spark.range(5000).withColumnRenamed("id", "p_partkey")).collect()
    assert max(r.body.count('"id"') for r in bodies) <= 1000 and sum(r.body.count('"id"') for r in bodies) == 5000


def test_refresh_takes_many_files_in_one_batch(spark, tmp_path):
    for k, kinds in enumerate(("uaua", "uauaua")):
        log(spark, *kinds).withColumn("changed_at", F.lit(k)).repartition(3).write.mode("append").parquet(f"{tmp_path}/source")
        plans = run_refresh(spark, f"{tmp_path}/source", str(tmp_path), 2)
    assert pairs(plans) == [(0, 3), (4, 5)]
    assert sorted(int(p.name) for p in (tmp_path / "commits").glob("0*")) == [0, 1]
