"""Streams against the batch results of the same rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from convlog.operators import chunks, lineage
from convlog.params import Params
from convlog.streaming import assembly, refresh
from convlog.streaming.buckets import Buckets
from convlog.streaming.open_chunks import Open, open_chunks, state_provider
from test_logs import SCHEMA, by_log, random_logs, table_of, twin


def test_open_chunk_like_the_twin():
    for r in random_logs(11, 400, 60, 0.1):
        log, got = Open(3, 1000), []
        for row in r:
            got += list(log.add(*row))
        want = [x[:2] for x in twin(r, 3, 1000)]
        assert [c[1:] for c in got] == want[: len(got)] and [c[0] for c in got] == list(range(len(got)))
        assert log.start_id == (want[len(got)][0] if len(got) < len(want) else len(r))  # what is left is open


def replay(spark, folder, batches, turns=3, chars=1000, ttl=None):
    """Rows of each batch in a file of its own, taken in one by one by a stream that is started again each time."""
    out = []
    for k, batch in enumerate(batches):
        batch.repartition(2).write.mode("append").parquet(f"{folder}/source")
        with state_provider(spark):
            stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/source")
            told = open_chunks(stream, turns, chars, F.col("b"), ttl)
            sink = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/told/batch={n}")
            query = told.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/progress").trigger(**({"once": True} if ttl else {"availableNow": True})).start()
            query.awaitTermination()
        if ttl:
            time.sleep(ttl + 1)
    out = spark.read.parquet(f"{folder}/told").collect()
    return out


def test_replay_in_random_batches(spark, tmp_path):
    logs = random_logs(12, 40, 30, 0.08)
    rnd = random.Random(1)
    rows = table_of(spark, logs).collect()
    part = {}
    for r in rows:  # mostly in turn, some early, so that gaps are closed later
        part[r.conv_id, r.message_id] = min(2, max(0, int(3 * r.message_id / 30 + rnd.choice([0, 0, 0, -1]))))
    schema = SCHEMA + ", b boolean"
    batches = [spark.createDataFrame([r for r in rows if part[r.conv_id, r.message_id] == k], schema) for k in range(3)]
    told = replay(spark, str(tmp_path), batches)
    want = by_log(chunks.plan_chunks(table_of(spark, logs), 3, 1000, F.col("b")), "start_id", "end_id")
    lost = {r.conv_id for r in told if r.kind == "rebuild"}  # logs whose first row came late
    got = {}
    for r in sorted((r for r in told if r.kind == "closed"), key=lambda r: (r.conv_id, r.chunk)):
        got.setdefault(r.conv_id, []).append((r.start_id, r.end_id))
    for c in set(want) - lost:
        mine = got.get(c, [])
        assert mine == want[c][: len(mine)] and len(mine) >= len(want[c]) - 4
    first = {c for c, i in part if i == 0 and part[c, i] == 0}
    assert not lost & first and len(lost) < 20


def test_edits_and_expired_state_rebuild(spark, tmp_path):
    schema = SCHEMA + ", b boolean"
    make = lambda *ids, conv=1: spark.createDataFrame([(conv, i, i % 2 == 0, False, "n", "x", False) for i in ids], schema)
    told = replay(spark, str(tmp_path / "a"), [make(0, 1, 2, 3), make(1)], turns=2)
    assert [(r.kind, r.start_id, r.end_id) for r in sorted(told, key=lambda r: r.kind)] == [("closed", 0, 3), ("rebuild", 1, None)]
    told = replay(spark, str(tmp_path / "b"), [make(0, 1), make(2, 3, 4, 5)], turns=2, ttl=1)
    assert {(r.kind, r.start_id) for r in told} == {("rebuild", 2)}


CHANGE = SCHEMA + ", changed_at long, kind string, new_id long, upto long"


def change(conv, i, user, text="x", at=0, kind="row", new=None, upto=None):
    return (conv, i, user, False, "n", text, at, kind, new, upto)


def said(df):
    return sorted((r.conv_id, r.message_id, r.text) for r in df.collect())


def test_typed_changes(spark):
    rows = spark.createDataFrame([(c, i, i % 2 == 0, False, "n", f"{c}{i}") for c in (1, 2, 3) for i in range(4)], SCHEMA)
    changes = spark.createDataFrame(
        [change(1, 1, False, "edited", 1), change(1, 1, False, "again", 2), change(1, 4, True, "new", 1), change(2, 1, False, None, 1, "delete"), change(2, None, None, None, 1, "branch", 9, 1), change(3, None, None, None, 1, "rename", 8),
         change(1, None, None, None, 1, "rename", 2), change(1, None, None, None, 1, "odd", 5)], CHANGE)
    now = said(refresh.applied(rows, refresh.typed(changes)))
    assert now == [(1, 0, "10"), (1, 1, "again"), (1, 2, "12"), (1, 3, "13"), (1, 4, "new"), (2, 0, "20"), (2, 1, "22"), (2, 2, "23"), (8, 0, "30"), (8, 1, "31"), (8, 2, "32"), (8, 3, "33"), (9, 0, "20"), (9, 1, "22")]
    old = spark.createDataFrame([(c, 1, 2 * k, 2 * k + 1, False, "t", "h") for c in (1, 2, 3) for k in range(2)], refresh.ENTRIES)
    kept = refresh.surviving(old, rows, None, refresh.typed(changes))
    assert sorted((r.conv_id, r.start_id) for r in kept.collect()) == [(8, 0), (8, 2)]  # the edits of 1 and 2 came before all their entries' ends


def test_commits(spark, tmp_path):
    store = Buckets(spark, str(tmp_path), {"t": "conv_id long, v string"}, 4)
    table = lambda *rows: spark.createDataFrame(list(rows), "conv_id long, v string")
    one = table(*((k, "a") for k in range(20)))
    assert store.last() == -1 and store.read("t").count() == 0
    assert store.commit(0, {"t": one}, store.touched(one))
    some = store.touched(table((3, "")))
    inside = [r.conv_id for r in one.filter(store.bucket() == some[0]).collect()]
    # a job that fails before its commit is named leaves nothing to be seen, and may run again
    table((3, "lost")).withColumn("bucket", store.bucket()).write.partitionBy("bucket").parquet(f"{tmp_path}/t/1")
    assert {r.v for r in store.read("t").collect()} == {"a"}
    assert store.commit(1, {"t": table((3, "b"))}, some)
    assert not store.commit(1, {"t": table((3, "c"))}, some) and not store.commit(0, {"t": one}, some)
    assert sorted((r.conv_id, r.v) for r in store.read("t").collect()) == sorted([(3, "b")] + [(k, "a") for k in range(20) if k not in inside])
    assert all(f"bucket={some[0]}" in f for f in store.read("t", some).inputFiles())
    assert store.commit(2, {"t": table()}, some) and store.read("t", some).count() == 0
    before = said_of(store)
    store.cleaned()
    assert said_of(store) == before and not list((tmp_path / "t/1").glob("bucket=*"))


def said_of(store):
    return sorted((r.conv_id, r.v) for r in store.read("t").collect())


def test_refresh_equals_the_batch_job(spark, tmp_path):
    """Logs that arrive in random parts, with edits: the entries are those of one pass over what the logs are at the end."""
    params = Params(window_size=1, turns_per_chunk=2, group_1=2, group_n=2, chunk_chars=1000)
    rnd, parts = random.Random(4), [[], []]
    for c in range(9):
        for i in range(rnd.randint(7, 13)):
            parts[min(1, i // 7)].append(change(c, i, i % 2 == 0, "y" * rnd.choice([5, 300]), 0))
        parts[1].append(change(c, rnd.randint(0, 3), None, "edited", 9)[:2] + (False, False, "n", "edited", 9, "row", None, None))
    job = refresh.Refresher(spark, str(tmp_path / "a"), params, max_chunks=2, buckets=3)
    for k, part in enumerate(parts):
        batch = spark.createDataFrame(part, CHANGE)
        job(batch, k if k == 0 else job.store.last() + 1)
        job(batch, job.store.last())  # runs again: nothing changes
        job.drained()
    once = refresh.Refresher(spark, str(tmp_path / "b"), params, max_chunks=None, buckets=3)
    once(job.store.read("rows").selectExpr("*", "0L changed_at", "'row' kind", "null::long new_id", "null::long upto"), 0)
    once.drained()
    shown = lambda s: sorted((r.conv_id, r.level, r.start_id, r.end_id, r.text) for r in s.read("entries").collect())
    assert shown(job.store) == shown(once.store) and len(shown(job.store)) >= 3


def test_publish(spark, tmp_path):
    store = Buckets(spark, str(tmp_path), {"rows": refresh.ROWS, "entries": refresh.ENTRIES}, 4)
    rows = spark.createDataFrame([(c, i, i % 2 == 0, False, "n", f"{c}{i}") for c in (1, 2, 3) for i in range(4)], SCHEMA)
    ranges = spark.createDataFrame([(c, 2 * k, 2 * k + 1) for c in (1, 2, 3) for k in range(2)], "conv_id long, start_id long, end_id long")
    hashed = lineage.range_hashes(rows, ranges)
    old = hashed.selectExpr("conv_id", "1 level", "start_id", "end_id", "false deleted", "'old' text", "source_hash")
    store.commit(0, {"rows": rows, "entries": old}, [0, 1, 2, 3])
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "conv_id long, owner string")
    new = old.filter("start_id = 2").withColumn("text", F.lit("new")).join(lineage.frontier_signature(old), "conv_id")
    new = new.withColumn("owner", F.expr("element_at(array('a', 'other', 'c'), int(conv_id))")).withColumn("source_hash", F.expr("if(conv_id = 3, 'stale', source_hash)"))
    done, refused = refresh.publish(store, 1, new, owners)
    assert done and sorted(r.conv_id for r in refused.collect()) == [2, 3]
    texts = lambda: sorted((r.conv_id, r.start_id, r.text) for r in store.read("entries").collect())
    want = [(c, s, "new" if (c, s) == (1, 2) else "old") for c in (1, 2, 3) for s in (0, 2)]
    assert texts() == want
    assert not refresh.publish(store, 1, new, owners)[0] and not refresh.publish(store, 2, new.filter("conv_id > 1"), owners)[0]
    assert texts() == want and store.last() == 1


def test_assembly(spark, tmp_path):
    """Pieces cut anywhere and out of turn; streams that close, break, stay open, and pieces behind an end."""
    body = {
        1: 'data: {"choices":[{"delta":{"content":"é"}}]}\r\n\r\n: note\n\nevent: message-end\ndata: {}\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n\n',
        2: 'data: {"choices":[{"delta":{"content":"open"}}]}\n\n',
        3: "data: {oops\n\ndata: [DONE]\n\n",
        4: "data: 1\ndata: 2\n\n",
        5: "data: " + "x" * 300 + "\n\n",
        6: 'data: {"choices":[{"delta":{"content":"whole"}}],"finish_reason":"stop"}\n\n',
    }
    rnd, rows = random.Random(2), []
    for c, text in body.items():
        cuts = sorted(rnd.sample(range(1, len(text)), 5))
        rows += [(c, k, text[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
    rnd.shuffle(rows)
    parts = [rows[::2], rows[1::2], [(1, 6, "data: [DONE]\n\n")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "conv_id long, seq long, piece string").write.mode("append").parquet(f"{tmp_path}/source")
        with state_provider(spark):
            stream = spark.readStream.schema("conv_id long, seq long, piece string").parquet(f"{tmp_path}/source")
            told = assembly.assembled(stream, 1, 250)
            query = told.writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/progress").trigger(once=True).start()
            query.awaitTermination()
        if k == 1:
            time.sleep(2)  # the open ones fall silent
    told = spark.read.parquet(f"{tmp_path}/told")
    assert {(r.conv_id, r.response) for r in assembly.completions(told).collect()} >= {(1, "é"), (6, "whole")}
    states = {}
    for r in told.collect():
        states.setdefault(r.conv_id, set()).add(r.status)
    assert states[1] == {"closed", "late"} and states[2] == {"ended"} and states[3] == {"unreadable"} and states[4] == {"unreadable"} and states[5] == {"too long"} and states[6] == {"ended"}
    assert {r.status: r.n for r in assembly.rejects(told).collect()} == {"late": 1, "unreadable": 2, "too long": 1}
    assert 2 not in {r.conv_id for r in assembly.completions(told).collect()}


def test_events_in():
    assert assembly.events_in("event: a\ndata:1\ndata: 2\n\n:c\n\ndata: x\r\rdata: y") == ([("a", "1\n2"), ("message", "x")], "data: y")
    assert [assembly.ends_stream("message", d) for d in ("[DONE]", "{}", "{", '{"type":"message_stop"}', '{"done":true}', '{"done":1}', "5")] == [True, False, None, True, True, False, False]
    assert assembly.ends_stream("message-end", "{}")
