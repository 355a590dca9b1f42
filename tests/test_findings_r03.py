"""What a review found: each test failed before."""

import os
import random

import duckdb
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from convlog.llm import ngram_join as module
from convlog.llm import substring_dedup, toxicity
from convlog.llm.ngram_join import ngram_join, shingle_sets
from convlog.operators import lorebook, rollup
from convlog.plans import catalog
from convlog.streaming.open_chunks import OpenChunks
from test_oracle import rows


def test_breakdown_of_long_ids(spark, tmp_path):
    """The length of the summary that goes with an id of three digits and more."""
    said = [(c, t, r, x * 9) for c in (7, 99, 100, 107, 1234567) for t, r, x in ((0, "system", "rules "), (1, "user", "ask "), (2, "assistant", "told "), (3, "tool", " 天地😀 "), (4, "user", " "))]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    name = "a16_message_breakdown"
    assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(db.execute(catalog.SQL[name]).df())


def test_links_inside_a_group_alone(spark):
    """Three sets of one prefix and size, the first of which isn't like the other two, and no other text like them."""
    rnd = random.Random(4)
    one = [f"w{rnd.randrange(10**6)}" for _ in range(43)]
    two = [*one[:20], "x1", "x2", *one[22:]]
    texts = [" ".join(x) for x in (one, two, [*two[:-1], "last"])]
    a, b, c = shingle_sets(pa.array(texts), 4)
    assert len(a) == len(b) == len(c) == 40 and list(a[:7]) == list(b[:7]) == list(c[:7])
    got = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 1}


def test_roll_ups_read_their_input_once(spark):
    """No level is worked out again for the next, and none shares a task with another's sort."""
    counts = spark.range(5).selectExpr("id as conv_id", "id * 7 as n")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    closed = rollup.closed_frontier(counts, 2, 2, 8)
    assert plan(closed).count("Range (") == 1
    e = counts.selectExpr("conv_id", "1 as level", "explode(sequence(1, n)) as start_id").selectExpr("*", "start_id as end_id", "false as deleted", "'t' as text", "'h' as source_hash")
    live = rollup.roll_up(e.filter("start_id > 0"), 2, 2)
    assert "Window" not in plan(live) and "Range (" not in plan(live)
    nodes = lambda df: {r[0]: r[1] for r in df.filter("conv_id > 0").groupBy("conv_id").count().collect()}
    assert nodes(live) == nodes(closed)


def test_keys_are_decided_by_words(spark, monkeypatch):
    """Keys of one word need no look at the texts; words' ends count where the key asks for them."""
    said = {1: "ata in stein", 2: "a b", 3: "two wordsmith", 4: "The Two words", 5: "x-two words-y", 6: "天地 a天 ", 7: "atwo wordsb"}
    texts = spark.createDataFrame(list(said.items()), "text_id long, text string")
    raw = ["a", "A", "in", "two words", "words-y", "-y", "天", "Two", "o words", "x-"]
    keys = spark.createDataFrame([(r, cased, whole) for r in raw for cased in (False, True) for whole in (False, True)], "raw string, cased boolean, whole boolean")

    def found(text, key, cased, whole):
        if not cased:
            text, key = text.lower(), key.lower()
        loose = not whole or " " in key or "天" in key
        at = [i for i in range(len(text)) if text.startswith(key, i)]
        word = lambda x: x.isalnum() or x == "_"
        return any(loose or not ((i and word(text[i - 1])) or (i + len(key) < len(text) and word(text[i + len(key)]))) for i in at)

    want = sorted((i, k.raw, k.cased, k.whole) for i, t in said.items() for k in keys.collect() if found(t, k.raw, k.cased, k.whole))
    assert sorted(map(tuple, lorebook.key_hits(texts, keys).collect())) == want
    real, seen = lorebook.key_matches, []
    monkeypatch.setattr(lorebook, "key_matches", lambda text, needle, whole: seen.append(1) or real(text, F.raise_error(needle).cast("string"), whole))
    one = keys.filter("raw in ('a', 'in') and not cased")
    assert lorebook.key_hits(texts, one).count() == sum(r in ("a", "in") and not c for _, r, c, _ in want) and seen


def test_windows_in_parts(spark, monkeypatch):
    """op9: windows are verified in parts, so that no shuffle has all of them; the rows are those of one part."""
    rnd = random.Random(9)
    texts = [[f"w{rnd.randrange(400)}" for _ in range(80)] for _ in range(30)]
    for k in range(1, 30):
        texts[k][10 : 10 + 5 * (k % 9)] = texts[k - 1][10 : 10 + 5 * (k % 9)]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    starts, want = {}, []
    for k, x in enumerate(texts):
        gone = {j for at in range(68) if starts.setdefault(tuple(x[at : at + 13]), k) < k for j in range(at, at + 13)}
        want.append((k, len(gone)))
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 1)
    kept, sizes = substring_dedup.stored, []

    def stored(df, label, **more):
        out = kept(df, label, **more)
        if label in ("substring-windows", "substring-found"):
            sizes.append((label, out.count()))
        return out

    monkeypatch.setattr(substring_dedup, "stored", stored)
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(df)[0].collect()) == want
    assert sum(n for _, n in want) > 100 and sum(label == "substring-found" and n > 0 for label, n in sizes) > 4


def test_pairs_in_parts(spark, monkeypatch):
    """op4: pairs are joined in parts, so that no shuffle has all of them; scores are those of pairs sent to the tasks."""
    rnd = random.Random(3)
    texts = [(k, " ".join(f"{'bad' if k % 4 == 0 and rnd.random() < 0.3 else 'w'}{rnd.randrange(60)}" for _ in range(30))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in texts], "doc_id long, toxic int")
    kept, parts = toxicity.stored, []

    def stored(df, label, **more):
        out = kept(df, label, **more)
        if label in ("kn-pairs", "toxicity-sums"):
            parts.append((label, out.count()))
        return out

    monkeypatch.setattr(toxicity, "stored", stored)
    scores = [sorted((r.doc_id, round(r.ratio, 8)) for r in toxicity.score_toxicity(docs, labels, slots=n).collect()) for n in (22, 5)]
    assert scores[0] == scores[1] and len({x for _, x in scores[0]}) > 250
    for label in ("kn-pairs", "toxicity-sums"):
        assert sum(x == label and n > 0 for x, n in parts[len(parts) // 2 :]) >= 4


def test_large_buckets_in_parts(spark, monkeypatch):
    """op8: texts with one long passage and few words of their own, many apart: parts of their bucket come before all its pairs."""
    rnd = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"x{rnd.randrange(3)}" for _ in range(6))]) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts), 4)]
    least = list(range(90))
    links = [(a, b) for a in range(90) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 96 * len(sets[a] | sets[b])]
    for _ in range(90):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    kept, rounds = module.stored, []

    def stored(frame, label, **more):
        out = kept(frame, label, **more)
        if label == "shingle-likely":
            rounds.append(out.count())
        return out

    monkeypatch.setattr(module, "SAMPLE", 6)
    monkeypatch.setattr(module, "stored", stored)
    got = {r.doc_id: r.component_id for r in ngram_join(df, percent=96).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) > 5 and links
    assert len(rounds) > 2  # leaders, parts, and what is left


def test_few_rows_carry_sketches(spark, monkeypatch):
    """op8: rows of small buckets come together without sketches, and what no later job reads goes from the shared folder."""
    rnd = random.Random(11)
    passages = [[f"v{rnd.randrange(300)}" for _ in range(12)] for _ in range(20)]
    texts = [[x for p in rnd.sample(passages, 4) for x in p] for _ in range(60)]
    for k in range(40, 60):
        texts[k] = [*texts[k - 30][: rnd.randrange(44, 48)], f"y{k}"]
    many = [[*passages[0], *passages[1], *passages[2], *(f"x{rnd.randrange(3)}" for _ in range(6))] for _ in range(25)]
    texts = [" ".join(x) for x in texts + many]
    sets = [set(s.tolist()) for s in shingle_sets(pa.array(texts), 4)]
    least = list(range(len(texts)))
    links = [(a, b) for a in least for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    kept, wide, paths = module.stored, [], []

    def stored(frame, label, **more):
        out = kept(frame, label, **more)
        paths.extend((label, file.rpartition("/")[0].removeprefix("file://")) for file in out.inputFiles()[:1])
        if label.startswith("shingle") and "sketch" in out.columns and label not in ("shingle-prefixes", "shingle-nodes"):
            of = out.groupBy("token").count().agg(F.min("count"), F.count("*")).first()
            wide.append(of)
        return out

    monkeypatch.setattr(module, "stored", stored)
    got = ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(least)) and links and len(set(least)) > 30
    assert wide and all(n == 0 or smallest > 16 for smallest, n in wide)
    left = {label for label, path in paths if os.path.exists(path)}
    assert not left & {"shingle-slots", "shingle-prefixes", "shingle-nodes", "shingle-groups", "shingle-index", "shingle-rest", "shingle-many", "shingle-mixed", "shingle-tops"}


def test_open_chunks_ask_states_little(spark):
    """r2: calls of states and frames a log cost more than its rows; a known log asks twice and a new one once."""
    calls = []

    class State:
        def __init__(self, name, value=None):
            self.name, self.value = name, value

        def __getattr__(self, call):
            def act(*new):
                calls.append((self.name, call))
                self.value = new[0] if call in ("update", "put") else None if call == "clear" else self.value
                return (self.value or iter(())) if self.name == "early" and call == "get" else self.value

            return act

    chunks = OpenChunks(1, 100, None)
    chunks.open, chunks.early = State("open"), State("early")
    row = lambda i, user: Row(message_id=i, is_user=user, is_system=False, chars=5, new_phase=False)
    tell = lambda *rows: [tuple(r) for r in chunks.handleInputRows((7,), iter(rows), None)]
    assert tell(row(0, True), row(3, False)) == []
    assert calls == [("open", "get"), ("open", "update"), ("early", "put")]
    calls.clear()
    assert tell(row(2, True), row(1, False)) == [(7, "closed", 0, 0, 1), (7, "closed", 1, 2, 3)]
    assert calls == [("open", "get"), ("early", "get"), ("open", "update"), ("early", "clear")]
    assert tell(row(1, True)) == [(7, "rebuild", None, 1, None)] and tell(row(9, True)) == [(7, "rebuild", None, 9, None)]


def test_shared_steps_are_stored(spark):
    """x9, a19: logs are numbered and streams put together once, not again for each of what is made of them."""
    for name in ("x9_regenerated", "a19_stream_completion"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan, name
