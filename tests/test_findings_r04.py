"""What a review found: each test failed before."""

import random
import re

import duckdb
from pyspark.sql import functions as F
from test_oracle import rows

from convlog.operators import rollup, usage
from convlog.plans import catalog


def test_streams_of_any_length(spark, tmp_path):
    """a19 (F1): a stream of over 2 MiB is put together like any other."""
    said = [(c, t, "user" if t % 2 else "assistant", "x") for c, n in ((0, 30_000), (1, 3), (4, 2), (6, 2)) for t in range(n)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    name = "a19_stream_completion"
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert sorted(got.conv_id) == [0, 1, 4] and rows(got) == rows(db.execute(catalog.SQL[name]).df())


def test_streams_cut_anywhere(spark, monkeypatch):
    """s12, a19 (F1): events and their numbers are those of the whole text, wherever chunks end, and of a long one too."""
    rnd, pieces, want = random.Random(12), [], []
    tokens = ["data: a", "data:  b😀", "event: e", ": c", "data:", "x", "\n", "\r", "\r\n", "\n\n", "\r\r", "\r\n\r\n", "\n\n\n", "\r\n\n"]
    for c in range(120):
        whole = "".join(rnd.choice(tokens) for _ in range(rnd.randrange(40)))
        if c == 0:
            whole = f"data: {'y' * 1_200_000}\n\n" * 2 + whole
        cuts = sorted(rnd.randrange(len(whole) + 1) for _ in range(rnd.randrange(25)))
        mine = [(c, k, whole[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(whole)], strict=True))]
        mine.append((c, rnd.choice([None, len(mine)]), None))
        pieces += rnd.sample(mine, len(mine))
        for no, block in enumerate(re.split(r"\r\n\r\n|\n\n|\r\r", whole)):
            lines = re.split(r"\r\n|\n|\r", block)
            data = "\n".join(re.sub("^data: ?", "", x) for x in lines if x.startswith("data:"))
            if data:
                want.append((c, no, [*(re.sub("^event: ?", "", x) for x in ["event: message", *lines] if x.startswith("event:"))][-1], data))
    df, known = spark.createDataFrame(pieces, "conv_id long, seq long, piece string").repartition(5), []
    for unit in (1, 20, 1 << 16):
        monkeypatch.setattr(usage, "UNIT_BYTES", unit, raising=False)
        got = usage.stream_events(df)
        known.append(sorted(map(tuple, got.collect())))
    assert got.dtypes == [("conv_id", "bigint"), ("no", "int"), ("event", "string"), ("data", "string")]
    assert known == [sorted(want)] * 3 and len(want) > 200


def test_frontiers_of_any_depth(spark, tmp_path):
    """w13 (F2): a long log's upper levels are all there, in the query as in its SQL, and its nodes cover every chunk."""
    kinds = ["view", "purchase"]
    said = [(k, 1_000 * u + k, u, kinds[k % 2], "{}") for u, n in ((1, 9_000), (2, 5)) for k in range(n)]
    events = spark.createDataFrame(said, "at long, event_id long, user_id long, event_type string, props string").withColumn("ts", F.timestamp_seconds("at"))
    events.drop("at").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    name = "w13_closed_frontier"
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(db.execute(catalog.SQL[name]).df())
    long = sorted((r.first, r.last) for r in got.itertuples() if r.conv_id == 1)
    assert got.level.max() > 8 and long[0][0] == 0 and long[-1][1] == 2249 and all(b[0] == a[1] + 1 for a, b in zip(long, long[1:]))


def test_frontiers_like_a_loop(spark):
    """w13 (F2): for any number of entries and groups; a level that is the last one keeps all its nodes, as in roll_up."""
    sizes = [0, 1, 2, 3, 7, 61, 1000, 100_003, 10**12, 2**53 + 1, 2**62, 2**63 - 1]
    counts = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)] + [(-1, None)], "conv_id long, n long")
    for group_1, group_n, levels in ((2, 2, None), (10, 5, None), (3, 7, 4), (100, 100, None), (1, 2, None), (2, 2, 1), (4, 1, 40), (1, 1, None)):
        few = group_n == 1 or levels
        want = []
        for k, n in enumerate(sizes[:7] if few else sizes):
            level, width, c = 1, 1, n
            while c > 0:
                cap = group_1 if level == 1 else group_n
                above = 0 if level == levels else (c - 1) // cap
                want += [(k, level, j * width, (j + 1) * width - 1) for j in range(above * cap, c)]
                level, width, c = level + 1, width * cap, above
        got = rollup.closed_frontier(counts.filter(f"conv_id < {7 if few else 99}"), group_1, group_n, levels)
        assert got.dtypes == [("conv_id", "bigint"), ("level", "int"), ("first", "bigint"), ("last", "bigint")]
        assert sorted(map(tuple, got.collect())) == sorted(want), (group_1, group_n, levels)
