"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest

from convlog.llm.whitening import op11_whitening, whitening


def plain(rows, components=32):
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    m = np.array(list(x.values()), dtype=object)
    n, total = len(m), m.sum(0)
    deviation = {i: int(sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True))) for i, v in x.items()}
    centred = (n * m - total).astype(float) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-e)[:components] if e[k] > e.max() * len(e) * 1e-15]
    return list(x), n, deviation, centred @ axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(cov)


def check(got, rows, components=32):
    ids, n, deviation, white, explained = plain(rows, components)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == white.size
    for c in range(white.shape[1]):
        mine = np.array([table[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ white[:, c])
        assert np.abs(mine * sign - white[:, c]).max() < 1e-8
        assert table[ids[0], c + 1].explained == pytest.approx(explained[c], rel=1e-9)
    assert all((r.n, int(r.deviation)) == (n, deviation[r.vec_id]) and r.identity_error < 1e-9 for r in got)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(1500, 40)) * np.linspace(0.5, 3, 40)).astype(np.float32)  # more than one block of rows
    rows = [(k, [float(x) for x in v[k]]) for k in range(1500)]
    bad = [(2000, None), (2001, [float("nan")] * 40), (2002, [None] * 40), (2003, [float("inf"), *[0.0] * 39]), (2004, [1.0] * 3), (2005, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", *(f"'x' {c}" for c in ("id", "index", "values", "n", "x", "k", "component", "whitened")))
    check(whitening(df.repartition(3)).collect(), rows)
    check(whitening(df, components=5).collect(), rows, 5)


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(None, []), (2, [])]):  # no direction varies
        assert whitening(make(rows)).count() == 0
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 2.0]), (3, [-1.0, 2.0])]  # one dimension is constant
    got = whitening(make(rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (1, 1), (1, 1), (3, 1)]
    assert sum(r.whitened for r in got) == pytest.approx(0, abs=1e-12) and sum(r.whitened**2 for r in got) == pytest.approx(4)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for k in range(60)]
    spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op11_whitening(spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint"
    check(out.collect(), rows)
