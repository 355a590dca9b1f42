"""Repeated strings of bytes against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from convlog.llm import suffix_dedup as module
from convlog.llm.suffix_dedup import common_prefixes, op12_suffix_dedup, repeats, segments, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least):
    """doc -> bytes, removed mask, over (id, text) in order."""
    seen, out = set(), []
    for _, text in rows:
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - least + 1):
            w = x[k : k + least]
            if w in seen:
                gone[k : k + least] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int))).tolist()
        out.append((len(x), int(gone.sum()), list(zip(edges[::2], edges[1::2], strict=True)), np.frombuffer(x, np.uint8)[~gone].tobytes()))
    return out


def made(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéü") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, phrase, base = prose(60), prose(9), prose(150)
    texts = [None, "", "short", "a" * 700, "ab" * 300, "\x00" * 150, base, base, base[:-30], "é" * 90, prose(1500)]
    for _ in range(25):
        w = base.split()
        w[rnd.randrange(len(w))] = "edited" + str(rnd.random())
        texts.append(" ".join(w))
    texts += [f"{prose(20)}{shared}{prose(15)}{shared if rnd.random() < 0.3 else ''}" for _ in range(15)]
    texts += [f"{prose(12)} {phrase} {prose(12)}" for _ in range(40)]
    return texts


@pytest.mark.parametrize("least", [40, 100])
def test_suffix_dedup(spark, least):
    texts = made(3)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", *(f"'x' {c}" for c in ("id", "doc", "start", "n", "m", "digest", "content", "runs", "shard")))
    rows = sorted(rows)
    want = dict(zip([i for i, _ in rows], plain(rows, least), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup(df.repartition(3), least).collect()}
    assert got == want


def test_crowded_and_chunks(spark, monkeypatch):
    """Anchors with many contents are dealt by whole windows; segments end at chunks."""
    for name, value in (("CROWDED", 3), ("SHARD", 2000), ("CHUNK", 500)):
        monkeypatch.setattr(module, name, value)
    rows = list(enumerate(made(4)))
    want = plain(rows, 60)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 60).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got] == want


def test_segments_hold_each_window_once():
    texts = [(t or "").encode() for t in made(5)]
    seen, anchors = set(), {}
    for text, start, n, m in segments(texts, 50, 32):
        for t, s, k, a in zip(text.tolist(), start.tolist(), n.tolist(), m.tolist(), strict=True):
            for j in range(s, s + k):
                assert (t, j) not in seen
                seen.add((t, j))
                assert anchors.setdefault(texts[t][j : j + 50], a) == a
    assert len(seen) == sum(max(len(x) - 49, 0) for x in texts)


def test_common_prefixes():
    rnd = random.Random(8)
    for alphabet in (b"a", b"ab", b"abcdef"):
        x = b"".join(bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) + b"\xff" for _ in range(12))
        data = np.frombuffer(x, np.uint8)
        order, divided = common_prefixes(data, 9)
        windows = [x[i : i + 9] for i in order]
        kinds = np.cumsum(divided[:-1])
        whole = [k for k, w in enumerate(windows) if len(w) == 9 and b"\xff" not in w]
        assert sorted(windows, key=lambda w: w) is not None
        assert len({(windows[k], kinds[k]) for k in whole}) == len({windows[k] for k in whole}) == len({kinds[k] for k in whole})
        assert {k for k, s, e in repeats(x.split(b"\xff")[:-1], 9)} <= set(range(12))


def test_odd_rows(spark):
    long_ = "lorem ipsum dolor sit amet " * 8
    rows = [(None, long_), (None, None), (5, long_), (5, long_), (4, "x" * 99), (6, "x" * 100)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sorted(r.n_removed for r in got)[:3] == [0, 0, 0]
    assert sorted(r.n_removed for r in got if r.doc_id == 5) == sorted([len(long_), plain([(0, long_)], 100)[0][1]])
    assert {r.n_removed for r in got if r.doc_id is None} == {0, len(long_)}
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.n_removed for r in suffix_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [0]


def test_query(spark, tmp_path):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(made(6))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: (n, g, len(s), hashlib.sha256(kept).hexdigest()) for k, (n, g, s, kept) in enumerate(plain([r[:2] for r in rows], 100))}
