"""Alignment of tokenizers against whole texts encoded by the libraries themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from convlog.llm import alignment
from convlog.llm.alignment import align_tokenizers, inverted, op13_tokenizer_alignment, pair_counts, places_of

FILES = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(texts):
    """Per document: the numbers and the digest, pair by pair; and the counts of pairs."""
    a, b = Tokenizer.from_buffer(FILES[0]), SentencePieceProcessor(model_proto=FILES[1])
    a.encode_special_tokens = True
    pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    groups = []
    for t in texts:
        groups.append([])
        if not t:
            continue
        whole = (" " + t).encode()
        x = a.encode(" " + t, add_special_tokens=False)
        y = b.encode(t)
        if b"".join(bytes_b[k] for k in y) != whole:
            continue
        # character offsets of A cut characters of several bytes: recover bytes by decoding each id's entry
        lengths = [len(alignment._pair(*FILES).bytes_a[k]) for k in x.ids]
        ends_a, ends_b = np.cumsum(lengths), np.cumsum([len(bytes_b[k]) for k in y])
        i = j = 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = int(np.searchsorted(ends_a, e)) + 1, int(np.searchsorted(ends_b, e)) + 1
            groups[-1].append((x.ids[i:k], y[j:m]))
            i, j = k, m
    links = [Counter((p, q) for ga, gb in g for p in ga for q in gb) for g in groups]
    count = Counter(p for c in links for p in c)
    top = {}
    for (p, _), n in count.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for g, c in zip(groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        best = sum(n for p, n in c.items() if count[p] == top[p[0]])
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out, count, sum(links, Counter())


def told(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def texts():
    rnd = random.Random(2)
    words = ["the", "The", "naïve", "日本語", "don't", "x=1;", "1234567", "supercalifragilistic", " ", "a　b", "<|endoftext|>", "<s>", "\U0001f600", "zzzzqqqq", "é", "\x1c"]
    gaps = [" "] * 8 + ["  ", "\n", "\t ", "\n\n  ", "  ", "  ", " \x85 "]
    prose = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n))
    odd = [None, "", " ", "  ", "a ", " a", "a  ", "\n", "a▁b", "▁", "word" * 300, "a" * 700, "日" * 300, "\x00 a\x00b", "x " * 900]
    return odd + [prose(rnd.randint(1, 60)) for _ in range(60)] + [prose(3000)]


def test_alignment(spark, monkeypatch):
    t = texts()
    df = spark.createDataFrame([(k if k % 7 else None, x, "en", "s", 0) for k, x in enumerate(t)], SCHEMA)
    df = df.union(df.limit(1)).selectExpr("*", *(f"'x' {c}" for c in ("block", "place", "doc", "pair", "docs", "planes", "id", "n", "n_docs"))).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, count, links = plain([x for _, x in rows])
    got = align_tokenizers(df, *FILES).collect()
    assert sorted([(i or -1, *w) for (i, _), w in zip(rows, want, strict=True)]) == sorted((r.doc_id or -1, *told(r)) for r in got)
    counted = {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r.n_docs, r.n_links) for r in pair_counts(inverted(df, *FILES)).collect()}
    assert counted == {p: (count[p], links[p]) for p in count}
    assert align_tokenizers(df.filter(F.lit(False)), *FILES).count() == 0


def test_bitmaps():
    rnd = random.Random(5)
    lists = [sorted(rnd.sample(range(alignment.DOCUMENTS), n)) for n in (0, 1, 5, 4095, 4096, 30_000, 0, 2)]
    flat = np.array([x for part in lists for x in part], np.uint16)
    row, place = places_of(alignment._binary(flat, np.array([len(x) for x in lists])))
    assert sorted(zip(row.tolist(), place.tolist(), strict=True)) == [(k, x) for k, part in enumerate(lists) for x in part]


def test_blocks_and_memory(monkeypatch):
    """Many small blocks and a memory that forgets give the same postings."""
    t = [x or "" for x in texts()]
    want, count, links = plain(t)
    tool, seen, total = alignment.Pair(*FILES), Counter(), Counter()
    monkeypatch.setattr(alignment, "KNOWN", 20)
    for lo in range(0, len(t), 7):
        block, part = alignment.Block(), t[lo : lo + 7]
        alignment._documents(tool, pa.RecordBatch.from_pydict({"doc": [""] * len(part), "text": part}), block, 0)
        for pair, n_docs, n_links, docs, planes in block.bitmaps():
            assert pc_sizes(docs) == n_docs.tolist()
            for p, n, m in zip(pair.tolist(), n_docs.tolist(), n_links.tolist(), strict=True):
                seen[p >> 32, p & 0xFFFFFFFF] += n
                total[p >> 32, p & 0xFFFFFFFF] += m
    assert (seen, total) == (count, links)


def pc_sizes(docs):
    return np.bincount(places_of(docs)[0], minlength=len(docs)).tolist()


def test_query(spark, tmp_path):
    rows = [(k, x, "en", "s", 0) for k, x in enumerate(texts()[:30])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: told(r) for r in op13_tokenizer_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(plain([r[1] for r in rows])[0]))
