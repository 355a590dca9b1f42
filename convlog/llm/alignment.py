"""Alignment of two tokenizers over a corpus, with inverted bitmaps of pairs.

A task cuts texts into units that both tokenizers encode by themselves and aligns each distinct unit once: tokens of
either side form a group wherever both end at the same byte, and all pairs in a group are linked. Documents are dealt
into blocks of bounded size and numbered inside them. An inverted row is (block, pair): a compressed bitmap of the block's
documents that hold the pair linked, and planes of its multiplicity, bitmaps of the documents whose number of further
links has a given bit. Bitmaps of the same block are merged before they are written; those of different blocks share no
document, so a pair's documents are the sum of what its bitmaps count, and the planes give its links. The postings then
carry the counts back to the documents of their blocks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import settings, stored, table
from convlog.llm.tokenize import slices

KNOWN = 300_000  # units that a Python worker remembers
POSTINGS = 4_000_000  # of a block, about
DOCUMENTS = 1 << 16  # of a block at most: places are 16 bits
DENSE = DOCUMENTS // 8  # bytes of a plain bitmap; shorter ones are lists of places
UNITS_AT_ONCE = 20_000
PLACES = "block long, place int"
ROW = f"{PLACES}, doc string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n_docs int, pair_links long, docs binary, planes array<binary>"
B_BITS = 32  # of a pair, for the second id


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable characters stand for themselves, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers and the units aligned so far: A of the tokenizers library (byte level, no normaliser), B of
    sentencepiece (adds a blank in front, changes no white space). Units are whole texts where a piece of B joins words."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        alphabet = _byte_of()
        added = {k: t.content.encode() for k, t in self.a.get_added_tokens_decoder().items()}
        entries = {k: v for v, k in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [added[k] if k in added else bytes(alphabet.get(c, 0) for c in entries.get(k, "")) for k in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.texts: list[str | None] = []  # groups as text; None: the bytes of a side differ
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, units: list[bytes]) -> np.ndarray:
        """Where the tables have these distinct units."""
        if len(self.texts) > KNOWN:
            self.forget()
        new = [u for u in units if u not in self.place]
        for lo in range(0, len(new), UNITS_AT_ONCE):
            self._align(new[lo : lo + UNITS_AT_ONCE])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def _align(self, units: list[bytes]) -> None:
        text = [u.decode() for u in units]
        a = [x.ids for x in self.a.encode_batch_fast(text, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in text], num_threads=1)
        b = [self.blank if t == " " else ids for t, ids in zip(text, b, strict=True)]
        same = [b"".join(map(self.bytes_a.__getitem__, x)) == u == b"".join(map(self.bytes_b.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)]
        a, b = [x if ok else [] for x, ok in zip(a, same, strict=True)], [y if ok else [] for y, ok in zip(b, same, strict=True)]
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        flat_a, flat_b = np.array([i for x in a for i in x], np.int64), np.array([i for y in b for i in y], np.int64)
        ends_a = np.cumsum(np.fromiter((len(self.bytes_a[i]) for i in flat_a), np.int64, len(flat_a)))
        ends_b = np.cumsum(np.fromiter((len(self.bytes_b[i]) for i in flat_b), np.int64, len(flat_b)))
        shared = np.intersect1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)  # the group of each token
        owner = np.zeros(len(shared), np.int64)
        owner[of_a] = np.repeat(np.arange(len(units)), n_a)
        per_a, per_b = np.bincount(of_a, minlength=len(shared)), np.bincount(of_b, minlength=len(shared))
        n_groups = np.bincount(owner, minlength=len(units))
        links = np.bincount(owner, per_a * per_b, minlength=len(units)).astype(np.int64)
        sizes = np.stack([n_a, n_b, n_groups, links], axis=1)
        pairs, times, unit = _linked(flat_a, of_a, flat_b, of_b, owner, len(shared))
        said = _said(flat_a.tolist(), np.cumsum(per_a).tolist(), flat_b.tolist(), np.cumsum(per_b).tolist())
        ends = np.cumsum(n_groups).tolist()
        base = len(self.texts)
        self.place.update(zip(units, range(base, base + len(units)), strict=True))
        self.texts += [";".join(said[e - n : e]) if ok else None for ok, e, n in zip(same, ends, n_groups.tolist(), strict=True)]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(unit, minlength=len(units)))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])


def _said(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> list[str]:
    """Each group as text."""
    a, b, out, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
    for k, m in zip(ends_a, ends_b, strict=True):
        out.append(f"{a[i] if k == i + 1 else ','.join(a[i:k])}|{b[j] if m == j + 1 else ','.join(b[j:m])}")
        i, j = k, m
    return out


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id), sorted, and how often each occurs."""
    keys, n = np.unique(group << B_BITS | ids, return_counts=True)
    return keys >> B_BITS, keys & ((1 << B_BITS) - 1), n


def _linked(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, owner: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, links, unit: the distinct pairs of each unit, by unit. Equal tokens of a group are counted before they are paired."""
    g_a, id_a, n_a = _counted(of_a, a)
    g_b, id_b, n_b = _counted(of_b, b)
    per_b = np.bincount(g_b, minlength=groups)
    first_b = np.cumsum(per_b) - per_b
    many = per_b[g_a]
    of = np.repeat(np.arange(len(g_a)), many)
    at = first_b[g_a[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    pair, times, unit = id_a[of] << B_BITS | id_b[at], n_a[of] * n_b[at], owner[g_a[of]]
    order = np.lexsort((pair, unit))
    pair, times, unit = pair[order], times[order], unit[order]
    if not len(pair):
        return pair, times, unit
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(unit) != 0)]))
    return pair[first], np.add.reduceat(times, first), unit[first]


@lru_cache(maxsize=2)
def _pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin: at each text and at each blank that follows no white space. A match of a pre-tokenising pattern
    holds a blank only as its first character or within white space, and pieces hold their mark only in front."""
    before = data[:-1]
    white = _BLANK[before]
    two = (np.concatenate([[0], before[:-1]]) == 0xC2) & ((before == 0x85) | (before == 0xA0))
    ago = np.concatenate([[0, 0], before[:-2]])[: len(before)]  # the byte two before
    mid = np.concatenate([[0], before[:-1]])
    three = ((ago == 0xE1) & (mid == 0x9A) & (before == 0x80)) | ((ago == 0xE3) & (mid == 0x80) & (before == 0x80)) | ((ago == 0xE2) & ((mid == 0x80) | (mid == 0x81)) & (before >= 0x80))
    cut = np.concatenate([[False], (data[1:] == 0x20) & ~white & ~two & ~three])
    cut[begins] = True
    return np.flatnonzero(cut)


class Block:
    """The postings of up to DOCUMENTS documents."""

    def __init__(self) -> None:
        self.docs, self.size, self.parts = 0, 0, []

    def add(self, pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((pair, place, times))
        self.size += len(pair)

    def bitmaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
        """pair, documents, links, bitmap and planes of each pair, in runs of pairs."""
        pair, place, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*self.parts, strict=True)) or [[], [], []]))
        self.parts = []
        order = np.argsort(pair, kind="stable")  # places ascend within a pair, as the parts came in turn
        pair, place, times = pair[order], place[order].astype(np.uint16), times[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        bounds = np.append(first, len(pair))
        for lo in range(0, len(first), 50_000):
            hi = min(lo + 50_000, len(first))
            at = slice(bounds[lo], bounds[hi])
            yield pair[first[lo:hi]], *_packed(place[at], times[at], bounds[lo : hi + 1] - bounds[lo])


def _packed(place: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    n_docs, links = np.diff(bounds), np.add.reduceat(times, bounds[:-1])
    row = np.repeat(np.arange(len(n_docs)), n_docs)
    more, planes, j = times - 1, [], 0
    while more.any():
        has = np.flatnonzero(more & 1)
        planes.append((row[has], place[has], j))
        more, j = more >> 1, j + 1
    high = np.zeros(len(n_docs), np.int64)  # planes of each row, up to its highest
    for rows, _, j in planes:
        high[rows] = j + 1
    starts = np.concatenate([[0], np.cumsum(high)])
    of = np.concatenate([starts[rows] + j for rows, _, j in planes]) if planes else np.zeros(0, np.int64)
    held = np.concatenate([p for _, p, _ in planes]) if planes else np.zeros(0, np.uint16)
    order = np.argsort(of, kind="stable")
    planes_ = _binary(held[order], np.bincount(of, minlength=starts[-1]))
    return n_docs, links, _binary(place, n_docs), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), planes_)


def _binary(place: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A compressed bitmap of each run of places: the places while they are shorter than plain bits."""
    sizes = np.where(2 * counts < DENSE, 2 * counts, DENSE).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(offsets[-1]) // 2, np.uint16)
    begin = np.cumsum(counts) - counts
    listed = np.repeat(2 * counts < DENSE, counts)
    out[(np.repeat(offsets[:-1] // 2 - begin, counts) + np.arange(len(place)))[listed]] = place[listed]
    data = out.view(np.uint8)
    for r in np.flatnonzero(2 * counts >= DENSE):
        bits = np.zeros(DOCUMENTS, bool)
        bits[place[begin[r] : begin[r] + counts[r]]] = True
        data[offsets[r] : offsets[r + 1]] = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def places_of(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """row and place of each document in compressed bitmaps."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    dense = np.flatnonzero(sizes == DENSE)
    counts = np.where(sizes == DENSE, 0, sizes // 2)
    rows = [np.repeat(np.arange(len(sizes)), counts)]
    listed = bitmaps.filter(pa.array(sizes != DENSE)) if len(dense) else bitmaps
    places = [np.frombuffer(b"".join(listed.to_pylist()), np.uint16).astype(np.int64)]
    for r in dense:
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(bitmaps[int(r)].as_py(), np.uint8), bitorder="little"))
        rows.append(np.full(len(bits), r))
        places.append(bits)
    return np.concatenate(rows), np.concatenate(places)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    schema = _schema()
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


@lru_cache(maxsize=1)
def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in ROW.split(","))])


def _inverted(a: bytes, b: bytes):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, number, block = _pair(a, b), TaskContext.get().partitionId() << 32, 0, Block()

        def closed() -> Iterator[pa.RecordBatch]:
            for pair, n_docs, links, docs, planes in block.bitmaps():
                yield _batch({"block": pa.array(np.full(len(pair), part | number)), "pair": pa.array(pair), "n_docs": pa.array(n_docs), "pair_links": pa.array(links), "docs": docs, "planes": planes}, len(pair))

        for batch in batches:
            for piece in slices(batch):
                if block.size > POSTINGS or block.docs + piece.num_rows > DOCUMENTS:
                    yield from closed()
                    number, block = number + 1, Block()
                yield _documents(tool, piece, block, part | number)
        yield from closed()

    return read


def _documents(tool: Pair, piece: pa.RecordBatch, block: Block, name: int) -> pa.RecordBatch:
    """The rows of a piece (doc, text); their postings go to block."""
    n = piece.num_rows
    texts = [x or b"" for x in piece.column(1).cast(pa.binary()).to_pylist()]
    full = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    data = b"".join(b" " + x for x in texts if x)
    base, block.docs = block.docs, block.docs + n
    columns = {"block": pa.array(np.full(n, name)), "place": pa.array(np.arange(base, base + n)), "doc": piece.column(0)}
    numbers, digests = np.zeros((n, 4), np.int64), [""] * n
    if data:
        raw = np.frombuffer(data, np.uint8)
        begins = np.cumsum(full) - full
        starts = _starts(raw, begins[full > 0]) if tool.cuts else begins[full > 0]
        offsets = np.append(starts, len(raw)).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, distinct = units.indices.to_numpy().astype(np.int64), units.dictionary.to_pylist()
        doc = np.searchsorted(begins + full, starts, side="right")
        at = tool.places(distinct)
        said = [tool.texts[k] for k in at.tolist()]
        bad = np.zeros(n, bool)
        bad[doc[np.array([x is None for x in said])[code]]] = True
        keep = ~bad[doc]
        code, doc = code[keep], doc[keep]
        sizes = tool.sizes[at]
        for k in range(4):
            numbers[:, k] = np.bincount(doc, sizes[code, k], minlength=n)
        stops = np.searchsorted(doc, np.arange(n + 1)).tolist()
        spelled = list(map(said.__getitem__, code.tolist()))
        digests = [hashlib.sha256(";".join(spelled[i:j]).encode()).hexdigest() if i < j else "" for i, j in zip(stops, stops[1:], strict=False)]
        block.add(*_postings(tool, at, code, doc, base, n))
    columns |= {c: pa.array(numbers[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    return _batch(columns | {"groups_sha256": pa.array(digests, pa.string())}, n)


def _postings(tool: Pair, at: np.ndarray, code: np.ndarray, doc: np.ndarray, base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, place, links of each pair in each document of a piece, by pair."""
    keys, times = np.unique(code * n + doc, return_counts=True)  # units of a document
    unit, doc = at[keys // n], keys % n
    many = tool.first[unit + 1] - tool.first[unit]
    of = np.repeat(np.arange(len(unit)), many)
    where = tool.first[unit[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    distinct, pid = np.unique(tool.pairs[where], return_inverse=True)
    key, links = pid * n + doc[of], times[of] * tool.times[where]
    order = np.argsort(key, kind="stable")
    key, links = key[order], links[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, links = key[first], np.add.reduceat(links, first) if len(first) else links
    return distinct[key // n], base + key % n, links


def inverted(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table of both kinds of rows: documents (pair is null) and inverted rows of pairs."""
    rows = docs.select(F.to_json(F.struct(F.col(id_col).alias("id"))).alias("doc"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession):
        return stored(rows.mapInArrow(_inverted(a, b), ROW), "alignment")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n_docs, n_links: in how many documents of inverted() a pair is linked, and how often."""
    return rows.filter("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place, count_sum, n_best from inverted rows with their counts, sorted by block."""
    now, total, best = None, np.zeros(0), np.zeros(0)
    names = ["block", "place", "count_sum", "n_best"]

    def told() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64)), pa.array(best[at].astype(np.int64))], names)

    for batch in batches:
        block, n, top = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for lo, hi in zip(*_runs(block), strict=True):
            if block[lo] != now:
                if now is not None:
                    yield told()
                now, total, best = block[lo], np.zeros(DOCUMENTS), np.zeros(DOCUMENTS)
            part = batch.slice(lo, hi - lo)
            planes = part.column(4)
            of = pc.list_parent_indices(planes).to_numpy().astype(np.int64)
            ends = np.cumsum(pc.list_value_length(planes).to_numpy(zero_copy_only=False))
            level = np.arange(len(of)) - np.concatenate([[0], ends])[of]
            for bitmaps, row, weight in ((part.column(3), np.arange(hi - lo), np.ones(hi - lo)), (planes.flatten(), of, 2.0**level)):
                r, place = places_of(bitmaps)
                for into, times in ((total, n[lo:hi]), (best, top[lo:hi])):
                    into += np.bincount(place, weight[r] * times[row[r]], minlength=DOCUMENTS)
    if now is not None:
        yield told()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0])) if len(x) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(x)) if len(x) else first


def align_tokenizers(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A's tokens of space + text and B's tokens of text are cut into groups at byte offsets where tokens of both end; every
    A token of a group is linked with every B token of it. A pair's count is the number of documents that hold it linked.
    n_best: links whose count is the highest of their A id, ties included; count_sum: the sum of the links' counts;
    groups_sha256: digest of `a1,a2|b1;a3|b2,b3`. Texts that are null or empty, or that either tokenizer's bytes don't
    give back, have zeros and ''. Repeated rows and null ids count and stay row by row; an empty table gives an empty
    result; other columns are ignored. Very long texts are one piece of a task: its memory follows the longest text and a
    block's bounded postings, and equal tokens of a group are counted before they are paired.
    """
    rows = inverted(docs, a, b, id_col, text_col)
    counts = stored(pair_counts(rows).select("pair", "n_docs"), "alignment-counts")
    a_id = F.shiftright("pair", B_BITS).cast("int")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n_docs").alias("top"))  # at most a row an id of A's vocabulary
    told = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", F.col("n_docs").cast("double").alias("n"), F.when(F.col("n_docs") == F.col("top"), 1.0).otherwise(0.0).alias("best"))
    postings = rows.filter("pair is not null").select("block", "pair", "docs", "planes").join(told, "pair").select("block", "n", "best", "docs", "planes")
    back = postings.repartition("block").sortWithinPartitions("block").mapInArrow(_returned, f"{PLACES}, count_sum long, n_best long")
    scores = stored(back, "alignment-scores")
    of = rows.filter("place is not null").select("block", "place", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    kind = docs.schema[id_col].dataType.simpleString()
    out = of.join(scores, ["block", "place"], "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.from_json("doc", f"id {kind}")["id"].alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the two public tokenizers of the contract."""
    import public_tokenizers

    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    return align_tokenizers(table(spark, sf_dir, "documents"), *files)
