"""Repeated substrings by interval expansion on Burrows-Wheeler transforms.

A window is `least` consecutive bytes. Each is dealt by its anchor, the smallest hash of its byte n-grams, so equal windows
meet wherever they stand; consecutive windows of one anchor's place are a segment, and only segments whose anchor occurs
twice go on. Equal segments are one content with its first place. The contents of some anchors, a few megabytes, are a shard: a
task sorts its suffixes up to the window's length into a Burrows-Wheeler transform and expands the empty string's interval
backwards, all intervals of one length at a time. An interval whose right end is new gives the common prefix there;
lengths grow by one up to the window's, and what is undivided then is a class of equal windows. All of a class but the
first in the order of documents and places are repeats.

An anchor with very many contents (a phrase with ever other surroundings) would be too much for a task: its windows are
dealt again, each by all of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import dropped, settings, stored, table
from convlog.llm.tokenize import slices
from convlog.llm.words import mixed

GRAM = 32  # bytes of an anchor's n-gram
CHUNK = 1 << 18  # windows hashed at once
CROWDED = 4096  # contents of one anchor from which windows are dealt by all their bytes
WIDTH = 20  # bits of a segment's number of windows beside its place
SHARD = 1 << 20  # bytes of contents in a shard, about
_PLACE = np.uint64((1 << 21) - 1)  # low bits for a place in a chunk
END = 0xFF  # a byte that UTF-8 never has: after each content
_ODD = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each place on."""
    words, width, held = data.astype(np.uint64), 1, {}
    while width <= min(size, 8):
        held[width] = words
        words, width = words[: len(words) - width] | (words[width:] << np.uint64(8 * width)), 2 * width
    n, at, k, out = len(data) - size + 1, 0, 0, None
    while at < size:
        width = max(w for w in held if at + w <= size)
        part = held[width][at : at + n] * _ODD[k % len(_ODD)]
        part ^= part >> np.uint64(31)
        out = part if out is None else (out + part) * _ODD[-1 - k % len(_ODD)]
        at, k = at + width, k + 1
    return mixed(out)


def _smallest(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of so many."""
    span = 1
    while 2 * span <= window:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (window - span)], x[window - span :]) if span < window else x


def segments(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """text, start, windows, anchor of the segments of texts; anchors depend on the windows alone."""
    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for lo in range(0, max(len(data) - least + 1, 0), CHUNK):
        piece = data[lo : lo + CHUNK + least - 1]
        grams = _grams(piece, gram)
        # the leftmost place of the smallest: no two equal windows have one anchor at one place
        anchor = _smallest(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), least - gram + 1)
        at = np.arange(lo, lo + len(anchor))
        text = np.searchsorted(ends, at, side="right")
        inside = at + least <= ends[text]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]])
        first = np.flatnonzero(inside & new)
        if not len(first):
            continue
        n = np.minimum(lo + np.append(first[1:], len(anchor)), ends[text[first]] - least + 1) - (lo + first)
        yield text[first], at[first] - begins[text[first]], n, grams[(anchor[first] & _PLACE).astype(np.int64)].view(np.int64)


def _anchored(least: int, gram: int) -> Callable:
    """From batches (doc, binary, and maybe the place of the binary in its document) to segments (m, doc, at)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, CHUNK):
                doc = piece.column(0).to_numpy()
                base = piece.column(2).to_numpy() if piece.num_columns > 2 else np.zeros(len(doc), np.int64)
                for text, start, n, m in segments(piece.column(1).to_pylist(), least, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(doc[text]), pa.array((start + base[text]) << WIDTH | n)], ["m", "doc", "at"])

    return read


def _digested(least: int, names: list[str]) -> Callable:
    """From batches (doc, binary, id, segments) to REFS."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, CHUNK):
                texts, lists = piece.column(1).to_pylist(), piece.column(3)
                row, parts = pc.list_parent_indices(lists), lists.flatten()
                at = parts.field(1).to_numpy()
                start, n = at >> WIDTH, at & ((1 << WIDTH) - 1)
                digests = [hashlib.blake2b(texts[t][s:e], digest_size=16).digest() for t, s, e in zip(row.to_pylist(), start.tolist(), (start + n + least - 1).tolist(), strict=True)]
                columns = [parts.field(0), pa.array(digests, pa.binary()), piece.column(2).take(row), piece.column(0).take(row), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return read


def _cut(least: int, names: list[str]) -> Callable:
    """From batches (doc, binary, id, segments) to the contents of the segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, CHUNK):
                texts, lists = piece.column(1).to_pylist(), piece.column(3)
                row, parts = pc.list_parent_indices(lists), lists.flatten()
                m, start, n = (parts.field(k) for k in range(3))
                content = [texts[t][s : s + k + least - 1] for t, s, k in zip(row.to_pylist(), start.to_pylist(), n.to_pylist(), strict=True)]
                columns = [m, pa.array(content, pa.binary()), piece.column(2).take(row), piece.column(0).take(row), start, n]
                yield pa.RecordBatch.from_arrays(columns, names)

    return read


def _order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of data in the order of their first depth bytes, by doubling."""
    n = len(data)
    bits = n.bit_length()
    have = min(8, (64 - bits) // 8)
    padded = np.concatenate([data, np.full(have, END, np.uint8)]).astype(np.uint64)
    key = padded[:n]
    for k in range(1, have):
        key = key << np.uint64(8) | padded[k : n + k]
    place, packed = np.arange(n, dtype=np.uint64), 3 * bits <= 64
    while True:
        if packed:  # keys with their places are sorted in one
            both = np.sort(key << np.uint64(bits) | place)
            order, ordered = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
        else:
            order = np.argsort(key)
            ordered = key[order]
        if have >= depth:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
        step = min(have, depth - have)
        after = np.full(n, n, np.uint64)
        after[: n - step] = rank[step:]
        key, have = rank << np.uint64(bits) | after, have + step


def common_prefixes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of data, sorted by their first bytes, and where a common prefix of less than `least` bytes divides them:
    breadth-first backward extension on the transform, by increasing length. Nothing is extended by END."""
    order = _order(data, least)
    n = len(data)
    bwt = data[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    to = np.empty(n, np.int32)  # from a row to the row of the suffix one byte longer
    to[by_byte] = np.arange(n)
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # the next and the last row with the same byte
    after[by_byte[:-1][same]], before[by_byte[1:][same]] = by_byte[1:][same], by_byte[:-1][same]
    goes = bwt != END
    divided = np.zeros(n + 1, bool)
    divided[[0, n]] = True
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(least):
        size = right - left
        one = size == 1
        row = left[one]
        lefts = [to[row[goes[row]]]]
        rights = [lefts[0] + 1]
        left, right, size = left[~one], right[~one], size[~one]
        if len(left):
            row = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            keep = goes[row]
            row, left, right = row[keep], np.repeat(left, size)[keep], np.repeat(right, size)[keep]
            # a row is the first, or the last, of its byte in its interval; both come in the same order of (byte, interval)
            lefts.append(np.sort(to[row[before[row] < left]]))
            rights.append(np.sort(to[row[after[row] >= right]]) + 1)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        new = ~divided[right]
        left, right = left[new], right[new]
        if not len(left):
            break
        divided[right] = True
    return order, divided


def repeats(contents: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(content, start, end): runs of windows that start earlier in the list of contents, or in the same content, too."""
    data = np.frombuffer(b"".join(x + b"\xff" for x in contents), np.uint8)
    sizes = np.array([len(x) + 1 for x in contents], np.int64)
    ends = np.cumsum(sizes)
    order, divided = common_prefixes(data, least)
    own = np.repeat(np.arange(len(contents)), sizes)
    window = np.arange(len(data)) + least < ends[own]
    whole = window[order]
    kind = np.cumsum(divided[:-1])[whole]
    place = order[whole]
    by = np.argsort(kind, kind="stable")  # in order already
    kind, place = kind[by], place[by]
    if not len(kind):
        return []
    begin = np.flatnonzero(np.diff(kind, prepend=-1))
    first = np.minimum.reduceat(place, begin)
    twice = np.zeros(len(data) + 1, bool)
    twice[place] = True
    twice[first] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    of = own[starts]
    base = ends[of] - sizes[of]
    return list(zip(of.tolist(), (starts - base).tolist(), (stops - base).tolist(), strict=True))


def _shards(least: int) -> Callable:
    """From contents (shard, content, doc, start), sorted by shard and order of documents, to runs of repeated bytes."""

    def told(contents: list[bytes], doc: list[int], start: list[int]) -> pa.RecordBatch:
        runs = repeats(contents, least)
        columns = [[doc[k] for k, _, _ in runs], [start[k] + lo for k, lo, _ in runs], [start[k] + hi + least - 1 for k, _, hi in runs]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["doc", "start", "stop"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            shard = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi > lo:
                    if shard[lo] != now:
                        if now is not None:
                            yield told(*held)
                        now, held = shard[lo], ([], [], [])
                    for into, column in zip(held, batch.slice(lo, hi - lo).columns[1:], strict=True):
                        into += column.to_pylist()
        if now is not None:
            yield told(*held)

    return read


def _repeated(rows: DataFrame, base: DataFrame, least: int, gram: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The contents (m, content, id, doc, start, n) whose anchor occurs twice in rows (doc, binary, maybe a place), each with
    its first place, and the runs of bytes (doc, start, stop) of all other places. Rows of segments stay narrow until it is
    known which anchors occur twice."""
    kind = base.schema["id"].dataType.simpleString()
    with settings(base.sparkSession):
        anchored = stored(rows.mapInArrow(_anchored(least, gram), "m long, doc long, at long"), f"{label}-anchored")
    twice = anchored.groupBy("m").agg(F.count("*").alias("times")).filter("times > 1").select("m")
    live = stored(anchored.join(twice, "m", "left_semi"), f"{label}-live")
    dropped(anchored)
    wanted = live.groupBy("doc").agg(F.collect_list(F.struct("m", "at")).alias("parts"))
    columns = ["m", "digest", "id", "doc", "start", "n"]
    refs = stored(base.join(wanted, "doc").select("doc", "text", "id", "parts").mapInArrow(_digested(least, columns), f"m long, digest binary, id {kind}, doc long, start int, n int"), f"{label}-refs")
    dropped(live)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "start", "n")
    firsts = stored(refs.groupBy("m", "digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")), f"{label}-firsts")
    later = refs.join(firsts.filter("copies > 1"), ["m", "digest"]).filter("doc <> first.doc or start <> first.start")
    later = stored(later.select("doc", "start", (F.col("start") + F.col("n") + least - 1).alias("stop")), f"{label}-later")
    dropped(refs)
    wanted = firsts.groupBy("first.doc").agg(F.collect_list(F.struct("m", "first.start", "first.n")).alias("parts"))
    columns = ["m", "content", "id", "doc", "start", "n"]
    contents = stored(base.join(wanted, "doc").select("doc", "text", "id", "parts").mapInArrow(_cut(least, columns), f"m long, content binary, id {kind}, doc long, start int, n int"), f"{label}-contents")
    dropped(firsts)
    return contents, later


def suffix_dedup(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (array of start, stop), kept (binary) of each document.

    Texts are taken as UTF-8, null as empty. A byte goes if a string of `least` bytes that covers it also starts earlier:
    in a document of smaller id, or earlier in the same one; overlapping occurrences count, none crosses documents, and
    all are judged on the input. Null ids come after all others; rows of one id are told apart and come in any order, so of
    equal rows one stays whole. Texts shorter than `least` lose nothing. Very long texts are hashed in chunks and cut into
    segments; only the last step and the cutting hold one whole. An empty table gives an empty result; other columns are
    ignored. `least` is 33 at the smallest.
    """
    if least <= GRAM:
        raise ValueError(f"least must be above {GRAM}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = stored(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), text.alias("text")), "suffix-texts")
    contents, found = _repeated(base.filter(F.octet_length("text") >= least).select("doc", "text"), base, least, GRAM, "suffix")
    crowded = stored(contents.groupBy("m").agg(F.count("*").alias("k")).filter(F.col("k") > CROWDED).select("m"), "suffix-crowded")
    if not crowded.isEmpty():
        dense = contents.join(crowded, "m", "left_semi").select("doc", "content", F.col("start").cast("long"))
        fine, later = _repeated(dense, base, least, least, "suffix-fine")
        found = found.unionByName(later)
        contents = stored(contents.join(crowded, "m", "left_anti").unionByName(fine), "suffix-all-contents")
    held = contents.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    count = max(1, -(-held // SHARD))
    placed = contents.select(F.pmod(F.xxhash64("m"), F.lit(count)).alias("shard"), "content", "doc", "start", "id")
    ordered = placed.repartition(count, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "doc", "start").select("shard", "content", "doc", "start")
    with settings(spark):
        expanded = stored(ordered.mapInArrow(_shards(least), "doc long, start int, stop int"), "suffix-runs")
    runs = found.unionByName(expanded).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    out = base.join(runs, "doc", "left").select("id", "text", "runs").mapInArrow(_without, f"id {kind}, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_bytes", removed.alias("n_removed"), "spans", "kept")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without their runs, and the runs joined to spans."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        for piece in slices(batch):
            texts, spans, kept = piece.column(1).to_pylist(), [], []
            for text, runs in zip(texts, piece.column(2), strict=True):
                spans.append([])
                if not runs.is_valid:
                    kept.append(text)
                    continue
                parts = runs.values
                edges = np.zeros(len(text) + 1, np.int32)
                np.add.at(edges, parts.field(0).to_numpy(), 1)
                np.add.at(edges, parts.field(1).to_numpy(), -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                spans[-1] = [{"start": s, "stop": e} for s, e in zip(turns[::2], turns[1::2], strict=True)]
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            sizes = pc.binary_length(piece.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), sizes, pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 100 bytes."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
