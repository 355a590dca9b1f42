"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

A row of a matrix is one pre-token. Each round, every row merges its leftmost pair of least rank; ranks of pairs come
from a hash table in numpy arrays, and a mask drops the freed cell of each row. Spark deals out the texts; within a task
each distinct unit is merged once and remembered, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import table
from convlog.llm.tokenize import slices, units

NONE = np.int32(2**31 - 1)
_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch
CELLS = 1 << 20  # of one matrix
REMEMBERED = 300_000  # units that a Python worker keeps


class PairTable:
    """Rank of (left id, right id) by open addressing; NONE for pairs that don't merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, at = self._key(left, right), self._slot(self._key(left, right))
        while len(key):  # every round each free slot takes one of the keys that want it
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at] == -1)
            self.keys[at[put]], self.ranks[at[put]] = key[put], rank[put]
            key, rank, at = key[~put], rank[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    def __init__(self, rank_file: bytes, pattern: str):
        self.vocab: list[bytes] = []
        ranks = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.decimal = [str(i) for i in range(len(self.vocab))]
        cuts = [(a, b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*cuts, strict=True)))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as the bytes of 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 0, side="right"))
        while at < len(order):  # a bucket: lengths up to the next power of two
            width = 1 << int(lengths[order[at]] - 1).bit_length()
            end = int(np.searchsorted(lengths[order], width, side="right"))
            step = max(1, CELLS // width)
            for lo in range(at, end, step):
                rows = order[lo : min(end, lo + step)]
                self._merge_bucket(rows, [pieces[i] for i in rows], lengths[rows], width, out)
            at = end
        return out

    def _merge_bucket(self, rows: np.ndarray, pieces: list[bytes], lengths: np.ndarray, width: int, out: list[bytes]) -> None:
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(rows), width), NONE, np.int32)  # of the pair that starts in the cell
        if width > 1:
            inside = ids[:, 1:] >= 0
            rank[:, :-1][inside] = self.pairs(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(rows):
            best = rank.argmin(1)
            least = rank[np.arange(len(rows)), best]
            if (over := least == NONE).any():
                done = ids[over]
                flat, ends = done[done >= 0].tobytes(), (4 * np.cumsum((done >= 0).sum(1))).tolist()
                begin = 0
                for row, end in zip(rows[over].tolist(), ends, strict=True):
                    out[row] = flat[begin:end]
                    begin = end
                rows, ids, rank, best, least = rows[~over], ids[~over], rank[~over], best[~over], least[~over]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            ids[each, best] = least
            keep = np.ones(ids.shape, bool)
            keep[each, best + 1] = False
            width = ids.shape[1] - 1
            ids, rank = ids[keep].reshape(-1, width), rank[keep].reshape(-1, width)
            for here in (best - 1, best):  # the pairs on either side of the new token
                ok = (here >= 0) & (here + 1 < width)
                r, c = each[ok], here[ok]
                right = ids[r, c + 1]
                rank[r, c] = np.where(right >= 0, self.pairs(ids[r, c], np.maximum(right, 0)), NONE)
            rank[:, -1] = NONE

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, each match of the pattern by itself. New units of all texts are merged in the same matrices."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cuts = [units(text) for text in texts]
        new: set[str] = set()
        new.update(*cuts)
        new.difference_update(self.known)
        if new:
            self._learn(list(new))
        for cut in cuts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, cut)), np.int32)

    def _learn(self, new: list[str]) -> None:
        whole = [u for u in new if _WORD(u)]  # one match of the pattern
        rest = [u for u in new if not _WORD(u)]
        found = [self.pattern.findall(u) for u in rest]
        pieces = list(dict.fromkeys(chain(whole, chain.from_iterable(found))))
        ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
        self.known.update((u, ids[u]) for u in whole)
        self.known.update((u, b"".join(map(ids.__getitem__, cut))) for u, cut in zip(rest, found, strict=True))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(maxsize=2)
def _bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded (binary: the bytes of the ids). Null text counts as empty: no ids, no bytes.

    rank_file holds the lines of a .tiktoken file (base64 token, rank); it is small and goes along with the tasks.
    Rows with equal or null ids are encoded each by itself; other columns are ignored, whatever their names; an empty table
    gives none. Very long texts are cut into units; the time for one unit without any blank grows with its square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(1).to_pylist()
                ids = list(bpe.encode(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but id, n_tokens and SHA-256 of the decimal ids and of the decoded bytes: a check of a corpus
    that moves no ids out of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(1).to_pylist()
                n, a, b = [], [], []
                for ids in map(np.ndarray.tolist, bpe.encode(texts)):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return encode_digests(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)
