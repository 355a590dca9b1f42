"""Token ids as fixed-width bit-packed blocks.

Each id takes the minimum bits of the vocabulary. Documents are dealt out by ranges of their ids and sorted, so that the
part files hold the stream of tokens in ascending id order. A row of a part file is a block: a run of whole documents,
their ids and token counts, the place of its first token in the shard, and the packed ids in one binary value. Token i
of a shard is in the block whose start is the last one up to i, at bit (i - start) * width. Files are written by Spark,
with its commit protocol; a lost executor's tasks are run again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.llm.common import scratch_dir, table
from convlog.llm.tokenize import Memory, marked_units, slices

BLOCK_TOKENS = 1 << 16
LISTED = 500  # units in one string
_ALONE = re.compile(r" \S+").fullmatch
_TAILED = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
REMEMBERED = 600_000  # units in a generation that a Python worker keeps
BLOCK = "shard int, block int, start long, n_tokens int, width int, doc_ids array<long>, doc_tokens array<int>, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits for ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Ids begin..end of a block, without touching the bytes of others."""
    bit = np.arange(begin, end, dtype=np.int64) * width
    if not len(bit):
        return np.zeros(0, np.uint32)
    first = int(bit[0] >> 3)
    data = np.frombuffer(payload[first : int((bit[-1] + width + 7) >> 3)] + b"\0" * 8, np.uint8)
    at, out = (bit >> 3) - first, np.zeros(len(bit), np.uint64)
    for k in range((width + 14) >> 3):
        out |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library whose pattern lets units be encoded by themselves. Special
    tokens that stand in a text are taken for such, as the library does."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) or r"(?!)")
        self.bound = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or t.normalized]  # these reach beyond themselves
        self.memory = Memory(REMEMBERED)
        # units without white space but a first blank are encoded many in one string, if a line end stays by itself there
        one, two, both = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (" a", " b", " a\n b"))
        found = both[len(one) : len(both) - len(two)]
        self.between = found[0] if len(found) == 1 and both == [*one, *found, *two] else None

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each text's followed by end; and how many each has with it."""
        aside = {k for k, t in enumerate(texts) if "\0" in t or any(x in t for x in self.bound)}
        marked = [b"\0" if k in aside else self._marked(t).encode() for k, t in enumerate(texts)]
        data = b"".join(marked)
        offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 0) + 1]).astype(np.int64)
        units_ = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        codes = units_.indices.to_numpy().astype(np.int64)
        distinct = units_.dictionary.to_pylist()  # each with the mark at its end
        ids = [*self._known(distinct), np.array([end], "<u4").tobytes()]
        stops = np.searchsorted(offsets, np.cumsum([len(x) for x in marked]))  # units up to each text's end
        codes = np.insert(codes, stops, len(distinct))
        stops = stops + np.arange(1, len(texts) + 1)
        for k in sorted(aside):  # the one, empty, unit of such a text stands for all of it
            codes[stops[k] - 2] = len(ids)
            ids.append(np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(size)])
        long_ = size[codes]
        begin = np.concatenate([[0], np.cumsum(long_)])
        out = flat[np.repeat(first[codes] - begin[:-1], long_) + np.arange(begin[-1])]
        return out, np.diff(begin[stops], prepend=0)

    def _marked(self, text: str) -> str:
        """The text with a mark after each unit."""
        if self.special.search(text):
            text = self.special.sub("\0\\g<0>\0", text)
        return marked_units(text) + "\0"

    def _known(self, distinct: list[str]) -> list[bytes]:
        """Ids of units that have a mark at their ends."""
        new, known = self.memory.missing([distinct]), self.memory.known
        # a word with a tail of punctuation is two matches of the pattern, and the word is often known
        pairs = [(u, m[1] + "\0", m[2] + "\0") for u in new if (m := _TAILED(u, 0, len(u) - 1))]
        tailed = {u for u, *_ in pairs}
        parts = self.memory.missing([[x for _, *cut in pairs for x in cut]], turn=False)
        wanted = list({*(u for u in new if u not in tailed), *parts})
        alone = [u for u in wanted if _ALONE(u, 0, len(u) - 1)]
        rest = [u for u in wanted if not _ALONE(u, 0, len(u) - 1)]
        for lo in range(0, len(alone), LISTED * 64):
            lists = [alone[k : min(k + LISTED, lo + LISTED * 64)] for k in range(lo, min(lo + LISTED * 64, len(alone)), LISTED)]
            for part, x in zip(lists, self.tokenizer.encode_batch_fast(["".join(u).replace("\0", "\n")[:-1] for u in lists], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, "<u4")
                ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)] if self.between is not None else []
                if len(ends) != len(part):
                    rest += part
                    continue
                flat, begin = ids.tobytes(), 0
                for unit, end in zip(part, ends, strict=True):
                    known[unit] = flat[4 * begin : 4 * end]
                    begin = end + 1
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            for unit, x in zip(part, self.tokenizer.encode_batch_fast([u[:-1] for u in part], add_special_tokens=False), strict=True):
                known[unit] = np.array(x.ids, "<u4").tobytes()
        known.update((u, known[a] + known[b]) for u, a, b in pairs)
        return list(map(known.__getitem__, distinct))


@lru_cache(maxsize=2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: bytes, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by end_id, in ascending id order, to part files under path.

    Null text counts as empty: the end id alone. Null ids come first; rows of equal id are ordered by text. A document
    is never cut: one larger than a block makes a block of its own. An empty table makes an empty folder of blocks. Special
    tokens in a text become their ids, as with the library. Other columns are ignored, whatever their names.
    """
    width = width_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block, start = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            flat = np.concatenate([x[1] for x in held])
            row = [[shard], [block], [start], [len(flat)], [width], [[i for x in held for i in x[0]]], [np.concatenate([x[2] for x in held])], [pack(flat, width)]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _ARROW, strict=True)], _NAMES)
            block, start, held, size = block + 1, start + len(flat), [], 0
            return out

        for whole in batches:
            for batch in slices(whole):
                ids = batch.column(0).to_pylist()
                flat, counts = encode(batch.column(1).to_pylist(), end_id)
                ends = np.cumsum(counts)
                at = 0
                while at < len(ids):  # up to the document that fills the block
                    before = int(ends[at - 1]) if at else 0
                    stop = min(int(np.searchsorted(ends, before + BLOCK_TOKENS - size)) + 1, len(ids))
                    held.append((ids[at:stop], flat[before : ends[stop - 1]], counts[at:stop]))
                    size += int(ends[stop - 1]) - before
                    at = stop
                    if size >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(run, BLOCK)
        .write.option("compression", "zstd")
        .parquet(path)
    )


_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
_NAMES = ["shard", "block", "start", "n_tokens", "width", "doc_ids", "doc_tokens", "payload"]


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, first: tokens in the shards before it. A row per part file, so the running sum is over few rows."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 of the ids as little-endian 32-bit integers."""
    blocks = spark.read.schema(BLOCK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, n, width, docs, tokens, payload in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                data = unpack(payload, width, 0, n).astype("<u4").tobytes()
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), tokens, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + ends - tokens, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    read = blocks.select("shard", "start", "n_tokens", "width", "doc_ids", "doc_tokens", "payload").mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(blocks), "shard").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_slice(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Random access: position and id of tokens begin..end of the whole stream, from the blocks that hold them alone."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    placed = (
        blocks.join(shard_starts(blocks), "shard")
        .withColumn("at", F.col("start") + F.col("first"))
        .filter((F.col("at") < end) & (F.col("at") + F.col("n_tokens") > begin))
        .select("at", "n_tokens", "width", "payload")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, width, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lo, hi = max(begin - at, 0), min(end - at, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + lo, at + hi), pa.int64()), pa.array(unpack(payload, width, lo, hi).astype(np.int64))], ["position", "id"])

    return placed.mapInArrow(run, "position long, id long")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        file = f.read()
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, file, Tokenizer.from_buffer(file).get_vocab_size(), end_id=0)
    return read_documents(spark, path)
