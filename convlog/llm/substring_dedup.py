"""Substring dedup by recompression.

Words are named by hash, told apart by whether they stand at the start, inside or at the end of a run of equal words.
Rounds of recompression then join neighbours: a bit of each name makes it a left or a right one, and a left name that
stands before a right one becomes one symbol with a name of its own. Names are fingerprints of what they cover and
decisions depend on the names alone, so every task gives equal passages equal symbols without asking any other; only
symbols near the ends of a passage depend on what stands around it. With symbols of at most three words after two rounds,
those that cover the middle words of a long enough window are the same wherever the window occurs.

Spark counts the pairs of neighbouring symbols over all documents. A window can only occur twice if all pairs in its
middle do, so the few windows that pass are verified: grouped by a fingerprint of all their words, with the smallest id
that has them. Copies of whole documents are settled first, by a digest of all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import dropped, file_bytes, small, stored, table
from convlog.llm.tokenize import slices
from convlog.llm.words import AS_IS, SPACE, hashed_words, mixed

ROUNDS, LONGEST = 2, 3  # of recompression; words of a symbol
UNSURE = 4  # words at either end of a window whose symbols depend on what stands around it: 1 for runs, then 1, then 2
HELD = 2_000_000  # pairs that a task holds before it counts them
BITS = 27  # bits of the number of bits that mark repeated pairs
PARTS, PART_BYTES = 16, 16 << 20  # parts of the windows that are verified one after another, and the least size of one
_rng = np.random.default_rng(99)
ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = hashlib.sha256(b"").hexdigest()


def symbols(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the symbols of many documents in turn, and the number of each word's symbol."""
    same = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    name = mixed(word + np.concatenate([[False], same]) * ODD[0] + np.concatenate([same, [False]]) * ODD[1])
    length, at = np.ones(len(word), np.int64), row
    for k in range(ROUNDS):
        right = (mixed(name ^ ODD[2 + k]) & np.uint64(1)).astype(bool)
        join = np.flatnonzero(~right[:-1] & right[1:] & (at[1:] == at[:-1]) & (length[1:] + length[:-1] <= LONGEST))
        name = name.copy()
        name[join] = mixed(name[join] * ODD[8] + name[join + 1] * ODD[9] + ODD[4 + k])
        length[join] += length[join + 1]
        keep = np.ones(len(name), bool)
        keep[join + 1] = False
        name, length, at = name[keep], length[keep], at[keep]
    return name, np.repeat(np.arange(len(name)), length)


def _pairs(name: np.ndarray) -> np.ndarray:
    """A name for each two neighbours; those across documents are of no use and of no harm."""
    return mixed(name[:-1] * ODD[10] + name[1:] * ODD[11])


def _bit(pair: np.ndarray) -> np.ndarray:
    return ((pair * ODD[12]) >> np.uint64(64 - BITS)).astype(np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _outlines(docs: DataFrame) -> DataFrame:
    """id, n_words and the digest of all words, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                cut = [x.split() for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in cut], pa.int64()), pa.array([_digest(x) for x in cut], pa.string())], ["id", "n_words", "digest"])

    return docs.mapInArrow(run, "id long, n_words long, digest string")


def _repeated_pairs(docs: DataFrame) -> np.ndarray:
    """Bits of the pairs of symbols that occur twice in the corpus. Their number is fixed, so what comes to the driver and
    goes to the tasks is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(np.minimum(n, 2))], ["pair", "n"])

        for whole in batches:
            for batch in slices(whole, 2 << 20):
                word, row = hashed_words(batch.column(1), SPACE, AS_IS)
                if len(word) < 2:
                    continue
                held.append(_pairs(symbols(word, row)[0]))
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["cell", "mask"])

    repeated = docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").select("pair")
    cells = stored(repeated.mapInArrow(bits, "cell long, mask long").groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask")), "substring-cells")
    found = cells.toArrow()
    dropped(cells)
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def _prints(word: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of the windows that start at the given words."""
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(window):
        one = (one ^ word[at + k]) * ODD[13]
        one ^= one >> np.uint64(29)
        two += word[at + k] * ODD[16 + k % 48]
    return mixed(one).view(np.int64), (mixed(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _starts(row: np.ndarray, window: int) -> np.ndarray:
    n = len(row) - window + 1
    return np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _windows(docs: DataFrame, window: int, marked: np.ndarray) -> DataFrame:
    """print, check, id: the windows of each document that may occur in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                word, row = hashed_words(batch.column(1), SPACE, AS_IS)
                at = _starts(row, window)
                if not len(at):
                    continue
                name, of = symbols(word, row)
                bit = _bit(_pairs(name))
                alone = np.concatenate([[0], np.cumsum(((marked[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)) == 0)])
                first, last = of[at + UNSURE], of[at + window - 1 - UNSURE]
                at = at[alone[last] == alone[first]]
                one, two = _prints(word, at, window)
                ids = batch.column(0).to_numpy()[row[at]]
                rows = np.unique(np.rec.fromarrays([ids, one, two], names="id,print,check"))
                yield pa.RecordBatch.from_arrays([pa.array(rows["print"]), pa.array(rows["check"]), pa.array(rows["id"])], ["print", "check", "id"])

    return docs.mapInArrow(run, "print long, check int, id long")


def _repeated(windows: DataFrame) -> DataFrame:
    """id, print: the windows of each document that one of smaller id has, from rows (print, check, id). The rows are stored
    in parts by their print and looked through a part after another, so that only a part of them is shuffled at a time."""
    held = stored(windows.withColumn("part", F.pmod("print", F.lit(PARTS)).cast("int")), "substring-windows", by="part")
    rounds, found = min(PARTS, 1 + file_bytes(held) // PART_BYTES), []
    for k in range(rounds):
        here = held.filter(F.col("part") % rounds == k).select("print", "check", "id")
        least = here.groupBy("print", "check").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
        found.append(stored(here.join(least, ["print", "check"]).filter("id > least").select("id", F.struct("print", "check").alias("print")), "substring-found"))
    dropped(held)
    return reduce(DataFrame.unionByName, found)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """id, digest, n_removed, kept_text, kept_sha256 from rows (id, text, prints): words that no window with one of the
    prints covers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                word, row = hashed_words(batch.column(1), SPACE, AS_IS)
                at = _starts(row, window)
                one, two = _prints(word, at, window)
                first = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
                begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
                digest, removed, text, sha = [], [], [], []
                for k, (x, prints) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True)):
                    words = x.split()
                    here = slice(first[k], first[k + 1])
                    told, checks = (prints.values.field(j).to_numpy() for j in range(2))
                    hit = at[here][np.isin(one[here], told) & np.isin(two[here], checks)] - begin[k]
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, hit, 1)
                    np.add.at(marks, hit + window, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    digest.append(_digest(words))
                    removed.append(int(gone.sum()))
                    text.append(b" ".join(kept).decode())
                    sha.append(_digest(kept))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array(removed, pa.int64()), pa.array(text, pa.string()), pa.array(sha)], ["id", "digest", "n_removed", "kept_text", "kept_sha256"])

    return docs.mapInArrow(run, "id long, digest string, n_removed long, kept_text string, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Remove each word covered by a window (so many consecutive words) that also starts in a document of smaller id.

    Returns (id, n_words, n_removed, kept_sha256) with one row per input row, and (id, digest, kept_text) for the rows
    that lose some words but are no copies of a whole other row; kept words are joined by one blank. Words are runs
    without white space, taken as they are; windows are judged on the input. Null text has no words. Rows without id are
    left whole and take nothing from others; rows of one id don't take from each other. Fewer words than a window: never
    cut. An empty table gives empty results. Other columns are ignored.
    """
    if window < 2 * UNSURE + LONGEST + 2:
        raise ValueError(f"a window needs {2 * UNSURE + LONGEST + 2} words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    outlines = stored(_outlines(rows), "substring-outlines")
    long_ = outlines.filter(f"id is not null and n_words >= {window}")
    copies = stored(long_.join(long_.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most"), "digest").filter("id > least").select("id", "digest").distinct(), "substring-copies")
    # copies have nothing that their first one hasn't, so they are set aside; rows of an id with several texts stay
    several = outlines.filter("id is not null").groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("id")
    aside = stored(copies.select("id").join(several, "id", "left_anti"), "substring-aside")
    single = rows.filter("id is not null").join(small(aside, 2_000_000), "id", "left_anti")
    found = _repeated(_windows(single, window, _repeated_pairs(single)))
    prints = stored(found.groupBy("id").agg(F.collect_set("print").alias("prints")), "substring-prints")
    dropped(found)
    cutting = stored(prints.select("id"), "substring-ids")  # a table of ids alone, so that it is seen to be small
    touched = single.join(small(cutting, 2_000_000), "id", "left_semi").join(prints, "id")
    cut = stored(_cut(touched, window), "substring-cut")
    changes = cut.select("id", "digest", "n_removed", "kept_sha256").distinct().withColumn("all", F.lit(False)).unionByName(
        copies.join(aside, "id", "left_semi").select("id", "digest", F.lit(None).cast("long").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"), F.lit(True).alias("all"))
    )
    result = outlines.join(changes, ["id", "digest"], "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("all"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
    )
    return result, cut.select(F.col("id").alias(id_col), "digest", "kept_text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))[0]
