"""Toxicity by class-conditional Kneser-Ney models of word pairs, words and their stems.

A toxic and an ordinary model count the pairs of neighbouring words of labelled documents, their beginnings and ends
among them. Each takes a discount off every count and gives what that frees to the order below, where a word counts, after
Kneser and Ney, as often as it follows different words of the class; that order gives on to the stems (first bytes of
words), which count as many different words as they begin; and these to a model that both classes share, counted over all
documents, labelled or not. So an expression of ordinary words is told by its pairs, one that neither class has often by
its words and stems, and one whose stem is rare too by the shared counts, which tell nothing either way. A text's score is
the difference of the two log-likelihoods divided by its length, calibrated on labelled documents that were not counted.

The difference is a sum of three tables: what a word tells by itself, what it tells as the one before another (the weight
that its class gives to the order below), and what a pair that was seen tells beyond that. Counts are DataFrame
aggregations keyed by hashes of 62 bits (stems: 64), combined within tasks first. For scoring, only the most frequent words
and pairs, as many as the parameter `slots` allows, are sent to the tasks, by their whole hash; a document's other words,
and those of its other pairs that may have been seen (by a table of bits of fixed size), are counted in the task and joined
to the tables, so all are scored alike whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import dropped, small, stored, table
from convlog.llm.tokenize import slices
from convlog.llm.words import FOLD, NOT_LETTERS, hashed_words, mixed

STEM = 5  # bytes
DISCOUNT = 0.75
TELLING = 3.0  # log-ratio of a word
TOXIC, ORDINARY, UNLABELLED = 1, 0, 2
HELD_WORDS = 4_000_000  # words that a task holds before it counts them
BITS = 26  # bits of the number of bits that mark seen pairs
START, END = np.uint64(0x5851F42D4C957F2C), np.uint64(0x14057B7EF767814C)  # stand before a text's first word and after its last
PART_BITS = 2  # bits of the number of parts in which pairs are joined, one after another
LOW = ~np.uint64(3)  # the two low bits of a word's hash are free for its class


def sequences(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """word, row, stem and the word before, of each word and of the end after the last one of each text. Words are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased."""
    word, row, stem = hashed_words(texts, NOT_LETTERS, FOLD, STEM)
    ends = np.searchsorted(row, np.arange(len(texts)), side="right")
    word, stem = np.insert(word & LOW, ends, END), np.insert(stem, ends, END)
    row = np.insert(row, ends, np.arange(len(texts)))
    before = np.concatenate([[START], word[:-1]]).astype(np.uint64)
    before[np.concatenate([[True], row[1:] != row[:-1]])] = START
    return word, row, stem, before


def pair_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(word)) & LOW


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _parts(pairs: DataFrame) -> list[DataFrame]:
    """Rows by the part of their pair: by the bits above the two that are free."""
    return [pairs.filter(F.shiftright("pair", 2).bitwiseAND((1 << PART_BITS) - 1) == k) for k in range(1 << PART_BITS)]


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, stem, seen) of all texts, and (pair, before, word, toxic, ordinary) of the texts of the two classes, from rows
    (id, text, kind). All are hashes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, at, n = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(word), _signed(np.concatenate([x[1] for x in held])[at]), pa.array(n.astype(np.int64))], ["word", "stem", "seen"])

        for whole in batches:
            for batch in slices(whole, 2 << 20):
                word, _, stem, _ = sequences(batch.column(1))
                held.append((word, stem))
                size += len(word)
                if size >= HELD_WORDS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                word, row, _, before = sequences(batch.column(1))
                toxic = batch.column(2).to_numpy(zero_copy_only=False)[row] == TOXIC
                pair, at, of = np.unique(pair_of(before, word), return_index=True, return_inverse=True)
                by = [np.bincount(of, weights=x, minlength=len(pair)).astype(np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([_signed(pair), _signed(before[at]), _signed(word[at]), *map(pa.array, by)], ["pair", "before", "word", "toxic", "ordinary"])

    seen = docs.mapInArrow(words, "word long, stem long, seen long").groupBy("word").agg(F.first("stem").alias("stem"), F.sum("seen").alias("seen"))
    told = docs.filter(F.col("kind") != UNLABELLED).mapInArrow(pairs, "pair long, before long, word long, toxic long, ordinary long")
    return seen, told.groupBy("pair").agg(F.first("before").alias("before"), F.first("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


CLASSES = ("toxic", "ordinary")


def kneser_ney(seen: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """From two stored tables, which are deleted: (word, value, rare, often) of every word that was counted: what it tells by itself and as the one before; whether no
    class has it; and the logarithm of its count in steps of an eighth of a doubling. (pair, value, often) of every pair
    that a class has: what it tells beyond that. And what the beginning and the end of any text tell."""
    follows = stored(pairs.groupBy("word").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES)), "kn-follows")
    words = seen.join(follows, "word", "left").fillna(0, list(CLASSES))
    words = stored(words, "kn-words")
    dropped(seen, follows)
    stems = stored(words.groupBy("stem").agg(F.count("*").alias("kinds"), F.sum("seen").alias("stem_seen"), *(F.count_if(F.col(c) > 0).alias(f"stem_{c}") for c in CLASSES)), "kn-stems")
    total = words.agg(*(F.sum(c).cast("double").alias(c) for c in CLASSES), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in CLASSES)).first()
    lower = stems.agg(F.sum("kinds").cast("double").alias("kinds"), *(F.sum(f"stem_{c}").cast("double").alias(c) for c in CLASSES), *(F.count_if(F.col(f"stem_{c}") > 0).alias(f"kinds_{c}") for c in CLASSES)).first()
    often = lambda n: F.floor(F.log2(n) * 8).cast("int").alias("often")
    if not total["toxic"] or not total["ordinary"]:
        return words.select("word", F.lit(0.0).alias("value"), F.lit(1).alias("rare"), often("seen")), pairs.limit(0).select("pair", F.lit(0.0).alias("value"), F.lit(0).alias("often")), 0.0

    def left(n: Column | str, of: Column | float) -> Column:
        return F.greatest(F.col(n) - DISCOUNT if isinstance(n, str) else n - DISCOUNT, F.lit(0.0)) / of

    spelled = F.col("seen") / F.col("stem_seen") * F.col("kinds") / lower["kinds"]  # the shared model of words
    own = {}
    for c in CLASSES:
        stem = left(f"stem_{c}", lower[c]) * F.col("seen") / F.col("stem_seen") + DISCOUNT * lower[f"kinds_{c}"] / lower[c] * spelled
        own[c] = left(c, total[c]) + DISCOUNT * total[f"kinds_{c}"] / total[c] * stem
    probable = words.join(stems, "stem").select("word", "seen", *(p.alias(f"p_{c}") for c, p in own.items()), (F.col("toxic") + F.col("ordinary") == 0).cast("int").alias("rare"))
    before = pairs.groupBy("before").agg(*(F.sum(c).alias(f"all_{c}") for c in CLASSES), *(F.count_if(F.col(c) > 0).alias(f"after_{c}") for c in CLASSES))
    freed = [F.when(F.col(f"all_{c}") > 0, DISCOUNT * F.col(f"after_{c}") / F.col(f"all_{c}")).otherwise(1.0).alias(f"freed_{c}") for c in CLASSES]
    before = stored(before.select("before", *(f"all_{c}" for c in CLASSES), *freed), "kn-before")
    probable = stored(probable, "kn-probable")
    dropped(words, stems)
    ratio = lambda x: F.log(F.col(f"{x}_toxic") / F.col(f"{x}_ordinary"))
    as_before = before.select(F.col("before").alias("word"), ratio("freed").alias("as_before"))
    values = stored(probable.join(as_before, "word", "left").select("word", (ratio("p") + F.coalesce("as_before", F.lit(0.0))).alias("value"), "rare", often("seen")), "kn-values")
    full = {c: F.when(F.col(f"all_{c}") > 0, left(c, F.col(f"all_{c}"))).otherwise(0.0) + F.col(f"freed_{c}") * F.col(f"p_{c}") for c in CLASSES}
    beyond = F.log(full["toxic"] / full["ordinary"]) - ratio("p") - ratio("freed")
    told = []
    for part in _parts(pairs):  # one after another: each part's shuffles go before the next one's come
        joined = part.join(probable.select("word", *(f"p_{c}" for c in CLASSES)), "word").join(before, "before")
        told.append(stored(joined.select("pair", beyond.alias("value"), often(F.col("toxic") + F.col("ordinary"))), "kn-pairs"))
    at = values.filter(F.col("word") == int(END.view(np.int64))).first(), as_before.filter(F.col("word") == int(START.view(np.int64))).first()
    dropped(pairs, probable, before)
    return values, reduce(DataFrame.unionByName, told), (at[0]["value"] if at[0] else 0.0) + (at[1]["as_before"] if at[1] else 0.0)


def _frequent(values: DataFrame, key: str, most: int) -> tuple[int, pa.Table]:
    """The step of counts from which on there are no more than so many keys, and those keys."""
    least, n = 1 << 30, 0
    for often, k in sorted(map(tuple, values.groupBy("often").count().collect()), reverse=True):
        n += k
        if n > most:
            break
        least = often
    return least, values.filter(F.col("often") >= least).drop("often").toArrow().combine_chunks().sort_by(key)


def _marked(pairs: DataFrame) -> np.ndarray:
    """Bits of pairs. Their number is fixed, so what comes to the driver and goes to the tasks is bounded."""
    bit = F.shiftrightunsigned("pair", 64 - BITS)
    found = pairs.select(F.shiftright(bit, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("mask")).groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found.column("cell").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def _counted(key: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """For each row the list of its different keys and how often each occurs."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(key[new]), pa.array(np.diff(np.append(new, len(key))).astype(np.int64))], ["key", "times"]))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def log_ratios(docs: DataFrame, values: DataFrame, pairs: DataFrame, always: float, most: int) -> DataFrame:
    """id, n_words, and means over the whole text (0 if it has no words): ratio, toxic minus ordinary log-likelihood;
    telling, the part of it that lies beyond TELLING in single words and pairs; rare, the share of words that no class has.
    At most so many words and so many pairs are sent to the tasks; the others are joined by their hashes."""
    least, sent = _frequent(values, "word", most)
    least_pair, sent_pairs = _frequent(pairs, "pair", most)
    keys, of_key, rare_key = (sent.column(c).to_numpy() for c in ("word", "value", "rare"))
    pair_keys, of_pair = (sent_pairs.column(c).to_numpy() for c in ("pair", "value"))
    others = pairs.filter(F.col("often") < least_pair)
    end = int(END.view(np.int64))
    marked = _marked(others.select("pair"))
    lists_of_pairs = [f"rest_pairs_{k}" for k in range(1 << PART_BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2 << 20):
                rows = batch.num_rows
                word, row, _, before = sequences(batch.column(1))
                pair = pair_of(before, word).view(np.int64)
                at, hit = _found(pair_keys, pair)
                sums = [np.bincount(row[hit], weights=x, minlength=rows).astype(float) for x in (of_pair[at[hit]], np.maximum(of_pair[at[hit]] - TELLING, 0))]
                bit = pair.view(np.uint64) >> np.uint64(64 - BITS)
                other = ~hit & (((marked[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)) > 0)
                part = (pair >> 2) & ((1 << PART_BITS) - 1)
                rest_pairs = [_counted(pair[other & (part == k)], row[other & (part == k)], rows) for k in range(1 << PART_BITS)]
                word = word.view(np.int64)
                word, row = word[word != end], row[word != end]
                at, hit = _found(keys, word)
                sums = [sums[0] + np.bincount(row[hit], weights=of_key[at[hit]], minlength=rows), sums[1] + np.bincount(row[hit], weights=np.maximum(of_key[at[hit]] - TELLING, 0), minlength=rows), np.bincount(row[hit], weights=rare_key[at[hit]], minlength=rows).astype(float)]
                n = np.bincount(row, minlength=rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *map(pa.array, sums), _counted(word[~hit], row[~hit], rows), *rest_pairs], ["id", "n_words", "ratio", "telling", "rare", "rest", *lists_of_pairs])

    kind, lists = docs.schema["id"].dataType.simpleString(), "array<struct<key:bigint,times:bigint>>"
    found = docs.select("id", "text").mapInArrow(run, f"id {kind}, n_words long, ratio double, telling double, rare double, {', '.join(f'{c} {lists}' for c in ['rest', *lists_of_pairs])}")
    held = stored(found.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")  # numbered once, as ids may repeat
    rest = held.select("row", F.explode("rest").alias("x")).select("row", "x.key", "x.times").join(values.filter(F.col("often") < least).withColumnRenamed("word", "key"), "key").select("row", "times", "value", "rare")
    found_pairs = [held.select("row", F.explode(c).alias("x")).select("row", "x.key", "x.times").join(part.withColumnRenamed("pair", "key"), "key").select("row", "times", "value", F.lit(0).alias("rare")) for c, part in zip(lists_of_pairs, _parts(others), strict=True)]
    parts = {"ratio": F.col("value"), "telling": F.greatest(F.col("value") - TELLING, F.lit(0.0)), "rare": F.col("rare").cast("double")}
    # sums of decimals agree to the last digit whatever the order of the tasks; one job a part, so that its shuffles go
    decimals = {c: (x * F.col("times")).cast("decimal(28,12)") for c, x in parts.items()}
    summed = [stored(x.groupBy("row").agg(*(F.sum(d).alias(c) for c, d in decimals.items())), "toxicity-sums") for x in (rest, *found_pairs)]
    more = reduce(DataFrame.unionByName, summed).groupBy("row").agg(*(F.sum(c).cast("double").alias(f"more_{c}") for c in parts))
    sums = {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) + (always if c == "ratio" else 0.0) for c in parts}
    means = (F.when(F.col("n_words") > 0, x / (F.col("n_words") + 1)).otherwise(0.0).alias(c) for c, x in sums.items())
    return held.drop("rest", *lists_of_pairs).join(more, "row", "left").select("id", "n_words", *means)


FEATURES = ["1.0", "ratio", "rare", "telling", "sqrt(telling)", "ln(1 + n_words) / 10", "ratio * ln(1 + n_words) / 10"]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, slots: int = 22, sample: int = 50_000) -> DataFrame:
    """id, held_out, score, predicted, n_words, ratio: one row per input row.

    Labels are used only of ids whose crc32(id as text) mod 3 is 0 (counted) or 2 (calibration, at most `sample` of them
    by the order of a hash). The score depends on the text alone. Null text counts as empty; empty texts get the score
    of a ratio of 0. If an id has several labels, the largest holds; ids without label count for the shared orders.
    Without labels of both kinds every score is 0. Null ids aren't held out and have no label. Repeated rows are scored
    alike, other columns ignored, whatever their names; an empty table gives an empty result. At most 2 ** (slots - 2)
    of the most frequent words are sent to the tasks; slots changes the work, not the scores.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3))
    marks = stored(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")), "toxicity-labels")
    counted = marks.filter(part == 0)
    kind = F.coalesce(F.col("label"), F.lit(UNLABELLED))
    seen, pairs = counts(rows.join(small(counted.select("id", "label"), 2_000_000), "id", "left").select("id", "text", kind.alias("kind")))
    values, told, always = kneser_ney(stored(seen, "toxicity-words"), stored(pairs, "toxicity-pairs"))
    scored = stored(log_ratios(rows, values, told, always, 1 << max(slots - 2, 0)), "toxicity-ratios")
    features = scored.select("id", "n_words", "ratio", F.array(*(F.expr(x).cast("double") for x in FEATURES)).alias("features"))
    fit = features.join(marks.filter(part == 2), "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("features", "label").toPandas()
    y = fit["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        w = _fit(np.array(fit["features"].tolist()), y).tolist()
        logit = sum((F.col("features")[i] * v for i, v in enumerate(w)), F.lit(0.0))
        score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    else:
        score = F.lit(0.0)
    return features.withColumn("score", score).select(
        F.col("id").alias(id_col), F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "ratio"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
