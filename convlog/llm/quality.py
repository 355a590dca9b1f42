"""Quality classifier from weak labels.

Heuristic labellers look at a document's measures and vote good, bad or nothing. Expectation-maximisation over the counts
of vote patterns (at most 3 ** labellers of them) estimates how often each labeller gives each vote on good and on bad
documents, without any true label, and so each pattern's posterior. The posteriors of a bounded sample train a hashed
linear scorer on the documents' character-class trigrams and measures, which judges every document on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.common import stored, table
from convlog.llm.tokenize import slices
from convlog.llm.words import FOLD, SPACE, hashed_words, mixed

DIMS = 1 << 16  # of the hashed features
FEW = 100  # bytes added to a text's length in its shares, so that a few bytes prove little
BINS = 16  # of each measure, hashed as features too
MEASURES = ("symbols", "upper", "distinct", "word_length", "ended", "line_length", "bars", "stutter")

_CLASS = np.full(256, 5, np.int64)  # non-ASCII
_CLASS[:128] = [8 + k - 32 if 32 < k < 127 else 7 for k in range(128)]
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[SPACE] = 4
_LETTER = (_CLASS == 1) | (_CLASS == 2) | (_CLASS == 5)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*!|<>{}[]~^=+@\\/_`"]] = True


def measures(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """bytes, row ends, and for each text: n_words and MEASURES, all between 0 and 1."""
    rows = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in rows])
    begins = ends - [len(x) + 1 for x in rows]
    size = np.maximum(ends - begins - 1, 1)

    def share(what: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(what)])
        return (total[ends] - total[begins]) / np.maximum(of, 1)

    word, row = hashed_words(texts, SPACE, FOLD)
    n = np.bincount(row, minlength=len(rows))
    unlike = np.unique(mixed(word ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    distinct = np.bincount(row[unlike], minlength=len(rows)) / np.maximum(n, 1) ** 0.85  # long texts repeat their words
    letters = share(_LETTER[data], np.ones(len(rows)))
    space = SPACE[data]
    stop = (data == 46) | (data == 33) | (data == 63)
    lines = share(data == 10, np.ones(len(rows)))
    ended = share(np.concatenate([stop[:-1] & (data[1:] == 10), [False]]), lines)  # the last line counts too
    stutter = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=len(rows))
    out = [
        share(_SYMBOL[data], size + FEW),
        share(_CLASS[data] == 2, letters + FEW),
        distinct,
        share(~space, np.maximum(n, 1)) / 20,
        ended,
        np.minimum(n / np.maximum(lines, 1) / 400, 1),
        share(data == ord("|"), np.maximum(n, 1)),
        stutter / np.maximum(n, 1),
    ]
    return data, ends, n, np.minimum(np.stack(out, 1), 1.0)


def _features(data: np.ndarray) -> np.ndarray:
    """Hashed trigram of character classes that starts at each byte."""
    c = _CLASS[data]
    at = np.zeros(len(c), np.int64)
    at[: len(c) - 2] = (c[:-2] * 7919 + c[1:-1] * 104_729 + c[2:] * 1_299_709) % (DIMS - len(MEASURES) * BINS)
    return at


def _bins(m: np.ndarray) -> np.ndarray:
    """Feature of each measure's bin; finer near 0."""
    return DIMS - len(MEASURES) * BINS + np.arange(len(MEASURES)) * BINS + np.minimum((np.sqrt(m) * BINS).astype(np.int64), BINS - 1)


def measured(docs: DataFrame) -> DataFrame:
    """id, n_words and the measures of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                _, _, n, m = measures(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(m[:, k])) for k in range(len(MEASURES)))], ["id", "n_words", *MEASURES])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, " + ", ".join(f"{m} double" for m in MEASURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes() -> list[Column]:
    """Of each labeller: 1 good, 0 bad, 2 no vote."""
    c = F.col
    return [
        _vote(c("symbols") < 0.01, c("symbols") > 0.06),
        _vote(c("upper") < 0.12, c("upper") > 0.4),
        _vote((c("distinct") > 0.6) & (c("n_words") >= 20), (c("distinct") < 0.3) & (c("n_words") >= 20)),
        _vote((c("word_length") > 0.15) & (c("word_length") < 0.4), (c("word_length") < 0.1) | (c("word_length") > 0.6)),
        _vote(c("ended") > 0.6, (c("ended") < 0.1) & (c("n_words") >= 100)),
        _vote((c("bars") == 0) & (c("n_words") >= 20), c("bars") > 0.05),
        _vote(c("stutter") < 0.02, c("stutter") > 0.15),
    ]


def label_model(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of good for each pattern of votes, from the patterns' counts: two classes, labellers independent given the class,
    no evidence where one doesn't vote; starts from the majority."""
    if not patterns:
        return {}
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    share = ((v == 1).sum(1) + 1) / ((v < 2).sum(1) + 2)
    bad = (v == 0).sum(1)
    post = np.where(bad >= 1, np.minimum(share, 0.5 ** bad), np.maximum(share, 0.9))
    for _ in range(steps):
        prior = (post @ n + 1) / (n.sum() + 2)
        like = np.log(np.stack([1 - np.full(len(v), prior), np.full(len(v), prior)]))
        for k in range(v.shape[1]):
            for c, weight in enumerate(((1 - post) * n, post * n)):
                p = np.array([weight[v[:, k] == x].sum() + 0.1 for x in range(2)])
                like[c] += np.append(np.log(p / p.sum()), 0.0)[v[:, k]]  # no vote tells nothing
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return {tuple(map(int, p)): float(x) for p, x in zip(v, post, strict=True)}


def _sampled_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                data, ends, _, m = measures(batch.column(1))
                at, bins, begin = _features(data), _bins(m), 0
                keys, values = [], []
                for k, end in enumerate(ends.tolist()):
                    key, n = np.unique(at[begin:end], return_counts=True)
                    keys.append(np.concatenate([key, bins[k]]))
                    values.append(np.concatenate([n / (end - begin + FEW), np.full(len(MEASURES), 1 / len(MEASURES))]))
                    begin = end
                yield pa.RecordBatch.from_arrays([batch.column(1 + 1), pa.array(keys, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], ["good", "keys", "values"])

    return docs.select("id", "text", "good").mapInArrow(run, "good double, keys array<long>, values array<double>")


def fit_scorer(rows: list, steps: int = 300, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic scorer of soft labels; Adam on the whole sample, the last weight is the intercept."""
    w = np.zeros(DIMS + 1)
    if not rows:
        return w
    y = np.array([r["good"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["keys"]) for r in rows])
    key, value = np.concatenate([r["keys"] for r in rows]), np.concatenate([r["values"] for r in rows])
    used, key = np.unique(key, return_inverse=True)
    x, first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, steps + 1):
        z = np.bincount(row, weights=value * x[key], minlength=len(y)) + x[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(key, weights=off[row] * value, minlength=len(used)), off.sum()) + 1e-6 * x
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-12)
    w[used], w[-1] = x[:-1], x[-1]
    return w


def scored(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """Rows (id, text, ...) with n_words and score in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                data, ends, n, m = measures(batch.column(1))
                total = np.concatenate([[0.0], np.cumsum(w[_features(data)])])
                size = np.diff(ends, prepend=0)
                z = (total[ends] - total[ends - size]) / (size + FEW) + w[_bins(m)].mean(1) + w[-1]
                carried = [k for k in range(batch.num_columns) if k != 1]
                new = [pa.array(n, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in carried), *new], [*(batch.schema.names[k] for k in carried), "n_words", "score"])

    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{carried}, n_words long, score double")


def _first_by_hash(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """The first `sample` of n rows in the order of a hash of id and text. Hashes above a bound are left out first, so that
    little more than the sample is sorted; that fewer than the sample are left is next to impossible."""
    key = F.xxhash64("id", "text")
    share = (sample + 8 * sample**0.5) / max(n, 1)
    few = rows.filter(key < int(share * 2**64) - 2**63) if share < 1 else rows
    return few.orderBy(key, "id").limit(sample)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = 10_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, score (0 to 1, higher: better), keep (score >= threshold) and the columns to carry; one row per input row.

    The scorer learns from at most `sample` documents, taken by the order of a hash of id and text, and their posteriors;
    measures, votes, the label model and scores are of all documents. Null text counts as empty; empty texts get the
    score of what they lack. Rows of equal or null id are judged each by itself; other columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    voted = measured(rows).select(*(v.alias(f"v{k}") for k, v in enumerate(votes())))
    names = voted.columns
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    posterior = label_model(patterns)
    chosen = stored(_first_by_hash(rows, sum(n for _, n in patterns), sample), "quality-sample")
    by_pattern = docs.sparkSession.createDataFrame([(*map(int, p), x) for p, x in posterior.items()] or [(*[9] * len(names), 0.5)], ", ".join(f"{c} int" for c in names) + ", good double")
    judged = measured(chosen).select("id", *(v.alias(f"v{k}") for k, v in enumerate(votes())))
    labels = judged.join(F.broadcast(by_pattern), names).groupBy("id").agg(F.avg("good").alias("good"))  # at most 3 ** labellers patterns
    fitted = _sampled_features(chosen.join(labels, "id")).collect()
    fitted.sort(key=lambda r: (r["good"], r["keys"], r["values"]))
    own = {c: f"carried_{k}" for k, c in enumerate(carry)}
    judged = scored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in own.items())), fit_scorer(fitted))
    return judged.select(F.col("id").alias(id_col), "n_words", "score", (F.col("score") >= threshold).alias("keep"), *(F.col(x).alias(c) for c, x in own.items()))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
