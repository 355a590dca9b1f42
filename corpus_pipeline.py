"""A corpus pipeline: quality, line dedup, near duplicates, mixing, encoding. Each stage works on all that the one before
it kept; each writes its documents and the next reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.llm.byte_bpe import encode_digests
from convlog.llm.common import scratch_dir, small, stored, table
from convlog.llm.line_dedup import line_dedup
from convlog.llm.mixing import mix
from convlog.llm.ngram_join import ngram_join
from convlog.llm.quality import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier keeps, each judged by its own text; null texts count as empty ones."""
    return quality(docs, carry=("text", "lang", "source", "n_chars")).filter("keep").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that came before in the corpus; a text without any other line stays empty. Null texts
    become empty, rows without id stay whole, rows of equal id and text lose the same lines."""
    told = line_dedup(docs, least=1, carry=("lang", "source", "n_chars"))
    n = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return told.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n.alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) the document of smallest id, and that once:
    of rows of one id and text one stays. Rows without id are alike to nothing and stay; empty texts stay too."""
    placed = stored(ngram_join(docs, words=5, percent=80).filter("doc_id is not null"), "near-duplicates")
    gone = stored(placed.filter("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    kept = docs.select(*COLUMNS).join(small(gone, 500_000), "doc_id", "left_anti")
    twice = stored(placed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "near-repeated")
    if twice.isEmpty():
        return kept
    again = small(twice, 500_000)
    once = kept.join(again, "doc_id", "left_semi").withColumn("print", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "print"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once.drop("print"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows that agree in id, text and source share their copies; rows without id
    are told apart by text and source."""
    key = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "source")
    keyed = docs.select(*COLUMNS, key.alias("key"))
    copies = mix(keyed, id_col="key").groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = stored(copies.filter("copies > 0 or rows > 1"), "mix-copies")
    taken = keyed.join(copies.withColumnRenamed("key", "same"), F.col("key") == F.col("same"))
    if not copies.filter("rows > 1").isEmpty():  # equal rows: one of them stands for all
        taken = taken.filter("rows = 1").unionByName(taken.filter("rows > 1").dropDuplicates(["key"]))
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, of each row; null texts count as empty."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return encode_digests(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None  # weak labels, edit distance, entropy balancing and BPE aren't SQL; the tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
