"""Message logs: (conv_id, message_id, is_user, is_system, name, text), message_id dense from 0 in each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "message_id", "is_user", "is_system", "name", "text"]


def from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns by role."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return _messages(t, F.col("conv_id"), [F.col("turn")], F.col("role"), F.col("role") == "user", F.col("role") == "system", F.col("text"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a long log: views and clicks ask, purchases and sign-ups answer, errors are system rows."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return _messages(t, F.col("user_id"), [F.col("ts"), F.col("event_id")], kind, kind.isin("view", "click"), kind == "error", F.col("props"))


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents in turn, asking and answering alternately; long texts for the limits on characters."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.pmod(F.col("doc_id"), F.lit(40)) >= 20
    return _messages(t, F.col("source"), [F.col("doc_id")], F.when(odd, "answer").otherwise("question"), ~odd, F.lit(False), F.col("text"))


def _messages(t: DataFrame, conv: Column, order: list[Column], name: Column, is_user: Column, is_system: Column, text: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(conv).orderBy(*order)) - 1
    return t.select(conv.alias("conv_id"), place.cast("long").alias("message_id"), is_user.alias("is_user"), is_system.alias("is_system"), name.alias("name"), text.alias("text"))
