"""All registered queries but those of the optional training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.functions.text import token_estimate
from convlog.operators import chunks, turns
from convlog.plans import job_queries, log_queries, stream_queries, table_queries
from convlog.sources.messages import from_events
from convlog.streaming.refresh import r1_incremental_refresh

QUERIES = {**log_queries.QUERIES, **table_queries.QUERIES, **job_queries.QUERIES, **stream_queries.QUERIES, "r1_incremental_refresh": r1_incremental_refresh}
SQL = {**log_queries.SQL, **table_queries.SQL, **job_queries.SQL, **stream_queries.SQL, "r1_incremental_refresh": log_queries.EDITED_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of each log leave the recency window, in how many chunks, and how many tokens that saves."""
    m = from_events(spark, sf_dir)
    gone = m.join(turns.ready_target(m, 2), "conv_id").filter("message_id <= target")
    plan = chunks.plan_by_turns(gone.select(*m.columns), 2).groupBy("conv_id").agg(F.count("*").alias("chunks"))
    saved = gone.filter("not is_system").groupBy("conv_id").agg(F.count("*").alias("rows_out"), F.sum(token_estimate(F.col("text"))).alias("tokens_out"))
    return saved.join(plan, "conv_id")
