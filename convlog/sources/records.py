"""Prompt records in two tables: a light index, and the details, which are read only where they are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convlog.operators.frontier import latest_record
from convlog.streaming.buckets import Buckets


def latest_details(index: DataFrame, details: Buckets, logs: DataFrame, table: str = "details") -> DataFrame:
    """The details (conv_id, pos, ...) of the record that stands for each log (conv_id, last_id): the last appended one of the
    index (conv_id, mes_id, pos) with a message id up to the log's last. Only the details' buckets that hold such a log are
    opened; a record without details has no row."""
    wanted = latest_record(index, logs).select("conv_id", "pos")
    return details.read(table, details.touched(wanted)).join(wanted, ["conv_id", "pos"])
