"""Decoding captured messages: the contract, and one row a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from fieldlark.functions.scalars import milliseconds
from fieldlark.session import dimension


def birth(captured: DataFrame, order: str = "line") -> Row | None:
    """The first birth payload in arrival order, or None: the stream's constants and tags."""
    return captured.where("message.payload.type = 'birth'").orderBy(order).select("message.payload.*").first()


def contract(captured: DataFrame, order: str = "line") -> DataFrame:
    """(tag, unit, analyser_interval_hours, dead_time_hours) of the first birth message; absent fields are null."""
    first = captured.where("message.payload.type = 'birth'").orderBy(order).limit(1)
    return first.select(F.inline("message.payload.tags")).select(F.col("name").alias("tag"), "unit", F.col("analyserIntervalHours").alias("analyser_interval_hours"), F.col("deadTimeHours").alias("dead_time_hours"))


def decode(captured: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, value, status, event_time, seq, server_time, is_historical, received_at, unit) of telemetry, one row a metric.

    The envelope is copied down; a payload's own ``receivedAt`` comes before
    the envelope's. Clocks are cut to milliseconds. A message without metrics
    gives no row, a tag that ``tags`` (tag, unit) lacks a null unit.
    """
    telemetry = captured.where(F.col("message.topic").endswith("/telemetry"))
    rows = telemetry.select(
        F.coalesce("message.payload.receivedAt", "message.receivedAt").alias("r"), F.col("message.payload.timestamp").alias("s"), F.col("message.payload.seq").alias("seq"), F.col("message.payload.isHistorical").alias("is_historical"), F.explode("message.payload.metrics").alias("m")
    )
    ms = lambda c: milliseconds(F.to_timestamp(c))
    rows = rows.select(
        F.col("m.name").alias("tag"), "m.value", F.col("m.statusCode").alias("status"), ms("m.sourceTimestamp").alias("event_time"), "seq", ms("s").alias("server_time"), "is_historical", ms("r").alias("received_at")
    )
    return rows.join(dimension(tags.select("tag", "unit")), "tag", "left")
