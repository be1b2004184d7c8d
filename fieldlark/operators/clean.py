"""Cleaning: the log's reject cascade, sentinels, empty rows and columns, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.functions.scalars import epoch_seconds, no_nan, strict_float, strict_instant, strict_int

CHANNELS = ("temperature", "humidity", "light", "voltage")
REASONS = ("ragged", "no_mote", "off_roster", "unparseable")
MOTES = (1, 54)


def log_fields(lines: DataFrame, sep: str = " ") -> DataFrame:
    """``lines`` (value) with the array ``f``: one separator between fields, empty ones kept."""
    return lines.withColumn("f", F.split("value", sep, -1))


def judged_log(lines: DataFrame, roster: DataFrame, motes: tuple[int, int] | None = MOTES) -> DataFrame:
    """Log lines as (mote, ts, epoch, CHANNELS..., n_empty, reason); reason is that of the first rule broken.

    In order: not eight fields; a mote id that is not digits; one outside
    ``motes`` or not in ``roster`` (sensor_id); anything else unparseable.
    Accepted lines have a null reason. The roster is a dimension of a few
    sensors; its ids join as one small relation.
    """
    f = log_fields(lines).select("value", *(F.get("f", F.lit(i)).alias(f"f{i}") for i in range(8)), F.size("f").alias("n"))
    f = f.withColumn("mote", F.when(F.col("f3").rlike("^[0-9]+$"), strict_int(F.col("f3"))))
    known = roster.select(F.col("sensor_id").cast("long").alias("mote"), F.lit(True).alias("known")).distinct()
    f = f.join(known, "mote", "left")
    f = f.withColumn("ts", strict_instant(F.col("f0"), F.col("f1"))).withColumn("epoch", strict_int(F.col("f2")))
    broken = F.col("ts").isNull() | F.col("epoch").isNull()
    for i, c in enumerate(CHANNELS):
        cell = F.col(f"f{4 + i}")
        f = f.withColumn(c, strict_float(cell))
        broken = broken | ((cell != "") & F.col(c).isNull())
    outside = F.col("known").isNull()
    if motes:
        outside = outside | ~F.col("mote").between(*motes)
    reason = F.when(F.col("n") != 8, "ragged").when(~F.col("f3").rlike("^[0-9]+$"), "no_mote").when(outside, "off_roster").when(broken, "unparseable")
    empty = sum((F.col(f"f{4 + i}") == "").cast("int") for i in range(4))
    return f.select("mote", "ts", "epoch", *CHANNELS, empty.alias("n_empty"), reason.alias("reason"))


def long_readings(judged: DataFrame) -> DataFrame:
    """(sensor_id, ts, ts_unix, epoch, variable, value) of accepted lines; an empty cell gives no row."""
    ok = judged.where("reason is null").select(F.col("mote").cast("int").alias("sensor_id"), "ts", epoch_seconds(F.col("ts")).alias("ts_unix"), "epoch", *CHANNELS)
    return ok.unpivot(["sensor_id", "ts", "ts_unix", "epoch"], list(CHANNELS), "variable", "value").where("value is not null")


def cleaning_report(judged: DataFrame, low_battery: float = 2.4) -> DataFrame:
    """(metric, value) of a load, from one pass over the judged lines."""
    ok = F.col("reason").isNull()
    metrics = {
        "rows_in_file": F.count("*"),
        "ragged_rows": F.count_if(F.col("reason") == "ragged"),
        "rejected_empty_moteid": F.count_if(F.col("reason") == "no_mote"),
        "rejected_off_roster": F.count_if(F.col("reason") == "off_roster"),
        "rejected_unparseable": F.count_if(F.col("reason") == "unparseable"),
        "rows_accepted": F.count_if(ok),
        "absent_channel_cells": F.coalesce(F.sum(F.when(ok, F.col("n_empty"))), F.lit(0)),
        "readings_loaded": F.coalesce(F.sum(F.when(ok, 4 - F.col("n_empty"))), F.lit(0)),
        "voltage_below_limit": F.count_if(ok & (F.col("voltage") < low_battery)),
    }
    row = judged.agg(*(c.cast("long").alias(n) for n, c in metrics.items()))
    return row.unpivot([], list(metrics), "metric", "value")


def sentinel_to_null(df: DataFrame, sentinel: float = -200.0) -> DataFrame:
    """The sentinel, and NaN, become null in every numeric column."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    return df.select(*(F.nullif(no_nan(F.col(f"`{c}`")), F.lit(sentinel)).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that are null in every row go. Runs one aggregation, as the schema depends on the data."""
    seen = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if seen[c]))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows that are null, or NaN, in every column go."""
    there = F.lit(False)
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        there = there | (col.isNotNull() & ~F.isnan(col) if t in ("double", "float") else col.isNotNull())
    return df.where(there)


def clean_air_quality(df: DataFrame, date: str = "Date", time: str = "Time") -> DataFrame:
    """Empty columns and then rows dropped, ``timestamp`` from ``dd/MM/yyyy`` and ``HH.mm.ss`` (broken ones raise), -200 as null."""
    df = drop_empty_rows(drop_empty_columns(df))
    at = F.to_timestamp(F.concat_ws(" ", F.col(date), F.col(time)), "dd/MM/yyyy HH.mm.ss")
    return sentinel_to_null(df.withColumn("timestamp", at))


def with_reason(df: DataFrame, low: str = "low", high: str = "high", value: str = "value", status: str = "status") -> DataFrame:
    """``df`` with ``reason``, null for rows to keep. The device's flag comes before the range.

    A row without a unit range (low, high null) is quarantined for that, so an
    undeclared tag stops nothing.
    """
    flagged = ~F.col(status).eqNullSafe(F.lit("Good"))
    outside = F.col(value).isNotNull() & ~F.col(value).between(F.col(low), F.col(high))
    unknown = F.col(low).isNull() | F.col(high).isNull()
    reason = F.when(flagged, F.concat(F.lit("the device flagged it: "), F.coalesce(F.col(status), F.lit("no status")))).when(unknown, "no range for its unit").when(outside, "outside the range for its unit")
    return df.withColumn("reason", reason)


def quarantine(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): the rows without a reason, and the others with theirs."""
    judged = with_reason(df, **columns)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows that agree on ``keys`` the first in ``order``.

    ``min_by`` combines before the shuffle, so a value republished very often
    costs one row a task. The columns of ``order`` must tell rows apart.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_first")).select(*keys, "_first.*").select(*df.columns)
