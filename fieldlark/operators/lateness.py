"""Three clocks: staleness against the contract, watermarks, lateness and its price."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldlark.functions.scalars import clipped, minutes_between, rounded, seconds_between
from fieldlark.operators.aggregates import quantiles
from fieldlark.operators.series import running_max
from fieldlark.session import dimension

ALLOWANCES = (0, 15, 30, 45, 60, 90, 120, 180)


def with_lateness(readings: DataFrame) -> DataFrame:
    """``readings`` with watermark_before, lateness_min and late.

    The watermark is the newest event time of all arrivals before the row's own
    ``received_at``. Lateness is at least zero and null where nothing had
    arrived; such a row is not late.
    """
    out = running_max(readings, "received_at", "event_time", "watermark_before")
    out = out.withColumn("lateness_min", clipped(minutes_between(F.col("watermark_before"), F.col("event_time"))))
    return out.withColumn("late", F.coalesce(F.col("lateness_min") > 0, F.lit(False)))


def allowance_sweep(late: DataFrame, acceleration: float, allowances: tuple[int, ...] = ALLOWANCES) -> DataFrame:
    """(allowance_plant_min, your_wall_clock_s, dropped_as_late, percent_lost), from one pass."""
    counts = late.agg(F.count("*").alias("n"), *(F.count_if(F.col("lateness_min") > a).alias(f"d{a}") for a in allowances))
    rows = F.array(*(F.struct(F.lit(a).alias("allowance_plant_min"), rounded(F.lit(a * 60.0) / acceleration, 1).alias("your_wall_clock_s"), F.col(f"d{a}").alias("dropped_as_late"), rounded(100 * F.col(f"d{a}") / F.nullif(F.col("n"), F.lit(0)), 2).alias("percent_lost")) for a in allowances))
    return counts.select(F.inline(rows))


def with_lag(published: DataFrame) -> DataFrame:
    """``published`` with lag_s, publish time less event time. To be taken before republished values are dropped."""
    return published.withColumn("lag_s", seconds_between(F.col("server_time"), F.col("event_time")))


def staleness(published: DataFrame, contract: DataFrame, sample_s: float) -> DataFrame:
    """(tag, analyser_interval_hours, predicted_max_lag_s, observed_max_lag_s, agrees) over live rows."""
    observed = with_lag(published).where("not is_historical").groupBy("tag").agg(F.max("lag_s").alias("observed_max_lag_s"))
    predicted = F.greatest(F.coalesce("analyser_interval_hours", F.lit(0.0)) * 3600 - sample_s, F.lit(0.0))
    out = observed.join(dimension(contract.select("tag", "analyser_interval_hours", predicted.alias("predicted_max_lag_s"))), "tag")
    return out.select("tag", "analyser_interval_hours", "predicted_max_lag_s", "observed_max_lag_s", (F.col("predicted_max_lag_s") == F.col("observed_max_lag_s")).alias("agrees"))


def lag_by_mode(published: DataFrame) -> DataFrame:
    """(is_historical, n, percent, median_lag_min, max_lag_min): replayed against live rows."""
    rows = with_lag(published)
    out = rows.groupBy("is_historical").agg(F.count("*").alias("n"), (F.max("lag_s") / 60).alias("max_lag_min"))
    middle = quantiles(rows, "lag_s", (0.5,), keys=("is_historical",)).select(F.col("is_historical").alias("_k"), (F.col("q0") / 60).alias("median_lag_min"))
    out = out.join(middle, F.col("is_historical").eqNullSafe(F.col("_k")), "left")
    total = published.agg(F.count("*").alias("total"))
    out = out.crossJoin(F.broadcast(total))
    return out.select("is_historical", "n", rounded(100 * F.col("n") / F.col("total"), 2).alias("percent"), rounded(F.col("median_lag_min"), 6).alias("median_lag_min"), rounded(F.col("max_lag_min"), 6).alias("max_lag_min"))
