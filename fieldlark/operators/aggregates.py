"""Aggregations over readings (sensor_id, ts, variable, value) and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.functions.scalars import hour_label, rounded
from fieldlark.session import dimension


def hourly_mean(readings: DataFrame, variable: str) -> DataFrame:
    """(sensor_id, hour, n, avg_value) of one variable, hours as text, means at two digits."""
    rows = readings.where(F.col("variable") == variable)
    return rows.groupBy("sensor_id", hour_label(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"), rounded(F.avg("value"), 2).alias("avg_value"))


def missing_intervals(roster: DataFrame, readings: DataFrame, every: float = 30.0, top: int | None = 5) -> DataFrame:
    """(sensor_id, expected, received, missing): distinct instants against one every ``every`` seconds of the whole span.

    Silent sensors of the roster count as having none. Most missing first, then
    by sensor, those without an id last; ``top`` rows, or all.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = readings.agg(F.expr(f"cast((max(unix_micros(cast(ts as timestamp))) - min(unix_micros(cast(ts as timestamp)))) / 1e6D / {float(every)}D as bigint)").alias("expected"))
    got = readings.groupBy("sensor_id").agg(F.countDistinct(micros).alias("n"))
    out = roster.select("sensor_id").join(got, "sensor_id", "left").crossJoin(F.broadcast(span))
    out = out.select("sensor_id", "expected", F.coalesce("n", F.lit(0)).alias("received"), (F.col("expected") - F.coalesce("n", F.lit(0))).alias("missing"))
    out = out.orderBy(F.desc("missing"), F.asc_nulls_last("sensor_id"))
    return out.limit(top) if top else out


def outside_bounds(readings: DataFrame, bounds: DataFrame) -> DataFrame:
    """(variable, n_rows, n_sensors, lowest, highest) of values outside ``bounds`` (variable, low, high); clean variables give no row."""
    out = readings.join(dimension(bounds), "variable").where("value not between low and high")
    return out.groupBy("variable").agg(F.count("*").alias("n_rows"), F.countDistinct("sensor_id").alias("n_sensors"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def mean_per_key(df: DataFrame, key: str = "sensor_id", value: str = "value") -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def largest_gap(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(keys, max_gap): keys in common and the largest absolute difference of two results."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count("*").alias("keys"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_gap"))


def sizes(df: DataFrame, *keys: str, dropna: bool = True) -> DataFrame:
    """(keys, n), largest first; rows with a null key count only without ``dropna``."""
    rows = df.na.drop(subset=list(keys)) if dropna else df
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` against ``values`` of ``column``, zeros filled in."""
    names = [str(v).lower() for v in values]
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)))


def quantiles(df: DataFrame, value: str, probs: tuple[float, ...], blocks: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles by linear interpolation, a column a probability; nulls do not count.

    One row without ``keys``, else one for each of their values that has a
    value. Distinct values and their counts are ranked in blocks of about equal
    size, so no task holds all values of a key. Only block borders and block
    sizes, ``blocks`` rows a key, meet in one place.
    """
    key = F.struct(*(F.col(k).alias(k) for k in keys)) if keys else F.lit(0)
    rows = df.select(key.alias("_k"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = rows.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    cuts = F.array_distinct(F.percentile_approx("_v", [k / blocks for k in range(1, blocks)], 10 * blocks)) if blocks > 1 else F.array().cast("array<double>")
    borders = rows.groupBy("_k").agg(cuts.alias("_borders"))
    counts = counts.join(borders, "_k").select("_k", "_v", "_n", F.size(F.filter("_borders", lambda b: b < F.col("_v"))).alias("_block"))
    sizes = counts.groupBy("_k", "_block").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_k", "_block", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy("_k")).alias("_all"))
    inside = Window.partitionBy("_k", "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(sizes, ["_k", "_block"]).select("_k", "_v", "_all", "_n", (F.col("_before") + F.sum("_n").over(inside)).alias("_to"))
    out = []
    for k, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_all") - 1)
        # The values at ranks floor(at) and ceil(at), counted from zero.
        low = F.min(F.when(F.col("_to") > F.floor(at), F.col("_v")))
        high = F.min(F.when(F.col("_to") > F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{k}"))
    return ranked.groupBy("_k").agg(*out).select("_k.*", *(f"q{k}" for k in range(len(probs)))) if keys else ranked.agg(*out)


def describe(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles by linear interpolation, largest."""
    out = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = out.crossJoin(F.broadcast(quantiles(df, value, (0.25, 0.5, 0.75))))
    r = lambda c: rounded(F.col(c), digits)
    return out.select("count", r("mean").alias("mean"), r("std").alias("std"), "min", *(r(f"q{i}").alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "max")


def arity_histogram(lines: DataFrame) -> DataFrame:
    """(splitter, fields, n): fields a line under one-space and any-blank splitting, in one pass."""
    one, blank = F.size(F.split("value", " ", -1)), F.size(F.split(F.trim("value"), r"\s+"))
    both = lines.select(F.explode(F.array(F.struct(F.lit("one_space").alias("splitter"), one.alias("fields")), F.struct(F.lit("any_blank").alias("splitter"), blank.alias("fields")))).alias("x"))
    return both.groupBy("x.splitter", "x.fields").agg(F.count("*").alias("n"))


def channel_range(long: DataFrame) -> DataFrame:
    """(variable, lowest, highest) of long readings."""
    return long.groupBy("variable").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))


def rows_per_measurement(kept: DataFrame, tag: str = "tag", at: str = "event_time") -> DataFrame:
    """(tag, rows_received, measurements, published_per_measurement)."""
    out = kept.groupBy(tag).agg(F.count("*").alias("rows_received"), F.countDistinct(at).alias("measurements"))
    return out.withColumn("published_per_measurement", rounded(F.col("rows_received") / F.col("measurements"), 2))


def both_ends(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first and last ``n`` rows by ``order`` (columns by name, ascending)."""
    back = [F.desc(o) for o in order]
    return df.orderBy(*order).limit(n).unionByName(df.orderBy(*back).limit(n))


def hole_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells, empty, percent) of long cells with ``was_empty``."""
    out = cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if("was_empty").alias("empty"))
    return out.withColumn("percent", rounded(100 * F.col("empty") / F.col("cells"), 2))


def complete_rows(cells: DataFrame, ts: str) -> DataFrame:
    """(instants, complete): grid instants, and those without an empty cell."""
    per = cells.groupBy(ts).agg(F.bool_or("was_empty").alias("holes"))
    return per.agg(F.count("*").alias("instants"), F.count_if(~F.col("holes")).alias("complete"))
