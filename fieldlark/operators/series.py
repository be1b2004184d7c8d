"""Ordered series: trailing windows, running maxima, grids, fills, integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldlark.functions.scalars import epoch_seconds
from fieldlark.session import dimension


def trailing_window(df: DataFrame, key: str, ts: str, seconds: int, aggregates: dict[str, Column], chunk: int = 86_400) -> DataFrame:
    """``df`` with each aggregate over the last ``seconds`` up to and with the row's instant, per key.

    Rows of the same instant are in each other's window. One key's series is cut
    into chunks of time, each with the rows just before it as context, so that a
    key of very many rows is many tasks.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / F.lit(chunk * 1_000_000)).cast("long")
    later = F.floor((at + F.lit(seconds * 1_000_000)) / F.lit(chunk * 1_000_000)).cast("long")
    rows = df.select("*", at.alias("_at"), own.alias("_own"), F.explode(F.sequence(own, later)).alias("_chunk"))
    frame = Window.partitionBy(key, "_chunk").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    rows = rows.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))
    return rows.where("_chunk = _own").drop("_at", "_own", "_chunk")


def running_max(df: DataFrame, order: str, value: str, name: str, before: bool = True, block: str = "HOUR") -> DataFrame:
    """``df`` with the largest ``value`` of rows before each (or up to it), by ``order``; rows of one instant count as one.

    Blocks of time run side by side; only one row a block meets in one task.
    """
    cut = F.date_trunc(block, F.col(order))
    frontier = df.groupBy(cut.alias("_block"), F.col(order).alias("_order")).agg(F.max(value).alias("_top"))
    tops = frontier.groupBy("_block").agg(F.max("_top").alias("_top"))
    carried = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    frontier = frontier.withColumn("_inside", F.max("_top").over(inside)).join(carried, "_block", "left")
    frontier = frontier.select("_order", F.greatest("_inside", "_carried").alias(name))
    return df.join(frontier, F.col(order).eqNullSafe(F.col("_order")), "left").drop("_order")


def steps(df: DataFrame, key: str, ts: str, block: str = "DAY") -> DataFrame:
    """``df`` with since_us and step_us: microseconds since the key's first instant, and since the row before (null for the first).

    Blocks of time run side by side; one row a key and block carries the last
    instant over.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select("*", F.col(key).alias("_key"), F.date_trunc(block, F.col(ts)).alias("_block"), at.alias("_at"))
    ends = rows.groupBy("_key", "_block").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    whole = Window.partitionBy("_key")
    ends = ends.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.min("_low").over(whole).alias("_first"), F.lag("_high").over(whole.orderBy("_block")).alias("_last"))
    before = F.lag("_at").over(Window.partitionBy("_key", "_block").orderBy("_at"))
    out = rows.withColumn("_before", before).join(ends, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b")))
    return out.select(*df.columns, (F.col("_at") - F.col("_first")).alias("since_us"), (F.col("_at") - F.coalesce("_before", "_last")).alias("step_us"))


def grid(df: DataFrame, ts: str, interval: str, chunk: int = 10_000) -> DataFrame:
    """(ts) from the first to the last instant of ``df`` at a fixed interval; nothing for an empty table.

    Starts of ``chunk`` instants are dealt to tasks first, and each is filled
    in where it lies.
    """
    ends = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).where("_a is not null")
    starts = ends.select("_b", F.explode(F.expr(f"sequence(_a, _b, interval {interval} * {chunk})")).alias("_s")).repartition("_s")
    last = F.expr(f"least(_b, _s + interval {interval} * {chunk - 1})")
    return starts.withColumn("_b", last).select(F.explode(F.expr(f"sequence(_s, _b, interval {interval})")).alias(ts))


def on_grid(df: DataFrame, tag: str, ts: str, value: str, tags: DataFrame, interval: str) -> DataFrame:
    """(tag, ts, value) for every tag at every instant of the grid; instants off the grid go."""
    cells = grid(df, ts, interval).crossJoin(dimension(tags.select(tag).distinct()))
    return cells.join(df.select(tag, ts, value), [tag, ts], "left")


def forward_fill(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``df`` with ``was_empty`` and ``value`` carried forward within the key; what has nothing before it stays null.

    Chunks of a day fill side by side; the last value of each earlier day comes
    in by a window over one row a key and day.
    """
    rows = df.withColumn("_day", F.to_date(ts))
    last = rows.where(F.col(value).isNotNull()).groupBy(key, "_day").agg(F.max_by(value, ts).alias("_last"))
    days = rows.select(key, "_day").distinct().join(last, [key, "_day"], "left")
    carried = days.select(key, "_day", F.last("_last", True).over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy(key, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("was_empty", F.col(value).isNull()).withColumn("_inside", F.last(value, True).over(inside)).join(carried, [key, "_day"], "left")
    return rows.withColumn(value, F.coalesce("_inside", "_carried")).drop("_day", "_inside", "_carried")


def wide(df: DataFrame, ts: str, tag: str, value: str, tags: list[str]) -> DataFrame:
    """One row an instant, one column a tag in the order given; needs one value a cell."""
    return df.groupBy(ts).pivot(tag, tags).agg(F.first(value, True))


def tumbling(df: DataFrame, ts: str, width: str, aggregates: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bucket, aggregates) over windows aligned to the epoch; empty windows are absent."""
    out = df.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), width).alias("_w")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(*keys, F.col("_w.start").alias("bucket"), *aggregates)


def with_empty_windows(windows: DataFrame, width: str) -> DataFrame:
    """``windows`` (bucket, ...) with the missing ones from the first to the last, their aggregates null."""
    return grid(windows, "bucket", width).join(windows, "bucket", "left")


def trapezoid(df: DataFrame, ts: str, value: str, keys: tuple[str, ...] = ()) -> Column | DataFrame:
    """(keys, area): the trapezoid integral of ``value`` over hours; null values are left out first."""
    order = Window.partitionBy(*keys).orderBy("_s")
    rows = df.where(F.col(value).isNotNull()).select(*keys, (epoch_seconds(F.col(ts))).alias("_s"), F.col(value).alias("_v"))
    rows = rows.select(*keys, "_s", "_v", F.lag("_s").over(order).alias("_s0"), F.lag("_v").over(order).alias("_v0"))
    area = F.sum((F.col("_v") + F.col("_v0")) / 2 * ((F.col("_s") - F.col("_s0")) / 3600))
    return rows.groupBy(*keys).agg(F.coalesce(area, F.lit(0.0)).alias("area"))
