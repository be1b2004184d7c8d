"""Calibration: a seeded split, least squares on the one part, R squared on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _place(seed: int, keys: list[str]) -> Column:
    """60 bits of the MD5 of seed and keys, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), 1, 15), 16, 10).cast("long")


def seeded_split(df: DataFrame, seed: int, keys: list[str], share: float = 0.25) -> DataFrame:
    """``df`` with ``is_test``: exactly ceil(share * n) rows, chosen by a hash of seed and ``keys``.

    The choice depends on seed and keys alone, not on partitions. Rows are
    ranked by counting: hashes fall into 4096 ranges whose sizes tell which
    range holds the border, and only that range is sorted. ``keys`` must tell
    rows apart.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_h", _place(seed, keys)).withColumn("_range", F.shiftright("_h", 48))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_range"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    # 4096 rows at most, so one task.
    ranges = ranges.select("_range", (upto - F.col("_n")).alias("_before"), (total - F.ceil(total * share)).alias("_train"))
    rows = rows.join(F.broadcast(ranges), "_range")
    border = Window.partitionBy("_range").orderBy("_h", *keys)
    return rows.withColumn("is_test", F.col("_before") + F.row_number().over(border) > F.col("_train")).drop("_h", "_range", "_before", "_train")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of ``y`` on ``x``, from one aggregation."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def r_squared(test: DataFrame, line: DataFrame, x: str, y: str) -> DataFrame:
    """(r2): 1 - SSE / SST of ``line`` (slope, intercept) on rows it was not fitted to."""
    scored = test.crossJoin(F.broadcast(line)).select(F.col(y).alias("_y"), (F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).alias("_e"))
    return scored.agg((1 - F.sum(F.col("_e") * F.col("_e")) / F.nullif(F.var_pop("_y") * F.count("_y"), F.lit(0.0))).alias("r2"))


def calibrate(df: DataFrame, x: str, y: str, keys: list[str], seed: int = 0) -> DataFrame:
    """(slope, intercept, r2) with a seeded 75/25 split of the rows that have both values."""
    split = seeded_split(df.na.drop(subset=[x, y]), seed, keys)
    line = ols(split.where("not is_test"), x, y)
    return line.crossJoin(F.broadcast(r_squared(split.where("is_test"), line, x, y)))


def fit_many(df: DataFrame, features: list[str], y: str):
    """Least squares on several features; a fitted ``LinearRegressionModel``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.na.drop(subset=[*features, y]))
    return LinearRegression(labelCol=y).fit(rows)
