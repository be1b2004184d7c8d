"""Set comparisons of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks, sorted."""
    return a.subtract(b).orderBy(*a.columns)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have, sorted."""
    return a.intersect(b).orderBy(*a.columns)


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, common, equal) counts of distinct rows, from one shuffle."""
    both = a.select(*a.columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(*b.columns, F.lit(0), F.lit(1)))
    per = both.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = per.agg(F.count_if(F.expr("_a > _b")).alias("only_a"), F.count_if(F.expr("_b > _a")).alias("only_b"), F.count_if(F.expr("_a = 1 and _b = 1")).alias("common"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def require_none(df: DataFrame, message: str) -> None:
    """Raises if there is a row, naming a few."""
    rows = df.limit(10).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")
