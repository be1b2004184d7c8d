"""Writing: partitioned Parquet, managed tables, samples and the run log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN = "run_id string, run_name string, start_time timestamp, params map<string, string>, metrics map<string, double>"


def by_date(readings: DataFrame, path: str, ts: str = "ts") -> None:
    """Every column plus ``date`` of ``ts``, partitioned by it; an older tree there is replaced.

    Rows are dealt by date and rebalanced by size, so that a quiet day is one
    file and a busy one as many as its bytes ask for. Files are sorted by
    sensor and time, so that Parquet statistics skip row groups.
    """
    dated = readings.withColumn("date", F.to_date(ts))
    keys = [c for c in ("sensor_id", ts) if c in readings.columns]
    dealt = dated.hint("rebalance", "date")
    dealt.sortWithinPartitions("date", *keys).write.mode("overwrite").partitionBy("date").parquet(path)


def rebuild(df: DataFrame, table: str) -> None:
    """A managed Parquet table, made anew."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def text_sample(lines: DataFrame, path: str, n: int, *order: str) -> None:
    """The first ``n`` lines as a text file."""
    (lines.orderBy(*order) if order else lines).limit(n).select("value").write.mode("overwrite").text(path)


def log_run(spark: SparkSession, store: str, name: str, params: dict[str, object], metrics: dict[str, float]) -> None:
    """Adds a run to the log."""
    p = F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv])
    m = F.create_map(*[F.lit(x) for k, v in metrics.items() for x in (k, float(v))])
    row = spark.range(1).select(F.uuid().alias("run_id"), F.lit(name).alias("run_name"), F.current_timestamp().alias("start_time"), p.alias("params"), m.alias("metrics"))
    row.write.mode("append").parquet(store)


def runs(spark: SparkSession, store: str, want: tuple[str, ...] = ("run_id", "start_time", "params.seed", "params.data"), most: int = 10, metrics: int = 2) -> DataFrame:
    """The newest ``most`` runs: the wanted columns that exist, and at most ``metrics`` metrics."""
    log = spark.read.schema(RUN).parquet(store).orderBy(F.desc("start_time"), "run_id").limit(most)
    keys = {f"{m}.{r[0]}" for m in ("params", "metrics") for r in log.select(F.explode(F.map_keys(m))).distinct().collect()}
    cols = [c for c in want if c in log.columns or c in keys] + sorted(k for k in keys if k.startswith("metrics."))[:metrics]
    return log.select(*(F.col(c.split(".")[0])[c.split(".")[1]].alias(c) if "." in c else F.col(c) for c in cols))


def preview(df: DataFrame, n: int = 5) -> tuple[int, float, list]:
    """(rows, seconds, first rows), printed."""
    began = time.perf_counter()
    rows, first = df.count(), df.limit(n).collect()
    took = time.perf_counter() - began
    print(f"{rows:,} rows in {took:.2f} s")
    print(" | ".join(df.columns))
    for r in first:
        print(" | ".join(map(str, r)))
    return rows, took, first
