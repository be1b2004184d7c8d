"""The workloads from end to end, as a user calls them; ``python -m fieldlark`` is their command line."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlark.functions.scalars import iso_millis, numbers, rounded
from fieldlark.operators import aggregates as agg, calibrate as cal, clean, lateness, messages as msg, series, sets, validate as val
from fieldlark.plans import catalog
from fieldlark.session import dimension, kept
from fieldlark.sources import readers, writers

READING_TYPES = {"sensor_id": "int", "ts": "timestamp", "ts_unix": "double", "epoch": "bigint", "variable": "string", "value": "double"}


def reading_schema() -> val.Schema:
    return val.Schema(READING_TYPES, checks=(val.isin("variable", clean.CHANNELS),), unique=("sensor_id", "ts", "variable"))


def load(spark: SparkSession, log: str, roster: str, out: str) -> DataFrame:
    """A mote log into a dated Parquet tree; the cleaning report.

    Lines are judged once and kept, as the report and the readings both need
    them. Readings are written only if types, closed list and natural key hold
    and every sensor is on the roster.
    """
    sensors = kept(readers.roster(spark.read.text(roster)))
    began = time.perf_counter()
    judged = kept(clean.judged_log(readers.log_lines(spark, log), sensors))
    readings = val.gate(clean.long_readings(judged), reading_schema(), lazy=True)
    lost = val.orphans(readings, sensors, "sensor_id").count()
    if lost:
        raise val.SchemaError(f"{lost} readings refer to no sensor")
    writers.by_date(readings, out)
    report = clean.cleaning_report(judged)
    extra = spark.createDataFrame([("foreign_key_violations", lost), ("load_milliseconds", round(1000 * (time.perf_counter() - began)))], "metric string, value long")
    return report.union(extra)


def questions(spark: SparkSession, readings: DataFrame, sensors: DataFrame, path=catalog.NAMED) -> dict[str, DataFrame]:
    """Every named query of a file over views readings and sensors."""
    return {n: catalog.run(spark, n, {"readings": readings, "sensors": sensors}, path) for n in catalog.blocks(path.read_text())}


def compare(readings: DataFrame, variable: str) -> dict[str, object]:
    """The mean per sensor from DataFrame, SQL and RDD-free aggregation of sums: milliseconds of each, and the largest gap."""
    rows = readings.where(F.col("variable") == variable).select("sensor_id", "value")
    rows.createOrReplaceTempView("compared")
    spark = readings.sparkSession
    ways = {
        "frame": lambda: agg.mean_per_key(rows),
        "sql": lambda: spark.sql("SELECT sensor_id, avg(value) AS mean FROM compared GROUP BY ALL"),
        "sums": lambda: rows.groupBy("sensor_id").agg((F.sum("value") / F.count("value")).alias("mean")),
    }
    gaps = {n: agg.largest_gap(ways["frame"](), w(), "sensor_id", "mean").first()["max_gap"] for n, w in ways.items()}
    return {"milliseconds": {n: catalog.bench(w) for n, w in ways.items()}, "largest_gap": gaps}


def calibrate(spark: SparkSession, csv: str, seed: int = 0, x: str = "PT08.S1(CO)", y: str = "CO(GT)", runs: str | None = None) -> dict[str, float]:
    """Slope, intercept and held-out R squared of an air-quality CSV; logged if ``runs`` names a store."""
    df = clean.clean_air_quality(readers.comma_csv(spark, csv)).select("timestamp", F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"))
    row = cal.calibrate(df, "x", "y", ["timestamp"], seed).first().asDict()
    if runs:
        writers.log_run(spark, runs, f"seed-{seed}", {"seed": seed, "data": csv}, {"r2": row["r2"]})
    return row


def exposure(df: DataFrame, ts: str, value: str) -> DataFrame:
    """The trapezoid integral over hourly means; hours without a value are left out."""
    return series.trapezoid(series.tumbling(df, ts, "1 hour", {"mean": F.avg(value)}), "bucket", "mean")


def plant(spark: SparkSession, capture: str, ranges: dict[str, tuple[float, float]], statuses: set[str]) -> dict[str, DataFrame | float]:
    """A captured plant stream: decoded, judged, quarantined, deduplicated, with lateness and staleness.

    The order matters: quarantine, then staleness on what was published, then
    dedup, then lateness.
    """
    # Arrival order is the envelope's stamp, then the line itself: files have no order of their own.
    raw = readers.captured(spark, capture).withColumn("line", F.struct(F.col("message.receivedAt"), F.col("raw")))
    first = msg.birth(raw)
    tags = kept(msg.contract(raw))
    decoded = msg.decode(raw, tags)
    bounds = spark.createDataFrame([(u, *r) for u, r in ranges.items()], "unit string, low double, high double")
    good, bad = clean.quarantine(decoded.join(dimension(bounds), "unit", "left"))
    good = kept(good)
    measured = kept(clean.keep_first(good, ["tag", "event_time"], ["received_at", "server_time", "seq"]))
    types = dict(decoded.dtypes)
    schema = val.contract_schema(types, tags, ranges, statuses, clean=True)
    val.gate(measured.select(*types), schema, lazy=True)
    late = lateness.with_lateness(measured)
    return {
        "contract": tags,
        "quarantine": bad,
        "reasons": agg.sizes(bad, "reason"),
        "measured": measured,
        "staleness": lateness.staleness(good, tags, first["sampleIntervalSeconds"]),
        "lag": lateness.lag_by_mode(good),
        "late": late,
        "sweep": lateness.allowance_sweep(late, first["accelerationFactor"]),
        "acceleration": first["accelerationFactor"],
    }


def evidence(spark: SparkSession, first: str, again: str, other: str, runs: str) -> DataFrame:
    """(name, passed) of a reproducibility check over what three runs printed and what the log holds.

    Numbers count as sets, rounded to four digits: a seed run twice prints the
    same ones, another seed others, and a printed number is in the log.
    """

    def printed(text: str) -> DataFrame:
        return spark.createDataFrame([(text,)], "text string").select(F.explode(numbers(F.col("text"))).alias("n")).distinct()

    logged = spark.read.schema(writers.RUN).parquet(runs).select(F.explode(F.map_values("metrics")).alias("n")).select(rounded(F.col("n"), 4).alias("n"))
    a, b, c = map(printed, (first, again, other))
    checks = (("same seed, same numbers", a, b, "equal"), ("other seed, other numbers", a, c, "not equal"), ("a printed number is logged", a, logged, "common > 0"))
    out = [sets.comparison(x, y).select(F.lit(name).alias("name"), F.expr(rule).alias("passed")) for name, x, y, rule in checks]
    return out[0].union(out[1]).union(out[2])


def stamped(df: DataFrame, ts: str) -> DataFrame:
    """``df`` with ``ts`` as ISO text in milliseconds, for reports."""
    return df.withColumn(ts, iso_millis(F.col(ts)))
