"""Telemetry stand-ins made from the test tables, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlark.functions.scalars import utc
from fieldlark.session import dimension
from fieldlark.sources.readers import tables

BOUNDS = (("click", 0.0, 150.0), ("view", 0.0, 120.0), ("signup", 1.0, 400.0), ("purchase", 0.5, 90.0))
UNITS = {"pct": (0.0, 150.0), "degc": (0.0, 120.0), "kw": (1.0, 400.0), "kgph": (0.5, 90.0), "kpa": (0.0, 200.0)}
#: tag, unit, hours between analyses (none: continuous), dead time.
CONTRACT = (("click", "pct", None, None), ("view", "degc", None, None), ("signup", "kw", 0.25, 0.05), ("purchase", "kgph", 0.1, 0.05), ("error", "kpa", None, None))
STATUSES = {"Good", "Uncertain_SensorNotAccurate", "Bad_DeviceFailure"}
SAMPLE_S, ACCELERATION, REPEATS = 180.0, 60.0, 3
SILENT = (5, 15)


def _sql_rows(rows) -> str:
    cell = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, float) else f"CAST({v} AS DOUBLE)"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


#: SQL common table expressions, by name, that the oracles share.
SQL = {
    "readings": "readings AS (SELECT user_id AS sensor_id, ts, event_id, event_type AS variable, value FROM events)",
    "bounds": f"bounds(variable, low, high) AS (VALUES {_sql_rows(BOUNDS)})",
    "units": f"units(unit, low, high) AS (VALUES {_sql_rows((u, *r) for u, r in UNITS.items())})",
    "contract": f"contract(tag, unit, analyser_interval_hours, dead_time_hours) AS (VALUES {_sql_rows(CONTRACT)})",
    "published": """published AS (
        SELECT event_type AS tag,
               CASE WHEN event_id % 53 <> 0 THEN value END AS value,
               CASE WHEN event_id % 53 = 0 THEN 'Bad_DeviceFailure' WHEN event_id % 37 = 0 THEN 'Uncertain_SensorNotAccurate' ELSE 'Good' END AS status,
               date_trunc('millisecond', ts) AS event_time,
               CAST((event_id + r) % 256 AS INTEGER) AS seq,
               date_trunc('millisecond', ts) + to_seconds(CAST(event_id % 900 + 180 * r AS DOUBLE)) AS server_time,
               event_id % 10 = 0 AS is_historical,
               date_trunc('millisecond', ts) + to_seconds(CAST((event_id * 7919) % 10800 + r AS DOUBLE)) AS received_at,
               event_id, r
        FROM events, range(3) AS t(r) WHERE r = 0 OR event_type IN ('signup', 'purchase'))""",
    "judged": """judged AS (
        SELECT p.*, c.unit, u.low, u.high,
               CASE WHEN status IS DISTINCT FROM 'Good' THEN 'the device flagged it: ' || status
                    WHEN u.low IS NULL THEN 'no range for its unit'
                    WHEN value IS NOT NULL AND NOT (value BETWEEN u.low AND u.high) THEN 'outside the range for its unit' END AS reason
        FROM published AS p LEFT JOIN contract AS c USING (tag) LEFT JOIN units AS u ON c.unit = u.unit)""",
    "kept": "kept AS (SELECT * FROM judged WHERE reason IS NULL)",
    "measured": "measured AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY tag, event_time ORDER BY received_at, event_id, r) = 1)",
    "late": """late AS (
        SELECT m.*, f.watermark_before,
               CASE WHEN f.watermark_before IS NOT NULL THEN greatest((epoch_us(f.watermark_before) - epoch_us(m.event_time)) / CAST(6e7 AS DOUBLE), 0) END AS lateness_min
        FROM measured AS m JOIN (
            SELECT received_at, max(top) OVER (ORDER BY received_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark_before
            FROM (SELECT received_at, max(event_time) AS top FROM measured GROUP BY received_at)) AS f USING (received_at))""",
    "log": """log AS (
        SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id % 60 END AS mote,
               event_id % 131 = 0 AS ragged, event_id % 211 = 0 AS bad_cell, event_id % 7 = 0 AS no_humidity, event_id % 41 = 0 AS no_voltage FROM events)""",
    "judged_log": """judged_log AS (
        SELECT *, CASE WHEN ragged THEN 'ragged' WHEN mote IS NULL THEN 'no_mote' WHEN mote NOT BETWEEN 1 AND 54 OR mote IN (5, 15) THEN 'off_roster' WHEN bad_cell THEN 'unparseable' END AS reason,
               CAST(no_humidity AS INTEGER) + CAST(no_voltage AS INTEGER) AS n_empty FROM log)""",
    "long": """long AS (
        SELECT CAST(mote AS INTEGER) AS sensor_id, event_id, v.variable, v.value FROM judged_log, LATERAL (VALUES
            ('temperature', CAST(event_id % 50 AS DOUBLE)), ('humidity', CASE WHEN NOT no_humidity THEN (event_id % 1000) / CAST(10 AS DOUBLE) END),
            ('light', CAST(event_id * 13 % 2000 AS DOUBLE)), ('voltage', CASE WHEN NOT no_voltage THEN 2 + (event_id % 10) / CAST(10 AS DOUBLE) END)) AS v(variable, value)
        WHERE reason IS NULL AND v.value IS NOT NULL)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor_id, ts, event_id, variable, value): events as readings."""
    (events,) = tables(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("sensor_id"), "ts", "event_id", F.col("event_type").alias("variable"), "value")


def bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOUNDS, "variable string, low double, high double")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, *r) for u, r in UNITS.items()], "unit string, low double, high double")


def contract(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTRACT, "tag string, unit string, analyser_interval_hours double, dead_time_hours double")


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded telemetry with late arrivals, flags and held republishes; event_id and r tell rows apart."""
    (events,) = tables(spark, sf_dir, "events")
    e, at = F.col("event_id"), F.date_trunc("MILLISECOND", utc(F.col("ts")))
    n = F.when(F.col("event_type").isin("signup", "purchase"), REPEATS).otherwise(1)
    rows = events.withColumn("r", F.explode(F.sequence(F.lit(0), n - 1)))
    later = lambda s: F.timestamp_micros(F.unix_micros(at) + s * 1_000_000)
    return rows.select(
        F.col("event_type").alias("tag"),
        F.when(e % 53 != 0, F.col("value")).alias("value"),
        F.when(e % 53 == 0, "Bad_DeviceFailure").when(e % 37 == 0, "Uncertain_SensorNotAccurate").otherwise("Good").alias("status"),
        at.alias("event_time"),
        ((e + F.col("r")) % 256).cast("int").alias("seq"),
        later(e % 900 + 180 * F.col("r")).alias("server_time"),
        (e % 10 == 0).alias("is_historical"),
        later(e * 7919 % 10800 + F.col("r")).alias("received_at"),
        "event_id",
        "r",
    )


def with_units(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Unit and range of each row's tag, null where undeclared."""
    dims = contract(spark).select("tag", "unit").join(units(spark), "unit", "left")
    return rows.join(dimension(dims), "tag", "left")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, value): a birth line and telemetry lines as captured, five events a message."""
    from fieldlark.functions.scalars import iso_millis

    rows = published(spark, sf_dir).where("r = 0")
    metric = F.struct(F.col("tag").alias("name"), "value", F.col("status").alias("statusCode"), iso_millis(F.col("event_time")).alias("sourceTimestamp"))
    group = F.expr("event_id div 5")
    per = rows.groupBy(group.alias("line")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", metric.alias("m")))), lambda x: x["m"]).alias("metrics"), F.max("server_time").alias("s"), F.max("received_at").alias("a"), F.min("event_id").alias("e")
    )
    payload = F.struct((F.col("e") % 256).alias("seq"), iso_millis(F.col("s")).alias("timestamp"), (F.col("e") % 10 == 0).alias("isHistorical"), "metrics")
    line = F.to_json(F.struct(iso_millis(F.col("a")).alias("receivedAt"), F.lit("plant/site/telemetry").alias("topic"), payload.alias("payload")))
    tags = F.array(*(F.struct(F.lit(t).alias("name"), F.lit(u).alias("unit"), F.lit(i).cast("double").alias("analyserIntervalHours"), F.lit(d).cast("double").alias("deadTimeHours")) for t, u, i, d in CONTRACT))
    birth = spark.range(1).select(F.lit(-1).cast("long").alias("line"), F.to_json(F.struct(F.lit("2024-01-01T00:00:00.000Z").alias("receivedAt"), F.lit("plant/site/birth").alias("topic"), F.struct(F.lit("birth").alias("type"), F.lit(SAMPLE_S).alias("sampleIntervalSeconds"), F.lit(ACCELERATION).alias("accelerationFactor"), tags.alias("tags")).alias("payload"))).alias("value"))
    return birth.union(per.select("line", line.alias("value")))


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): events written as log lines, with every way a line can be broken."""
    (events,) = tables(spark, sf_dir, "events")
    e = F.col("event_id")
    clock = F.when(e % 11 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm:ss.SSSSSS"))
    cells = [
        F.date_format("ts", "yyyy-MM-dd"),
        clock,
        e.cast("string"),
        F.when(e % 97 == 0, "").otherwise((F.col("user_id") % 60).cast("string")),
        (e % 50).cast("string"),
        F.when(e % 7 == 0, "").otherwise(F.concat((F.expr("event_id % 1000 div 10")).cast("string"), F.lit("."), (e % 10).cast("string"))),
        F.when(e % 211 == 0, "x1").otherwise((e * 13 % 2000).cast("string")),
    ]
    voltage = F.when(e % 131 == 0, F.lit(None)).when(e % 41 == 0, "").otherwise(F.concat(F.lit("2."), (e % 10).cast("string")))
    return events.select(F.concat_ws(" ", *cells, voltage).alias("value"))


def roster(spark: SparkSession) -> DataFrame:
    ids = spark.range(1, 55).where(~F.col("id").isin(*SILENT))
    return ids.select(F.col("id").cast("int").alias("sensor_id"), F.col("id").cast("double").alias("x_m"), F.col("id").cast("double").alias("y_m"))
