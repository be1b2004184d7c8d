"""Registered queries, each with its SQL where SQL can say it.

Every query reads whole tables. Timestamps leave as ``timestamp_ntz``, rounded
doubles by ``floor(x * 10^n + 0.5) / 10^n`` on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldlark.functions.scalars import naive, no_nan, numbers, rounded, short_digest, utc
from fieldlark.operators import aggregates as agg, calibrate as cal, clean, lateness, messages as msg, series, sets, validate as val
from fieldlark.plans import catalog, inputs as i
from fieldlark.session import dimension, kept as written, scratch
from fieldlark.sources import readers, writers
from fieldlark.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(x: str, n: int) -> str:
    s = f"CAST(1e{n} AS DOUBLE)"
    return f"floor({x} * {s} + CAST(0.5 AS DOUBLE)) / {s}"


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return clean.quarantine(i.with_units(spark, i.published(spark, sf)))[0]


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return clean.keep_first(_kept(spark, sf), ["tag", "event_time"], ["received_at", "event_id", "r"])


def _late(spark: SparkSession, sf: str) -> DataFrame:
    return lateness.with_lateness(_measured(spark, sf))


# --- the four questions, and their variants ---------------------------------

HOURLY = i.with_sql("readings") + f"SELECT sensor_id, strftime(ts, '%Y-%m-%d %H:00:00') AS hour, count(*) AS n, {_r('avg(value)', 2)} AS avg_value FROM readings WHERE variable = 'view' GROUP BY ALL"


@query(HOURLY)
def agg01_hourly_avg(spark, sf):
    return agg.hourly_mean(i.readings(spark, sf), "view")


@query(HOURLY)
def agg02_group_by_all(spark, sf):
    return catalog.run(spark, "a_hourly_avg_temperature", {"readings": i.readings(spark, sf)}, variable="view").withColumnRenamed("avg_temp", "avg_value")


MISSING = (
    "WITH r AS (SELECT user_id AS sensor_id, ts FROM events WHERE event_type = 'view'), s AS (SELECT c_custkey AS sensor_id FROM customer WHERE c_custkey < 160),"
    " span AS (SELECT CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1e6 AS DOUBLE) / CAST(30 AS DOUBLE)) AS BIGINT) AS expected FROM r),"
    " got AS (SELECT sensor_id, count(DISTINCT ts) AS n FROM r GROUP BY 1)"
    " SELECT s.sensor_id, expected, coalesce(n, 0) AS received, expected - coalesce(n, 0) AS missing FROM s LEFT JOIN got USING (sensor_id) CROSS JOIN span ORDER BY missing DESC, sensor_id"
)


def _roster_and_views(spark, sf):
    (customer,) = readers.tables(spark, sf, "customer")
    return customer.select(F.col("c_custkey").alias("sensor_id")), i.readings(spark, sf).where("variable = 'view'").select("sensor_id", "ts")


@query(MISSING + " LIMIT 5")
def agg05_missing_intervals(spark, sf):
    return agg.missing_intervals(*_roster_and_views(spark, sf))


@query(MISSING)
def agg05_missing_all(spark, sf):
    return agg.missing_intervals(*_roster_and_views(spark, sf), top=None)


@query(MISSING + " LIMIT 5")
def sql_b_missing_intervals(spark, sf):
    """Customers without a key pass through the named SQL, which sorts nulls first, under a number past every bigint."""
    sensors, views = _roster_and_views(spark, sf)
    past = 2**63
    keyed = sensors.selectExpr(f"coalesce(sensor_id, {past}) as sensor_id")
    out = catalog.run(spark, "b_missing_intervals", {"sensors": keyed, "readings": views})
    key = f"cast(nullif(sensor_id, {past}) as {sensors.schema['sensor_id'].dataType.simpleString()}) as sensor_id"
    return out.selectExpr(key, "n_expected as expected", "n_samples as received", "n_missing as missing")


@query(
    "WITH r AS (SELECT user_id AS sensor_id, ts FROM events WHERE event_type = 'view'),"
    " span AS (SELECT CAST(trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1e6 AS DOUBLE) / CAST(30 AS DOUBLE)) AS BIGINT) AS expected FROM r)"
    " SELECT c_custkey AS sensor_id, expected, count(DISTINCT ts) AS received, expected - count(DISTINCT ts) AS missing FROM customer CROSS JOIN span LEFT JOIN r ON sensor_id = c_custkey GROUP BY 1, 2"
)
def joi02_whole_roster(spark, sf):
    """Silent sensors of the whole roster beside those that report."""
    return agg.missing_intervals(*_roster_and_views(spark, sf), top=None)


WHOLE_ROSTER = ORACLES["joi02_whole_roster"] + " ORDER BY missing DESC, sensor_id LIMIT 5"


@query(WHOLE_ROSTER)
def joi02_most_missing(spark, sf):
    """The top five of the whole roster."""
    return agg.missing_intervals(*_roster_and_views(spark, sf))


@query(WHOLE_ROSTER)
def sql_b_whole_roster(spark, sf):
    """The same through the named SQL."""
    return sql_b_missing_intervals(spark, sf)


ROLLING = (
    f"SELECT event_id, user_id AS sensor_id, {_r('avg(value) OVER w', 4)} AS avg_1h, count(*) OVER w AS n_in_window FROM events WHERE event_type = 'view'"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"
)


@query(ROLLING)
def win01_rolling_1h(spark, sf):
    rows = i.readings(spark, sf).where("variable = 'view'")
    out = series.trailing_window(rows, "sensor_id", "ts", 3600, {"a": F.avg("value"), "n_in_window": F.count("*")})
    return out.select("event_id", "sensor_id", rounded(F.col("a"), 4).alias("avg_1h"), "n_in_window")


@query(f"SELECT e.ts, r.* EXCLUDE (event_id) FROM ({ROLLING}) AS r JOIN events AS e USING (event_id)")
def sql_c_rolling_1h(spark, sf):
    out = catalog.run(spark, "c_rolling_1h_voltage", {"readings": i.readings(spark, sf)}, variable="view")
    return out.selectExpr("sensor_id", "ts", "voltage_1h_avg as avg_1h", "n_in_window")


@query(f"SELECT min(n) AS least, max(n) AS most FROM (SELECT n_in_window AS n FROM ({ROLLING}))")
def agg25_window_count_range(spark, sf):
    return win01_rolling_1h(spark, sf).agg(F.min("n_in_window").alias("least"), F.max("n_in_window").alias("most"))


OUTSIDE = i.with_sql("readings", "bounds") + "SELECT variable, count(*) AS n_rows, count(DISTINCT sensor_id) AS n_sensors, min(value) AS lowest, max(value) AS highest FROM readings JOIN bounds USING (variable) WHERE NOT (value BETWEEN low AND high) GROUP BY 1"


@query(OUTSIDE)
def agg06_out_of_range(spark, sf):
    return agg.outside_bounds(i.readings(spark, sf), i.bounds(spark))


@query(OUTSIDE)
def sql_d_out_of_range(spark, sf):
    out = catalog.run(spark, "d_outside_plausible_range", {"readings": i.readings(spark, sf), "bounds": i.bounds(spark)})
    return out.selectExpr("variable", "n_readings as n_rows", "n_sensors", "min_value as lowest", "max_value as highest")


@query("SELECT user_id AS sensor_id, avg(value) AS mean FROM events WHERE event_type = 'view' GROUP BY 1".replace("avg(value)", _r("avg(value)", 6)))
def agg07_mean_per_key(spark, sf):
    out = agg.mean_per_key(i.readings(spark, sf).where("variable = 'view'"))
    return out.select("sensor_id", rounded(F.col("mean"), 6).alias("mean"))


@query("SELECT count(DISTINCT user_id) AS keys, true AS agree FROM events")
def agg22_engine_gap(spark, sf):
    """The DataFrame answer and the SQL answer to one question, and whether they agree to 1e-9."""
    rows = i.readings(spark, sf)
    rows.createOrReplaceTempView("gap_readings")
    other = spark.sql("SELECT sensor_id, sum(value) / count(value) AS mean FROM gap_readings GROUP BY sensor_id")
    gap = agg.largest_gap(agg.mean_per_key(rows), other, "sensor_id", "mean")
    return gap.select("keys", (F.col("max_gap") < 1e-9).alias("agree"))


# --- sinks and sources --------------------------------------------------------


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def snk03_partition_roundtrip(spark, sf):
    path = scratch(spark, "by-date")
    writers.by_date(i.readings(spark, sf), path)
    back = readers.parquet_tree(spark, path, ["date", "event_id"])
    return back.groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 22 AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'")
def flt03_point_probe(spark, sf):
    path = scratch(spark, "by-date")
    writers.by_date(i.readings(spark, sf), path)
    day = catalog.scan_range(readers.parquet_tree(spark, path), "2024-01-09 00:00:00", "2024-01-10 00:00:00")
    return day.where("sensor_id = 22").agg(F.count("*").alias("n"))


@query("SELECT event_type AS variable, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' GROUP BY 1")
def src09_glob_scan(spark, sf):
    """Files of ten days picked by a glob, ``date`` still there."""
    path = scratch(spark, "by-date")
    writers.by_date(i.readings(spark, sf), path)
    days = readers.parquet_tree(spark, path, ["variable", "date"], "date=2024-01-1*")
    return days.where("date is not null").groupBy("variable").agg(F.count("*").alias("n"))


@query("SELECT event_type AS variable, count(*) AS n FROM events GROUP BY 1")
def src12_sql_on_files(spark, sf):
    return spark.sql(f"SELECT event_type AS variable, count(*) AS n FROM parquet.`{sf}/events.parquet` GROUP BY event_type")


@query("SELECT count(DISTINCT CAST(ts AS DATE)) AS partitions FROM events")
def src15_tree_stats(spark, sf):
    path = scratch(spark, "by-date")
    writers.by_date(i.readings(spark, sf), path)
    return readers.tree_stats(spark, path).select("partitions")


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def src14_head(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return readers.head(events.select("event_id", "event_type", "value"), 5, "event_id")


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(CASE WHEN event_id % 29 <> 0 THEN 1 END) AS n_value, "
    + _r("sum(CASE WHEN event_id % 29 <> 0 THEN value END)", 2)
    + " AS total FROM events GROUP BY 1"
)
def src04_comma_csv_clean(spark, sf):
    """Events as a ``;`` CSV with decimal commas, sentinels, an empty column and empty rows, read back and cleaned."""
    (events,) = readers.tables(spark, sf, "events")
    path = scratch(spark, "air")
    value = F.when(F.col("event_id") % 29 == 0, "-200").otherwise(F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")))
    rows = events.select(F.date_format("ts", "dd/MM/yyyy").alias("Date"), F.date_format("ts", "HH.mm.ss").alias("Time"), value.alias("CO(GT)"), F.lit(None).cast("string").alias("none"))
    empty = spark.range(10).select(*(F.lit(None).cast("string").alias(c) for c in rows.columns))
    rows.union(empty).write.csv(path, sep=";", header=True, emptyValue="")
    back = clean.clean_air_quality(readers.comma_csv(spark, path))
    return back.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count("CO(GT)").alias("n_value"), rounded(F.sum("CO(GT)"), 2).alias("total"))


# --- the log ------------------------------------------------------------------


def _judged(spark, sf):
    return clean.judged_log(i.log_text(spark, sf), i.roster(spark))


@query(i.with_sql("log", "judged_log") + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged_log GROUP BY 1")
def shp03_reject_counts(spark, sf):
    return _judged(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(i.with_sql("log", "judged_log", "long") + f"SELECT sensor_id, variable, count(*) AS n, {_r('sum(value)', 1)} AS total FROM long GROUP BY 1, 2")
def shp01_long_readings(spark, sf):
    long = clean.long_readings(_judged(spark, sf))
    return long.groupBy("sensor_id", "variable").agg(F.count("*").alias("n"), rounded(F.sum("value"), 1).alias("total"))


@query(
    i.with_sql("log", "judged_log", "long")
    + """SELECT metric, CAST(value AS BIGINT) AS value FROM (
        SELECT count(*) AS rows_in_file, count(CASE WHEN reason = 'ragged' THEN 1 END) AS ragged_rows, count(CASE WHEN reason = 'no_mote' THEN 1 END) AS rejected_empty_moteid,
               count(CASE WHEN reason = 'off_roster' THEN 1 END) AS rejected_off_roster, count(CASE WHEN reason = 'unparseable' THEN 1 END) AS rejected_unparseable,
               count(CASE WHEN reason IS NULL THEN 1 END) AS rows_accepted, CAST(sum(CASE WHEN reason IS NULL THEN n_empty END) AS BIGINT) AS absent_channel_cells,
               (SELECT count(*) FROM long) AS readings_loaded, (SELECT count(*) FROM long WHERE variable = 'voltage' AND value < 2.4) AS voltage_below_limit FROM judged_log)
      UNPIVOT (value FOR metric IN (rows_in_file, ragged_rows, rejected_empty_moteid, rejected_off_roster, rejected_unparseable, rows_accepted, absent_channel_cells, readings_loaded, voltage_below_limit))"""
)
def agg21_cleaning_report(spark, sf):
    return clean.cleaning_report(_judged(spark, sf))


@query(
    i.with_sql("log")
    + """SELECT splitter, CAST(fields AS INTEGER) AS fields, count(*) AS n FROM (
        SELECT 'one_space' AS splitter, 8 - CAST(ragged AS INTEGER) AS fields FROM log UNION ALL
        SELECT 'any_blank', 8 - CAST(ragged AS INTEGER) - CAST(mote IS NULL AS INTEGER) - CAST(no_humidity AS INTEGER) - CAST(no_voltage AND NOT ragged AS INTEGER) FROM log) GROUP BY 1, 2"""
)
def agg18_split_histogram(spark, sf):
    return agg.arity_histogram(i.log_text(spark, sf))


@query(i.with_sql("log", "judged_log", "long") + "SELECT variable, min(value) AS lowest, max(value) AS highest FROM long GROUP BY 1")
def agg20_channel_minmax(spark, sf):
    return agg.channel_range(clean.long_readings(_judged(spark, sf)))


@query(i.with_sql("log", "judged_log") + "SELECT count(*) AS rows, count(CASE WHEN mote IS NULL AND NOT ragged THEN 1 END) AS no_mote, count(CASE WHEN reason IS NULL THEN 1 END) AS accepted, CAST(sum(CASE WHEN reason IS NULL THEN 4 - n_empty END) AS BIGINT) AS readings FROM judged_log")
def agg19_counters(spark, sf):
    j = _judged(spark, sf)
    ok = F.col("reason").isNull()
    return j.agg(F.count("*").alias("rows"), F.count_if(F.col("reason") == "no_mote").alias("no_mote"), F.count_if(ok).alias("accepted"), F.sum(F.when(ok, 4 - F.col("n_empty"))).cast("long").alias("readings"))


# --- messages, contract, gate -------------------------------------------------


@query(
    i.with_sql("contract")
    + """, p AS (SELECT event_id, event_type AS tag, CASE WHEN event_id % 53 <> 0 THEN value END AS value, date_trunc('millisecond', ts) AS event_time FROM events)
      SELECT tag, unit, count(*) AS n, count(value) AS n_value, min(event_time) AS first_time, max(event_time) AS last_time FROM p LEFT JOIN contract USING (tag) GROUP BY 1, 2"""
)
def shp04_decode_messages(spark, sf):
    raw = i.messages(spark, sf).select("line", F.from_json("value", readers.MESSAGE).alias("message"))
    rows = msg.decode(raw, msg.contract(raw))
    return rows.groupBy("tag", "unit").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), naive(F.min("event_time")).alias("first_time"), naive(F.max("event_time")).alias("last_time"))


@query(i.with_sql("contract") + "SELECT tag, unit, analyser_interval_hours, dead_time_hours FROM contract")
def flt13_first_birth(spark, sf):
    raw = i.messages(spark, sf).select("line", F.from_json("value", readers.MESSAGE).alias("message"))
    return msg.contract(raw)


@query(i.with_sql("contract", "units", "published") + "SELECT p.tag, c.unit, u.low, u.high, count(*) AS n FROM published AS p LEFT JOIN contract AS c USING (tag) LEFT JOIN units AS u ON c.unit = u.unit GROUP BY ALL")
def prj_contract_join(spark, sf):
    return i.with_units(spark, i.published(spark, sf)).groupBy("tag", "unit", "low", "high").agg(F.count("*").alias("n"))


@query(i.with_sql("contract") + "SELECT unit, count(*) AS tags FROM contract GROUP BY 1")
def agg08_units(spark, sf):
    return agg.sizes(i.contract(spark), "unit").withColumnRenamed("n", "tags")


@query(i.with_sql("contract") + "SELECT analyser_interval_hours, dead_time_hours, count(*) AS tags FROM contract WHERE analyser_interval_hours IS NOT NULL GROUP BY 1, 2")
def agg09_analyser_groups(spark, sf):
    return agg.sizes(i.contract(spark), "analyser_interval_hours", "dead_time_hours").withColumnRenamed("n", "tags")


TYPES = {"tag": "string", "value": "double", "status": "string", "event_time": "timestamp", "seq": "int", "server_time": "timestamp", "is_historical": "boolean", "received_at": "timestamp", "unit": "string"}


def _decoded(spark, sf):
    return i.with_units(spark, i.published(spark, sf)).select(*TYPES)


def _schema(spark, clean_rows: bool) -> val.Schema:
    return val.contract_schema(TYPES, i.contract(spark), i.UNITS, i.STATUSES, clean_rows)


GATE_COUNTS = """, d AS (SELECT *, count(*) OVER (PARTITION BY tag, event_time) AS same FROM judged),
    f AS (SELECT 'not_null(value)' AS "check" FROM d WHERE value IS NULL UNION ALL SELECT 'equal_to(status)' FROM d WHERE status <> 'Good'
          UNION ALL SELECT 'value_inside_the_range_for_its_unit' FROM d WHERE value IS NOT NULL AND NOT (value BETWEEN low AND high)
          UNION ALL SELECT 'unique(tag, event_time)' FROM d WHERE same > 1)
    SELECT "check", count(*) AS n FROM f GROUP BY 1"""


@query(i.with_sql("contract", "units", "published", "judged") + GATE_COUNTS)
def val11_lazy_failures(spark, sf):
    return val.failure_counts(_decoded(spark, sf), _schema(spark, True))


@query("SELECT false AS passed")
def val10_fail_fast(spark, sf):
    try:
        val.gate(_decoded(spark, sf), _schema(spark, False))
        passed = True
    except val.SchemaError:
        passed = False
    return spark.range(1).select(F.lit(passed).alias("passed"))


@query("SELECT CAST(0 AS BIGINT) AS failures")
def val13_regate(spark, sf):
    """After quarantine and dedup nothing fails any more."""
    return val.failures(_measured(spark, sf).select(*TYPES), _schema(spark, True)).agg(F.count("*").alias("failures"))


@query("SELECT count(*) AS n_rows, count(DISTINCT (user_id, ts, event_type)) AS n_keys, count(*) - count(DISTINCT (user_id, ts, event_type)) AS lost FROM events")
def val15_natural_key(spark, sf):
    return val.key_report(i.readings(spark, sf), ["sensor_id", "ts", "variable"])


@query("SELECT sum(n) AS n_rows, count(*) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS lost FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_id % 256, event_type)".replace("sum(n) AS n_rows", "CAST(sum(n) AS BIGINT) AS n_rows"))
def val15_candidate_key(spark, sf):
    """What a wrapping counter would lose as part of a key."""
    return val.key_report(i.readings(spark, sf).withColumn("epoch", F.col("event_id") % 256), ["sensor_id", "epoch", "variable"])


@query(i.with_sql("contract", "units", "published") + "SELECT tag, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tag, event_time) AS same FROM published) WHERE same > 1 GROUP BY 1")
def val08_composite_unique(spark, sf):
    rows = i.published(spark, sf)
    schema = val.Schema({}, unique=("tag", "event_time"), strict=False)
    return val.failures(rows, schema).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL AND o_orderkey % 3 <> 0)")
def val16_orphans(spark, sf):
    lines, orders = readers.tables(spark, sf, "lineitem", "orders")
    out = val.orphans(lines.select("l_orderkey"), orders.where("o_orderkey % 3 <> 0"), "l_orderkey", "o_orderkey")
    return out.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_keys"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def joi09_referring(spark, sf):
    lines, orders = readers.tables(spark, sf, "lineitem", "orders")
    return val.referring(lines.select("l_orderkey"), orders.where("o_orderkey % 3 = 0"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT 'value is double, not int' AS problem UNION ALL SELECT 'missing column quality' UNION ALL SELECT 'column props is not declared'")
def val01_schema_problems(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    schema = val.Schema({"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "int", "quality": "int"})
    return spark.createDataFrame([(p,) for p in val.schema_problems(events, schema)], "problem string")


# --- quarantine, dedup, lateness ----------------------------------------------


@query(i.with_sql("contract", "units", "published", "judged") + "SELECT event_id, CAST(r AS INTEGER) AS r, tag, reason FROM judged WHERE reason IS NOT NULL")
def str11_quarantine(spark, sf):
    return clean.quarantine(i.with_units(spark, i.published(spark, sf)))[1].select("event_id", "r", "tag", "reason")


@query(i.with_sql("contract", "units", "published", "judged") + "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def agg11_reason_counts(spark, sf):
    return agg.sizes(clean.quarantine(i.with_units(spark, i.published(spark, sf)))[1], "reason")


LATE = ("contract", "units", "published", "judged", "kept", "measured")


@query(i.with_sql(*LATE) + "SELECT tag, event_id, CAST(r AS INTEGER) AS r, event_time, received_at FROM measured")
def win06_dedup_first(spark, sf):
    return _measured(spark, sf).select("tag", "event_id", "r", naive(F.col("event_time")).alias("event_time"), naive(F.col("received_at")).alias("received_at"))


@query(i.with_sql("contract", "units", "published", "judged", "kept") + f"SELECT tag, count(*) AS rows_received, count(DISTINCT event_time) AS measurements, {_r('(count(*) / count(DISTINCT event_time))', 2)} AS published_per_measurement FROM kept GROUP BY 1")
def agg24_rows_per_measurement(spark, sf):
    return agg.rows_per_measurement(_kept(spark, sf))


@query(i.with_sql("readings") + "SELECT * FROM (SELECT sensor_id, count(*) AS n FROM readings GROUP BY 1 ORDER BY n, sensor_id LIMIT 3) UNION ALL SELECT * FROM (SELECT sensor_id, count(*) AS n FROM readings GROUP BY 1 ORDER BY n DESC, sensor_id DESC LIMIT 3)")
def ord04_both_ends(spark, sf):
    return agg.both_ends(i.readings(spark, sf).groupBy("sensor_id").agg(F.count("*").alias("n")), 3, "n", "sensor_id")


STALE = i.with_sql("contract", "units", "published", "judged", "kept")


@query(
    STALE
    + """, o AS (SELECT tag, max((epoch_us(server_time) - epoch_us(event_time)) / CAST(1e6 AS DOUBLE)) AS observed_max_lag_s FROM kept WHERE NOT is_historical GROUP BY 1),
    p AS (SELECT tag, analyser_interval_hours, greatest(coalesce(analyser_interval_hours, 0) * 3600 - 180, CAST(0 AS DOUBLE)) AS predicted_max_lag_s FROM contract)
    SELECT tag, analyser_interval_hours, predicted_max_lag_s, observed_max_lag_s, predicted_max_lag_s = observed_max_lag_s AS agrees FROM p JOIN o USING (tag)"""
)
def str09_staleness(spark, sf):
    return lateness.staleness(_kept(spark, sf), i.contract(spark), i.SAMPLE_S)


@query(STALE + ", o AS (SELECT tag, max((epoch_us(server_time) - epoch_us(event_time)) / CAST(1e6 AS DOUBLE)) AS m FROM kept WHERE NOT is_historical GROUP BY 1) SELECT analyser_interval_hours, m AS observed_max_lag_s, count(*) AS tags FROM contract JOIN o USING (tag) GROUP BY 1, 2")
def agg10_null_group(spark, sf):
    """Null keys are a group of their own."""
    stale = lateness.staleness(_kept(spark, sf), i.contract(spark), i.SAMPLE_S)
    return agg.sizes(stale, "analyser_interval_hours", "observed_max_lag_s", dropna=False).withColumnRenamed("n", "tags")


@query(
    STALE
    + f""", k AS (SELECT is_historical, (epoch_us(server_time) - epoch_us(event_time)) / CAST(1e6 AS DOUBLE) AS lag_s FROM kept)
    SELECT is_historical, count(*) AS n, {_r('(100 * count(*) / (SELECT count(*) FROM k))', 2)} AS percent, {_r('(median(lag_s) / 60)', 6)} AS median_lag_min, {_r('(max(lag_s) / 60)', 6)} AS max_lag_min FROM k GROUP BY 1"""
)
def str10_replay_lag(spark, sf):
    return lateness.lag_by_mode(_kept(spark, sf))


@query(i.with_sql(*LATE, "late") + f"SELECT event_id, CAST(r AS INTEGER) AS r, watermark_before, {_r('lateness_min', 6)} AS lateness_min FROM late")
def str05_watermark_lateness(spark, sf):
    return _late(spark, sf).select("event_id", "r", naive(F.col("watermark_before")).alias("watermark_before"), rounded(F.col("lateness_min"), 6).alias("lateness_min"))


@query(
    i.with_sql(*LATE, "late")
    + f"SELECT CAST(a AS INTEGER) AS allowance_plant_min, {_r('(a * CAST(60 AS DOUBLE) / CAST(60 AS DOUBLE))', 1)} AS your_wall_clock_s, count(CASE WHEN lateness_min > a THEN 1 END) AS dropped_as_late, {_r('(100 * count(CASE WHEN lateness_min > a THEN 1 END) / count(*))', 2)} AS percent_lost FROM late, (VALUES (0), (15), (30), (45), (60), (90), (120), (180)) AS t(a) GROUP BY a"
)
def str07_allowance_sweep(spark, sf):
    return lateness.allowance_sweep(_late(spark, sf), i.ACCELERATION)


@query(i.with_sql(*LATE, "late") + 'SELECT is_historical, count(CASE WHEN NOT coalesce(lateness_min > 0, false) THEN 1 END) AS "false", count(CASE WHEN coalesce(lateness_min > 0, false) THEN 1 END) AS "true" FROM late GROUP BY 1')
def agg13_late_crosstab(spark, sf):
    return agg.crosstab(_late(spark, sf), "is_historical", "late", [False, True])


@query(
    i.with_sql(*LATE, "late")
    + f"SELECT count(x) AS count, {_r('avg(x)', 6)} AS mean, {_r('stddev_samp(x)', 6)} AS std, {_r('min(x)', 6)} AS min, {_r('quantile_cont(x, 0.25)', 6)} AS q25, {_r('quantile_cont(x, 0.5)', 6)} AS q50, {_r('quantile_cont(x, 0.75)', 6)} AS q75, {_r('max(x)', 6)} AS max FROM (SELECT lateness_min AS x FROM late WHERE lateness_min > 0)"
)
def agg14_late_describe(spark, sf):
    out = agg.describe(written(_late(spark, sf).where("late").select("lateness_min")), "lateness_min")
    return out.withColumns({"min": rounded(F.col("min"), 6), "max": rounded(F.col("max"), 6)})


@query(i.with_sql(*LATE, "late") + f"SELECT {_r('(100 * avg(CAST(coalesce(lateness_min > 0, false) AS DOUBLE)))', 4)} AS percent_late FROM late")
def agg17_percent_late(spark, sf):
    return _late(spark, sf).agg(rounded(F.avg(F.col("late").cast("double")) * 100, 4).alias("percent_late"))


# --- grid, pivot, fill, windows ------------------------------------------------

HOUR_VALUES = "h AS (SELECT event_type AS tag, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)"


def _hourly_counts(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return events.groupBy(F.col("event_type").alias("tag"), F.date_trunc("HOUR", utc(F.col("ts"))).alias("ts")).agg(F.count("*").cast("double").alias("n"))


TAGS = [c[0] for c in i.CONTRACT]


@query(f"WITH {HOUR_VALUES} SELECT ts, " + ", ".join(f"max(CASE WHEN tag = '{t}' THEN n END) AS \"{t}\"" for t in TAGS) + " FROM h GROUP BY 1")
def shp02_pivot_wide(spark, sf):
    return series.wide(_hourly_counts(spark, sf), "ts", "tag", "n", TAGS).withColumn("ts", naive(F.col("ts")))


GRID = f"""WITH {HOUR_VALUES}, g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM h), t AS (SELECT DISTINCT tag FROM h),
    cells AS (SELECT t.tag, g.ts, h.n FROM g CROSS JOIN t LEFT JOIN h ON h.tag = t.tag AND h.ts = g.ts)"""


def _cells(spark, sf):
    counts = written(_hourly_counts(spark, sf))
    return series.on_grid(counts, "tag", "ts", "n", counts, "30 minutes")


@query(GRID + " SELECT tag, ts, n FROM cells")
def shp05_grid(spark, sf):
    return _cells(spark, sf).withColumn("ts", naive(F.col("ts")))


@query(GRID + " SELECT tag, ts, n IS NULL AS was_empty, last_value(n IGNORE NULLS) OVER (PARTITION BY tag ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM cells")
def win05_ffill_mask(spark, sf):
    out = series.forward_fill(_cells(spark, sf), "tag", "ts", "n")
    return out.select("tag", naive(F.col("ts")).alias("ts"), "was_empty", "n")


@query(GRID + f" SELECT tag, count(*) AS cells, count(*) - count(n) AS empty, {_r('(100 * (count(*) - count(n)) / count(*))', 2)} AS percent FROM cells GROUP BY 1 ORDER BY empty DESC, tag LIMIT 8")
def agg23_hole_counts(spark, sf):
    cells = series.forward_fill(_cells(spark, sf), "tag", "ts", "n")
    return agg.hole_counts(cells, ["tag"]).orderBy(F.desc("empty"), "tag").limit(8)


@query(GRID + " SELECT count(*) AS instants, count(CASE WHEN c = 5 THEN 1 END) AS complete FROM (SELECT ts, count(n) AS c FROM cells GROUP BY 1)")
def agg23_complete_rows(spark, sf):
    return agg.complete_rows(series.forward_fill(_cells(spark, sf), "tag", "ts", "n"), "ts")


@query(GRID + " SELECT CASE WHEN tag IN ('signup', 'purchase') THEN 'analyser' ELSE 'continuous' END AS kind, count(*) AS cells, count(*) - count(n) AS empty, " + _r("(100 * (count(*) - count(n)) / count(*))", 2) + " AS percent FROM cells GROUP BY 1")
def agg23_holes_by_kind(spark, sf):
    kind = F.when(F.col("analyser_interval_hours").isNotNull(), "analyser").otherwise("continuous").alias("kind")
    cells = series.forward_fill(_cells(spark, sf), "tag", "ts", "n").join(dimension(i.contract(spark).select("tag", kind)), "tag")
    return agg.hole_counts(cells, ["kind"])


HALF = "time_bucket(INTERVAL 30 MINUTE, {0}, TIMESTAMP '1970-01-01')"


@query(i.with_sql(*LATE) + f"SELECT tag, {HALF.format('event_time')} AS bucket, count(*) AS n, {_r('avg(value)', 4)} AS mean FROM measured GROUP BY 1, 2")
def str02_tumbling_event(spark, sf):
    out = series.tumbling(_measured(spark, sf), "event_time", "30 minutes", {"n": F.count("*"), "mean": F.avg("value")}, ("tag",))
    return out.select("tag", naive(F.col("bucket")).alias("bucket"), "n", rounded(F.col("mean"), 4).alias("mean"))


TWO = (
    i.with_sql(*LATE)
    + f""", e AS (SELECT {HALF.format('event_time')} AS bucket, avg(value) AS by_event FROM measured WHERE tag = 'signup' GROUP BY 1),
    s AS (SELECT {HALF.format('server_time')} AS bucket, avg(value) AS by_publish FROM measured WHERE tag = 'signup' GROUP BY 1),
    b AS (SELECT bucket, by_event, by_publish FROM e FULL OUTER JOIN s USING (bucket))"""
)


def _signups(spark, sf):
    """Kept once: the clocks read unlike columns, so their plans could not share the shuffle that drops republished rows."""
    return written(_measured(spark, sf).where("tag = 'signup'").select("event_time", "server_time", "value"))


def _two_clocks(rows):
    e = series.tumbling(rows, "event_time", "30 minutes", {"by_event": F.avg("value")})
    s = series.tumbling(rows, "server_time", "30 minutes", {"by_publish": F.avg("value")})
    return e.join(s, "bucket", "full_outer")


@query(TWO + f" SELECT bucket, {_r('by_event', 4)} AS by_event, {_r('by_publish', 4)} AS by_publish FROM b")
def str03_two_clocks(spark, sf):
    return _two_clocks(_signups(spark, sf)).select(naive(F.col("bucket")).alias("bucket"), rounded(F.col("by_event"), 4).alias("by_event"), rounded(F.col("by_publish"), 4).alias("by_publish"))


@query(TWO + f" SELECT count(*) AS windows, count(*) - count(by_event) AS empty_event, count(*) - count(by_publish) AS empty_publish, {_r('max(abs(by_event - by_publish))', 4)} AS largest_gap, (SELECT {_r('stddev_samp(value)', 4)} FROM measured WHERE tag = 'signup') AS std FROM b")
def str03_disagreement(spark, sf):
    rows = _signups(spark, sf)
    both = _two_clocks(rows)
    out = both.agg(F.count("*").alias("windows"), F.count_if(F.col("by_event").isNull()).alias("empty_event"), F.count_if(F.col("by_publish").isNull()).alias("empty_publish"), rounded(F.max(F.abs(F.col("by_event") - F.col("by_publish"))), 4).alias("largest_gap"))
    return out.crossJoin(F.broadcast(rows.agg(rounded(F.stddev_samp("value"), 4).alias("std"))))


@query(
    f"""WITH w AS (SELECT {HALF.format('ts')} AS bucket, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type = 'view' GROUP BY 1),
    g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 30 MINUTE)) AS bucket FROM w) SELECT bucket, n FROM g LEFT JOIN w USING (bucket)"""
)
def str04_empty_windows(spark, sf):
    rows = i.readings(spark, sf).where("variable = 'view'")
    windows = written(series.tumbling(rows, "ts", "30 minutes", {"n": F.count("*").cast("double")}))
    return series.with_empty_windows(windows, "30 minutes").withColumn("bucket", naive(F.col("bucket")))


@query(
    f"""WITH h AS (SELECT event_type AS variable, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
    p AS (SELECT variable, v, lag(v) OVER w AS v0, epoch_us(hour) / CAST(1e6 AS DOUBLE) AS s, epoch_us(lag(hour) OVER w) / CAST(1e6 AS DOUBLE) AS s0 FROM h WINDOW w AS (PARTITION BY variable ORDER BY hour))
    SELECT variable, {_r('sum((v + v0) / 2 * ((s - s0) / 3600))', 3)} AS area FROM p GROUP BY 1"""
)
def agg28_trapezoid(spark, sf):
    hourly = series.tumbling(i.readings(spark, sf), "ts", "1 hour", {"v": F.avg("value")}, ("variable",))
    return series.trapezoid(hourly, "bucket", "v", ("variable",)).select("variable", rounded(F.col("area"), 3).alias("area"))


# --- calibration -----------------------------------------------------------------


@query(f"SELECT {_r('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, {_r('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept FROM lineitem")
def agg26_ols(spark, sf):
    (lines,) = readers.tables(spark, sf, "lineitem")
    return cal.ols(lines, "l_quantity", "l_extendedprice").select(rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("intercept"), 2).alias("intercept"))


@query(
    f"""WITH t AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem WHERE l_orderkey % 4 <> 0),
    e AS (SELECT l_extendedprice AS y, l_extendedprice - a * l_quantity - b AS r FROM lineitem, t WHERE l_orderkey % 4 = 0)
    SELECT {_r('(1 - sum(r * r) / (var_pop(y) * count(y)))', 8)} AS r2 FROM e"""
)
def agg27_holdout_r2(spark, sf):
    (lines,) = readers.tables(spark, sf, "lineitem")
    line = cal.ols(lines.where("l_orderkey % 4 <> 0"), "l_quantity", "l_extendedprice")
    return cal.r_squared(lines.where("l_orderkey % 4 = 0"), line, "l_quantity", "l_extendedprice").select(rounded(F.col("r2"), 8).alias("r2"))


@query("SELECT count(*) - CAST(ceil(count(*) * 0.25) AS BIGINT) AS n_train, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n_test FROM events")
def ml01_split_counts(spark, sf):
    split = cal.seeded_split(i.readings(spark, sf), 0, ["event_id"])
    return split.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))


SPLIT = """s AS (SELECT seed, p_partkey, p_size AS x, p_retailprice AS y,
        row_number() OVER (PARTITION BY seed ORDER BY CAST('0x' || substr(md5(seed || '|' || p_partkey), 1, 15) AS BIGINT), p_partkey) > count(*) OVER (PARTITION BY seed) - ceil(0.25 * count(*) OVER (PARTITION BY seed)) AS is_test
    FROM part, (VALUES (0, 0), (1, 0), (2, 1)) AS v(run, seed) WHERE run IN ({runs}) AND p_size IS NOT NULL AND p_retailprice IS NOT NULL)"""


@query("WITH " + SPLIT.format(runs="1, 2") + " SELECT seed, p_partkey, is_test FROM s")
def ml01_split_members(spark, sf):
    """Which rows are held out, for two seeds."""
    (parts,) = readers.tables(spark, sf, "part")
    rows = parts.na.drop(subset=["p_size", "p_retailprice"])
    one, two = (cal.seeded_split(rows, seed, ["p_partkey"]).select(F.lit(seed).alias("seed"), "p_partkey", "is_test") for seed in (0, 1))
    return one.union(two)


@query(
    "WITH " + SPLIT.format(runs="1, 2") + f""", l AS (SELECT seed, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE NOT is_test GROUP BY 1),
    e AS (SELECT seed, a, b, y, y - a * x - b AS r FROM s JOIN l USING (seed) WHERE is_test),
    f AS (SELECT seed, {_r('any_value(a)', 6)} AS slope, {_r('any_value(b)', 6)} AS intercept, {_r('(1 - sum(r * r) / (var_pop(y) * count(y)))', 8)} AS r2 FROM e GROUP BY 1)
    SELECT * FROM f UNION ALL SELECT * FROM f WHERE seed = 0"""
)
def ml03_calibration(spark, sf):
    """Slope, intercept and held-out R squared for three seeds."""
    (parts,) = readers.tables(spark, sf, "part")
    out = None
    for seed in (0, 0, 1):
        row = cal.calibrate(parts, "p_size", "p_retailprice", ["p_partkey"], seed)
        row = row.select(F.lit(seed).alias("seed"), *(rounded(F.col(c), n).alias(c) for c, n in (("slope", 6), ("intercept", 6), ("r2", 8))))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'same seed, same metric' AS name, true AS passed UNION ALL SELECT 'other seed, other metric', true")
def val17_seed_checks(spark, sf):
    (parts,) = readers.tables(spark, sf, "part")
    a, b, c = (cal.calibrate(parts, "p_size", "p_retailprice", ["p_partkey"], s).select(rounded(F.col("r2"), 12).alias("r2")) for s in (0, 0, 1))
    same = sets.comparison(a, b).select(F.lit("same seed, same metric").alias("name"), F.col("equal").alias("passed"))
    return same.union(sets.comparison(a, c).select(F.lit("other seed, other metric"), ~F.col("equal")))


# --- sets, scalars, evidence ------------------------------------------------------


@query("SELECT DISTINCT event_type AS unit FROM events WHERE event_type NOT IN ('click', 'view', 'signup') ORDER BY 1")
def set01_unknown_units(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    known = spark.createDataFrame([("click",), ("view",), ("signup",)], "unit string")
    return sets.difference(events.select(F.col("event_type").alias("unit")), known)


NUMBERS = f"(SELECT DISTINCT {_r('CAST(x AS DOUBLE)', 4)} AS number FROM (SELECT unnest(regexp_extract_all(text, '-?\\d+\\.\\d+(?:[eE][+-]?\\d+)?')) AS x FROM documents WHERE doc_id % 2 = {{0}}))"


def _numbers(spark, sf, k):
    (docs,) = readers.tables(spark, sf, "documents")
    return docs.where(f"doc_id % 2 = {k}").select(F.explode(numbers(F.col("text"))).alias("number")).distinct()


@query(f"SELECT number FROM {NUMBERS.format(0)} INTERSECT SELECT number FROM {NUMBERS.format(1)}")
def set02_common_numbers(spark, sf):
    return sets.intersection(_numbers(spark, sf, 0), _numbers(spark, sf, 1))


@query(f"WITH a AS {NUMBERS.format(0)}, b AS {NUMBERS.format(1)} SELECT (SELECT count(*) FROM a WHERE number NOT IN (FROM b)) AS only_a, (SELECT count(*) FROM b WHERE number NOT IN (FROM a)) AS only_b, (SELECT count(*) FROM a WHERE number IN (FROM b)) AS common, NOT EXISTS (FROM a EXCEPT FROM b) AND NOT EXISTS (FROM b EXCEPT FROM a) AS equal")
def set03_number_sets(spark, sf):
    return sets.comparison(_numbers(spark, sf, 0), _numbers(spark, sf, 1))


@query(f"SELECT count(DISTINCT {_r('CAST(x AS DOUBLE)', 4)}) AS numbers FROM (SELECT unnest(regexp_extract_all(text, '-?\\d+\\.\\d+(?:[eE][+-]?\\d+)?')) AS x FROM documents)")
def agg29_numbers(spark, sf):
    (docs,) = readers.tables(spark, sf, "documents")
    return docs.select(F.explode(numbers(F.col("text"))).alias("n")).agg(F.countDistinct("n").alias("numbers"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def fn_short_digest(spark, sf):
    (docs,) = readers.tables(spark, sf, "documents")
    return docs.select("doc_id", short_digest(F.col("text")).alias("digest"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def fn_json_field(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_type AS variable, count(CASE WHEN value <> 100 THEN value END) AS n, count(*) AS rows FROM (SELECT event_type, CASE WHEN event_id % 17 = 0 THEN 100 ELSE value END AS value FROM events) GROUP BY 1")
def flt08_sentinel(spark, sf):
    rows = i.readings(spark, sf).withColumn("value", no_nan(F.when(F.col("event_id") % 17 == 0, 100.0).otherwise(F.col("value"))))
    out = clean.sentinel_to_null(rows.select("variable", "value"), 100.0)
    return out.groupBy("variable").agg(F.count("value").alias("n"), F.count("*").alias("rows"))


@query("SELECT 'seed-1' AS run_name, '1' AS \"params.seed\", CAST(0.5 AS DOUBLE) AS \"metrics.r2\" UNION ALL SELECT 'seed-2', '2', CAST(0.25 AS DOUBLE)")
def snk07_run_log(spark, sf):
    store = scratch(spark, "runs")
    for seed in (1, 2):
        writers.log_run(spark, store, f"seed-{seed}", {"seed": seed, "data": "part"}, {"r2": 0.5 / seed})
    return writers.runs(spark, store, ("run_name", "params.seed", "params.absent"))


# --- single operators that the queries above only use in passing ------------------


@query(i.with_sql("log", "judged_log") + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM judged_log GROUP BY 1")
def src01_log_file(spark, sf):
    """The log written as text files and scanned again."""
    path = scratch(spark, "log")
    i.log_text(spark, sf).write.text(path)
    judged = clean.judged_log(readers.log_lines(spark, path), i.roster(spark))
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS INTEGER) AS sensor_id, CAST(c_nationkey AS DOUBLE) AS x_m, floor(c_acctbal) AS y_m FROM customer")
def src03_roster(spark, sf):
    (customer,) = readers.tables(spark, sf, "customer")
    line = F.concat(F.lit("  "), F.col("c_custkey"), F.lit("\t"), F.col("c_nationkey"), F.lit("   "), F.floor("c_acctbal"), F.lit(" "))
    return readers.roster(customer.select(F.explode(F.array(line, F.lit("  "))).alias("value")))


@query("SELECT doc_id AS cell, doc_id % 7 + 1 AS execution_count, 'x = ' || doc_id || chr(10) || 'y' AS code FROM documents WHERE doc_id % 2 = 1".replace("doc_id AS cell, doc_id % 7 + 1", "CAST(doc_id AS INTEGER) AS cell, CAST(doc_id % 7 + 1 AS INTEGER)"))
def src13_notebook_cells(spark, sf):
    """A notebook with a cell a document, code in every second one."""
    (docs,) = readers.tables(spark, sf, "documents")
    cell = F.struct(F.when(F.col("doc_id") % 2 == 1, "code").otherwise("markdown").alias("cell_type"), (F.col("doc_id") % 7 + 1).cast("int").alias("execution_count"), F.array(F.concat(F.lit("x = "), F.col("doc_id"), F.lit("\n")), F.lit("y")).alias("source"))
    path = scratch(spark, "notebook")
    book = docs.agg(F.sort_array(F.collect_list(F.struct("doc_id", cell.alias("c")))).alias("x")).select(F.transform("x", lambda c: c["c"]).alias("cells"))
    book.write.json(path)
    return readers.notebook_code(spark, path)


IN_ORDER = """WITH c AS (SELECT l_orderkey AS notebook, l_linenumber AS cell, CASE WHEN l_quantity < 48 THEN l_linenumber + CAST(l_discount > 0.09 AS INTEGER) END AS ran FROM lineitem),
    p AS (SELECT *, row_number() OVER (PARTITION BY notebook ORDER BY cell, ran NULLS FIRST) AS place FROM c)
    SELECT notebook, bool_and(coalesce(ran = place, false)) AS in_order FROM p GROUP BY 1"""


@query(IN_ORDER)
def src13_run_in_order(spark, sf):
    """Notebooks of an order each; some cells never ran, some ran later."""
    (lines,) = readers.tables(spark, sf, "lineitem")
    cells = lines.selectExpr("l_orderkey as notebook", "l_linenumber as cell", "if(l_quantity < 48, l_linenumber + int(l_discount > 0.09), null) as execution_count")
    return readers.run_in_order(cells, "notebook")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk01_rebuilt_table(spark, sf):
    """A table that a statement creates and another fills; an older one of the name goes."""
    (events,) = readers.tables(spark, sf, "events")
    name = f"fieldlark_{uuid.uuid4().hex}"
    try:
        writers.rebuild(spark.createDataFrame([(1, "old")], "id int, event_type string"), name)
        writers.rebuild(events.select("event_id", "event_type"), name)
        return written(spark.table(name).groupBy("event_type").agg(F.count("*").alias("n")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("SELECT CAST(event_id AS VARCHAR) AS value FROM events ORDER BY event_id LIMIT 50")
def snk05_text_sample(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    path = scratch(spark, "sample")
    writers.text_sample(events.select("event_id", F.col("event_id").cast("string").alias("value")), path, 50, "event_id")
    return spark.read.text(path)


@query("SELECT count(*) AS n, 1 AS columns_with_values FROM events WHERE event_id % 3 <> 0")
def flt07_drop_empty(spark, sf):
    """Rows without any value and columns without any go."""
    (events,) = readers.tables(spark, sf, "events")
    rows = events.select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.lit(None).cast("string").alias("none"))
    out = clean.drop_empty_rows(clean.drop_empty_columns(rows))
    return out.agg(F.count("*").alias("n"), F.lit(len(out.columns)).alias("columns_with_values"))


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS lowest, max(value) AS highest FROM events")
def agg03_global_range(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query(STALE + f", k AS (SELECT tag, (epoch_us(server_time) - epoch_us(event_time)) / CAST(1e6 AS DOUBLE) AS lag_s FROM kept) SELECT tag, max(lag_s) AS max_lag_s, {_r('median(lag_s)', 3)} AS median_lag_s, {_r('stddev_samp(lag_s)', 3)} AS std_lag_s FROM k GROUP BY 1")
def agg15_lag_by_tag(spark, sf):
    lag = lateness.with_lag(_kept(spark, sf))
    out = lag.groupBy("tag").agg(F.max("lag_s").alias("max_lag_s"), rounded(F.stddev_samp("lag_s"), 3).alias("std_lag_s"))
    return out.join(agg.quantiles(lag, "lag_s", (0.5,), keys=("tag",)), "tag", "left").select("tag", "max_lag_s", rounded(F.col("q0"), 3).alias("median_lag_s"), "std_lag_s")


@query("SELECT user_id AS sensor_id, max_by(event_id, ts) AS newest FROM events GROUP BY 1")
def ord08_newest(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return events.groupBy(F.col("user_id").alias("sensor_id")).agg(F.max_by("event_id", "ts").alias("newest"))


@query("SELECT DISTINCT event_type AS name FROM events UNION ALL SELECT DISTINCT c_mktsegment FROM customer")
def set04_union_of_distinct(spark, sf):
    events, customer = readers.tables(spark, sf, "events", "customer")
    return events.select(F.col("event_type").alias("name")).distinct().unionByName(customer.select(F.col("c_mktsegment").alias("name")).distinct())


@query(f"SELECT event_id, {_r('((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / CAST(3.6e9 AS DOUBLE))', 6)} AS hours, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS step_us FROM events WHERE event_id > 0 QUALIFY step_us IS NOT NULL")
def win07_elapsed_and_steps(spark, sf):
    """Hours since the first sample of the type, and the microseconds since the one before."""
    (events,) = readers.tables(spark, sf, "events")
    rows = series.steps(events.where("event_id > 0").select("event_id", "event_type", "ts"), "event_type", "ts").where("step_us is not null")
    return rows.select("event_id", rounded(F.col("since_us") / F.lit(3.6e9), 6).alias("hours"), "step_us")


@query(f"SELECT event_id, {_r('((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(3.6e9 AS DOUBLE))', 6)} AS hours, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS step_us FROM events QUALIFY step_us IS NOT NULL")
def win08_steps_by_sensor(spark, sf):
    """The same for each sensor, first row of the table included."""
    (events,) = readers.tables(spark, sf, "events")
    rows = series.steps(events.select("event_id", "user_id", "ts"), "user_id", "ts").where("step_us is not null")
    return rows.select("event_id", rounded(F.col("since_us") / F.lit(3.6e9), 6).alias("hours"), "step_us")


@query("SELECT 'partition filter on date' AS name, true AS seen UNION ALL SELECT 'pushed filter on sensor_id', true UNION ALL SELECT 'only asked columns read', true")
def ben02_pruned_scan(spark, sf):
    """What reaches the scan of a point probe over the dated tree."""
    path = scratch(spark, "by-date")
    writers.by_date(i.readings(spark, sf), path)
    day = catalog.scan_range(readers.parquet_tree(spark, path), "2024-01-09 00:00:00", "2024-01-10 00:00:00").where("sensor_id = 22").select("value")
    seen = catalog.pruning(day)
    rows = [
        ("partition filter on date", "date" in seen["PartitionFilters"][0]),
        ("pushed filter on sensor_id", "EqualTo(sensor_id,22)" in seen["PushedFilters"][0]),
        ("only asked columns read", "value" in seen["ReadSchema"][0] and "event_id" not in seen["ReadSchema"][0]),
    ]
    return spark.createDataFrame(rows, "name string, seen boolean")


@query(
    i.with_sql("log", "judged_log", "long")
    + """SELECT 'not_null(value)' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'foreign key', 0 UNION ALL SELECT 'closed list', 0
        UNION ALL SELECT 'repeated keys', count(*) FROM (SELECT sensor_id, event_id % 1000, variable FROM long GROUP BY 1, 2, 3 HAVING count(*) > 1)"""
)
def val14_constraints(spark, sf):
    """What a table with constraints would have refused: nulls, unknown sensors and variables, repeated keys."""
    long = clean.long_readings(_judged(spark, sf))
    closed = val.isin("variable", clean.CHANNELS)
    per = long.groupBy("sensor_id", (F.col("epoch") % 1000).alias("e"), "variable").agg(F.count("*").alias("n"))
    counts = long.agg(F.count_if(F.col("value").isNull()).alias("not_null(value)"), F.count_if(closed.broken).alias("closed list"))
    out = counts.crossJoin(val.orphans(long, i.roster(spark), "sensor_id").agg(F.count("*").alias("foreign key"))).crossJoin(per.agg(F.count_if(F.col("n") > 1).alias("repeated keys")))
    return out.unpivot([], ["not_null(value)", "foreign key", "closed list", "repeated keys"], "name", "n")


# --- scalar functions, family by family ---------------------------------------------


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:00:00') AS hour, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE), '%Y-%m-%d') AS day,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(6e7 AS DOUBLE) AS minutes, strptime(strftime(ts, '%d/%m/%Y %H.%M.%S'), '%d/%m/%Y %H.%M.%S') AS parsed, date_trunc('millisecond', ts) AS ms FROM events"""
)
def fn_dates(spark, sf):
    from fieldlark.functions import scalars as fn

    (events,) = readers.tables(spark, sf, "events")
    ts = F.col("ts")
    parsed = F.to_timestamp(F.date_format(ts, "dd/MM/yyyy HH.mm.ss"), "dd/MM/yyyy HH.mm.ss")
    return events.select("event_id", fn.hour_label(ts).alias("hour"), fn.iso_millis(ts).alias("iso"), F.to_date(ts).cast("string").alias("day"), fn.minutes_between(ts, F.lit("2024-01-01").cast("timestamp_ntz")).alias("minutes"), naive(parsed).alias("parsed"), naive(fn.milliseconds(ts)).alias("ms"))


@query(
    """SELECT p_partkey, len(string_split(p_name, ' ')) AS one_space, len(string_split(p_type, ' ')) AS words, regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$') AS digits, replace(CAST(p_retailprice AS VARCHAR), '.', ':') AS swapped,
        ends_with(p_type, 'L') AS ends, split_part(p_brand, '#', 2) AS part, TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) AS number FROM part"""
)
def fn_strings(spark, sf):
    from fieldlark.functions import scalars as fn

    (parts,) = readers.tables(spark, sf, "part")
    brand = F.split_part("p_brand", F.lit("#"), F.lit(2))
    return parts.select(
        "p_partkey",
        F.size(F.split("p_name", " ", -1)).cast("long").alias("one_space"),
        F.size(F.split(F.trim("p_type"), r"\s+")).cast("long").alias("words"),
        F.col("p_size").cast("string").rlike("^[0-9]+$").alias("digits"),
        F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(":")).alias("swapped"),
        F.col("p_type").endswith("L").alias("ends"),
        brand.alias("part"),
        fn.strict_int(brand).alias("number"),
    )


@query(
    f"""SELECT event_id, abs(value - 50) AS gap, CASE WHEN event_id % 5 <> 0 THEN greatest(value - 50, 0) END AS clipped, coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, 0.0) AS filled,
        {_r('(value / 7)', 3)} AS ratio, CAST(nullif(event_id % 4, 0) AS DOUBLE) AS no_zero, CAST(trunc(value) AS BIGINT) AS whole FROM events"""
)
def fn_math_and_nulls(spark, sf):
    from fieldlark.functions import scalars as fn

    (events,) = readers.tables(spark, sf, "events")
    v, e = F.col("value"), F.col("event_id")
    some = F.when(e % 5 != 0, v)
    return events.select("event_id", F.abs(v - 50).alias("gap"), fn.clipped(some - 50).alias("clipped"), F.coalesce(some, F.lit(0.0)).alias("filled"), rounded(v / 7, 3).alias("ratio"), F.nullif(e % 4, F.lit(0).cast("long")).cast("double").alias("no_zero"), v.cast("long").alias("whole"))


# --- streams ------------------------------------------------------------------------


def _event_stream(spark, sf):
    (events,) = readers.tables(spark, sf, "events")
    return streams.parquet_stream(spark, sf, events.schema, "events.parquet")


@query(f"SELECT event_type, {HALF.format('ts')} AS bucket, count(*) AS n, {_r('avg(value)', 4)} AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    windows = streams.tumbling(_event_stream(spark, sf), "ts", "30 minutes", "1 hour", {"n": F.count("*"), "mean": F.avg("value")}, ("event_type",))
    out = streams.run_to_end(windows, scratch(spark, "windows"), scratch(spark, "state"), "complete")
    return out.select("event_type", naive(F.col("bucket")).alias("bucket"), "n", rounded(F.col("mean"), 4).alias("mean"))


@query("SELECT event_type AS tag, count(DISTINCT ts) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("event_type").alias("tag"), F.col("ts").alias("event_time"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = streams.run_to_end(streams.first_measurements(rows), scratch(spark, "first"), scratch(spark, "state"))
    return out.groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT event_type AS variable, count(*) AS n, count(CASE WHEN NOT (value BETWEEN 0 AND 100) OR event_id % 53 = 0 THEN 1 END) AS quarantined FROM events GROUP BY 1")
def stream_quarantine(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("event_type").alias("variable"), "value", F.lit(0.0).alias("low"), F.lit(100.0).alias("high"), F.when(F.col("event_id") % 53 == 0, "Bad_DeviceFailure").otherwise("Good").alias("status"))
    kept, bad = scratch(spark, "kept"), scratch(spark, "quarantined")
    streams.route(rows, kept, bad, scratch(spark, "state"))
    both = spark.read.parquet(kept).select("variable", F.lit(0).alias("q")).union(spark.read.parquet(bad).select("variable", F.lit(1)))
    return both.groupBy("variable").agg(F.count("*").alias("n"), F.sum("q").cast("long").alias("quarantined"))
