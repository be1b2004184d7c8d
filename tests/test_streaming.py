from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from fieldlark.plans import catalog
from fieldlark.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def landed(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "tag string, event_time timestamp, value double").coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return streams.parquet_stream(spark, f"{path}/*", spark.read.parquet(f"{path}/b0").schema)


def test_tumbling_complete_is_the_batch(spark, tmp_path):
    batches = [[("a", T0 + dt.timedelta(minutes=m), float(m)) for m in range(k, k + 40, 7)] for k in (0, 90, 30)]
    s = landed(spark, str(tmp_path / "in"), batches)
    out = streams.run_to_end(streams.tumbling(s, "event_time", "30 minutes", "4 hours", {"n": F.count("*")}, ("tag",)), str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    flat = [r for b in batches for r in b]
    want = {}
    for _, t, _ in flat:
        k = t - (t - T0) % dt.timedelta(minutes=30)
        want[k] = want.get(k, 0) + 1
    assert {r["bucket"]: r["n"] for r in out.collect()} == want


def test_tumbling_appends_final_windows_and_drops_late_rows(spark, tmp_path):
    """Batch by batch: a row is late once batches before it have moved the watermark past its window."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", at(1), 1.0), ("a", at(29), 1.0)], [("a", at(95), 1.0)], [("a", at(96), 1.0)], [("a", at(5), 9.0), ("a", at(50), 1.0), ("a", at(70), 1.0)], [("a", at(400), 1.0)], [("a", at(401), 1.0)]]
    s = landed(spark, str(tmp_path / "in"), batches)
    out = streams.run_to_end(streams.tumbling(s, "event_time", "30 minutes", "1 hour", {"n": F.count("*"), "top": F.max("value")}, ("tag",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["bucket"]: (r["n"], r["top"]) for r in out.collect()}
    # Minute 95 sets the watermark to minute 35; rows are held against it from the batch after the next on.
    assert got == {at(0): (2, 1.0), at(30): (1, 1.0), at(60): (1, 1.0), at(90): (2, 1.0)}


def test_shared_folder_is_not_made_up_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from fieldlark import session

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, applicationId=f"app {master}", getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
    assert session.shared_dir(fake("local[4]")).startswith("file://")


def test_dedup_and_restart(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=m), 1.0) for m in range(10)]
    s = landed(spark, str(tmp_path / "in"), [rows, rows[5:], rows])
    for _ in range(2):  # a second run finds nothing new
        out = streams.run_to_end(streams.first_measurements(s), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert out.count() == 10


def test_routing_and_static_side(spark, tmp_path):
    dim = spark.createDataFrame([("a", 0.0, 5.0)], "tag string, low double, high double")
    s = landed(spark, str(tmp_path / "in"), [[("a", T0, 1.0), ("a", T0, 9.0)], [("b", T0, 1.0)]])
    rows = streams.with_dimension(s.withColumn("status", F.lit("Good")), dim, "tag")
    streams.route(rows, str(tmp_path / "kept"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["no range for its unit", "outside the range for its unit"]


def test_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text(json.dumps({"receivedAt": "2024-01-01T00:00:00Z", "topic": "p/telemetry", "payload": {"seq": 1}}) + "\nnot json\n")
    out = streams.run_to_end(streams.message_stream(spark, str(tmp_path / "in")).select("raw", "message.topic"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(str(r["topic"]) for r in out.collect()) == ["None", "p/telemetry"]


def test_named_blocks():
    got = catalog.blocks("-- head\n-- name: a\nSELECT 1;\n\n--  name:  b \nSELECT\n 2\n")
    assert got == {"a": "SELECT 1", "b": "SELECT\n 2"}
    assert list(catalog.blocks(catalog.NAMED.read_text())) == ["a_hourly_avg_temperature", "b_missing_intervals", "c_rolling_1h_voltage", "d_outside_plausible_range"]
