from __future__ import annotations

import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fieldlark.operators import clean, messages
from fieldlark.plans import catalog, inputs
from fieldlark.sources import readers, writers

LOG = b"""2004-03-01 01:02:03.4 1 7 19.5 37.1 45 2.69
2004-03-01 01:02:04 2 7 19.5  45 2.69
2004-03-01 01:02:05.5 3 7 19.5 37.1 45 \r
2004-03-01 01:02:06 4 7 19.5 37.1 45

2004-03-01 01:02:07 5  19.5 37.1 45 2.69
2004-03-01 01:02:08 6 55 19.5 37.1 45 2.69
2004-03-01 01:02:09 7 5 19.5 37.1 45 2.69
2004-03-01 01:02:10 8 7 19.5 x 45 2.69
2004-03-01 01:02:11 n 7 19.5 37 45 2.69
2004-3-01 01:02:12 9 7 19.5 37 45 2.69
2004-03-01 01:02:13 10 \xff 19.5 37 45 2.69
2004-03-01 01:02:14 11 7    
"""


def model(raw: bytes, roster: set[int]) -> dict[str, int]:
    """The cascade, line by line."""
    import re

    out = dict.fromkeys(("accepted", *clean.REASONS), 0)
    for line in raw.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if not line:
            continue
        f = line.split(" ")
        if len(f) != 8:
            out["ragged"] += 1
        elif not re.fullmatch("[0-9]+", f[3]):
            out["no_mote"] += 1
        elif not 1 <= int(f[3]) <= 54 or int(f[3]) not in roster:
            out["off_roster"] += 1
        else:
            try:
                datetime.strptime(f"{f[0]} {f[1].partition('.')[0]}", "%Y-%m-%d %H:%M:%S")
                assert re.fullmatch(r"\d{4}-\d\d-\d\d", f[0])
                int(f[2])
                [float(c) for c in f[4:] if c]
                out["accepted"] += 1
            except (ValueError, AssertionError):
                out["unparseable"] += 1
    return out


def test_log_cascade(spark, tmp_path):
    (tmp_path / "data.txt").write_bytes(LOG)
    (tmp_path / "locs.txt").write_text("7 1.5 2\n\n  8\t3 4\n")
    roster = readers.roster(spark.read.text(str(tmp_path / "locs.txt")))
    assert [tuple(r) for r in roster.orderBy("sensor_id").collect()] == [(7, 1.5, 2.0), (8, 3.0, 4.0)]
    judged = clean.judged_log(readers.log_lines(spark, str(tmp_path / "data.txt")), roster)
    got = {r["reason"] or "accepted": r["count"] for r in judged.groupBy("reason").count().collect()}
    assert got == {k: v for k, v in model(LOG, {7, 8}).items() if v}
    report = {r["metric"]: r["value"] for r in clean.cleaning_report(judged).collect()}
    assert report["readings_loaded"] == 4 * report["rows_accepted"] - report["absent_channel_cells"] == clean.long_readings(judged).count()
    assert sum(report[k] for k in ("ragged_rows", "rejected_empty_moteid", "rejected_off_roster", "rejected_unparseable", "rows_accepted")) == report["rows_in_file"]


def test_comma_csv_and_cleaning(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date;Time;CO(GT);NOx(GT);S;;\n10/03/2004;18.00.00;2,6;-200;-200;;\n10/03/2004;19.00.00;-200;13;-200;;\n;;;;;;\n")
    df = clean.clean_air_quality(readers.comma_csv(spark, str(tmp_path / "a.csv")))
    assert df.columns == ["Date", "Time", "CO(GT)", "NOx(GT)", "S", "timestamp"]  # a column of sentinels is no empty column
    rows = df.orderBy("timestamp").collect()
    assert [(r["CO(GT)"], r["NOx(GT)"], r["S"], r["timestamp"].hour) for r in rows] == [(2.6, None, None, 18), (None, 13.0, None, 19)]


def test_broken_dates_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date;Time;x\n40/03/2004;18.00.00;1\n")
    with pytest.raises(Exception, match="(?i)parse|cast|timestamp"):
        clean.clean_air_quality(readers.comma_csv(spark, str(tmp_path / "a.csv"))).collect()


def test_fetch_keeps_what_is_there(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.csv", "x;y\n1;2\n")
    out = readers.fetch((tmp_path / "a.zip").as_uri(), "in/a.csv", str(tmp_path / "new" / "a.csv"))
    assert out.read_text() == "x;y\n1;2\n"
    out.write_text("own")
    assert readers.fetch("file:///nowhere.zip", "a", str(out)).read_text() == "own"


def test_capture_is_byte_exact(spark, tmp_path):
    clock = lambda: datetime(2024, 1, 2, 3, 4, 5, 678_000, timezone.utc)
    payload = '{"seq":  1, "metrics":[ ]}'
    assert readers.capture([("plant/a/telemetry", payload)] * 2, str(tmp_path / "c.ndjson"), clock) == 2
    got = readers.captured(spark, str(tmp_path / "c.ndjson"))
    assert payload in got.first()["raw"] and got.count() == 2
    assert got.first()["message"]["receivedAt"] == "2024-01-02T03:04:05.678Z"


def test_decode(spark):
    birth = {"type": "birth", "sampleIntervalSeconds": 180, "accelerationFactor": 60, "tags": [{"name": "a", "unit": "%"}, {"name": "b", "unit": "kW", "analyserIntervalHours": 0.1}]}
    tele = {"seq": 3, "timestamp": "2024-01-01T00:01:00Z", "isHistorical": False, "metrics": [{"name": "a", "value": 1.5, "statusCode": "Good", "sourceTimestamp": "2024-01-01T00:00:59.1239Z"}, {"name": "zz", "value": None, "statusCode": None, "sourceTimestamp": "2024-01-01T00:00:00Z"}]}
    lines = [
        (0, json.dumps({"receivedAt": "2024-01-01T00:00:00.000Z", "topic": "p/birth", "payload": birth})),
        (1, json.dumps({"receivedAt": "2024-01-01T00:01:01.000Z", "topic": "p/telemetry", "payload": tele})),
        (2, json.dumps({"receivedAt": "2024-01-01T00:01:02.000Z", "topic": "p/telemetry", "payload": {**tele, "metrics": [], "receivedAt": "2020-01-01T00:00:00Z"}})),
        (3, json.dumps({"receivedAt": "x", "topic": "p/birth", "payload": {**birth, "tags": []}})),
    ]
    raw = spark.createDataFrame(lines, "line int, value string").select("line", F.from_json("value", readers.MESSAGE).alias("message"))
    tags = messages.contract(raw)
    assert sorted(tuple(r) for r in tags.collect()) == [("a", "%", None, None), ("b", "kW", 0.1, None)]
    assert messages.birth(raw)["accelerationFactor"] == 60
    rows = {r["tag"]: r for r in messages.decode(raw, tags).collect()}
    assert set(rows) == {"a", "zz"} and rows["zz"]["unit"] is None and rows["a"]["unit"] == "%"
    assert rows["a"]["event_time"].microsecond == 123_000 and rows["a"]["received_at"].second == 1


def test_notebook(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["t"]}, {"cell_type": "code", "execution_count": 1, "source": ["a = 1\n", "b"]}, {"cell_type": "code", "execution_count": 2, "source": []}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}}, indent=1))
    got = readers.notebook_code(spark, str(tmp_path / "n.ipynb"))
    assert [tuple(r) for r in got.orderBy("cell").collect()] == [(1, 1, "a = 1\nb"), (2, 2, "")]
    assert readers.run_in_order(got).first()[0] is True
    assert readers.run_in_order(got.where("execution_count = 2")).first()[0] is False


def test_run_in_order_counts_every_code_cell(spark):
    cells = [("all", 0, 1), ("all", 4, 2), ("unrun", 0, 1), ("unrun", 1, None), ("late", 0, 2), ("late", 1, 1), ("gap", 0, 1), ("gap", 1, 3)]
    df = spark.createDataFrame(cells, "notebook string, cell int, execution_count int")
    assert {r["notebook"]: r["in_order"] for r in readers.run_in_order(df, "notebook").collect()} == {"all": True, "unrun": False, "late": False, "gap": False}
    assert readers.run_in_order(df.where("notebook = 'all'")).first()[0] is True
    assert readers.run_in_order(df.where("false")).first()[0] is None


def test_partitioned_tree(spark, tmp_path):
    rows = spark.sql("SELECT cast(id % 9 AS int) AS sensor_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, id AS v FROM range(100)")
    for _ in range(2):  # the second replaces the first
        writers.by_date(rows, str(tmp_path / "t"))
    tree = readers.parquet_tree(spark, str(tmp_path / "t"))
    assert tree.count() == 100 and set(tree.columns) == {"sensor_id", "ts", "v", "date"}
    day = catalog.scan_range(tree, "2024-01-02 00:00:00", "2024-01-03 00:00:00").where("sensor_id = 3").select("v")
    assert day.count() == rows.where("to_date(ts) = date'2024-01-02' and sensor_id = 3").count()
    seen = catalog.pruning(day)
    assert "date" in seen["PartitionFilters"][0] and "EqualTo(sensor_id,3)" in seen["PushedFilters"][0] and "v:" in seen["ReadSchema"][0]
    assert readers.parquet_tree(spark, str(tmp_path / "t"), ["date"], "date=2024-01-02").distinct().count() == 1
    stats = readers.tree_stats(spark, str(tmp_path / "t")).first()
    assert stats["partitions"] == 5 and stats["bytes"] > 0
    assert readers.stray_data(spark, str(tmp_path / "t")).count() == stats["files"]


def test_tables_samples_and_runs(spark, tmp_path):
    writers.rebuild(spark.range(5), "made")
    writers.rebuild(spark.range(3), "made")
    assert spark.table("made").count() == 3
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(9)], "n int, value string")
    writers.text_sample(lines, str(tmp_path / "s"), 3, "n")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "s")).collect()) == ["l0", "l1", "l2"]
    for seed in (0, 1):
        writers.log_run(spark, str(tmp_path / "runs"), f"seed-{seed}", {"seed": seed, "data": "d"}, {"r2": 0.5, "a": 1.0, "b": 2.0})
    runs = writers.runs(spark, str(tmp_path / "runs"))
    assert runs.columns == ["run_id", "start_time", "params.seed", "params.data", "metrics.a", "metrics.b"]
    assert [r["params.seed"] for r in runs.collect()] == ["1", "0"]
    assert writers.preview(lines)[0] == 9


def test_rendered_log_is_what_it_says(spark):
    assert inputs.roster(spark).count() == 52
