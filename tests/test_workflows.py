from __future__ import annotations

import json

import pytest

from fieldlark.__main__ import main
from fieldlark.plans import workflows as w
from fieldlark.operators.validate import SchemaError
from fieldlark.sources import readers


@pytest.fixture
def log(tmp_path):
    lines = [f"2004-03-0{1 + i % 3} 0{i % 10}:{i % 60:02d}:0{i // 60}.5 {i} {1 + i % 4} {15 + i % 9}.5 40 100 2.{i % 10}" for i in range(300)]
    (tmp_path / "data.txt").write_text("\n".join([*lines, "bad line"]))
    (tmp_path / "locs.txt").write_text("\n".join(f"{i} {i}.5 1" for i in range(1, 6)))
    return tmp_path


def test_load_query_compare(spark, log, capsys):
    report = {r["metric"]: r["value"] for r in w.load(spark, str(log / "data.txt"), str(log / "locs.txt"), str(log / "tree")).collect()}
    assert report["rows_in_file"] == 301 and report["ragged_rows"] == 1 and report["readings_loaded"] == 1200 and report["foreign_key_violations"] == 0
    tree = readers.parquet_tree(spark, str(log / "tree"))
    assert tree.count() == 1200 and tree.select("date").distinct().count() == 3
    answers = w.questions(spark, tree, readers.roster(spark.read.text(str(log / "locs.txt"))))
    assert answers["b_missing_intervals"].first()["sensor_id"] == 5
    compared = w.compare(tree, "temperature")
    assert set(compared["milliseconds"]) == {"frame", "sql", "sums"} and max(compared["largest_gap"].values()) < 1e-9
    main(["query", str(log / "tree"), str(log / "locs.txt"), "--name", "b_missing_intervals"])
    assert "b_missing_intervals" in capsys.readouterr().out


def test_repeated_key_stops_the_load(spark, log):
    text = (log / "data.txt").read_text()
    (log / "data.txt").write_text(text + "\n" + text.split("\n")[0])
    with pytest.raises(SchemaError, match="unique"):
        w.load(spark, str(log / "data.txt"), str(log / "locs.txt"), str(log / "tree"))
    assert not (log / "tree").exists()


def test_calibrate(spark, tmp_path, capsys):
    rows = [f"{1 + i % 28:02d}/{1 + i // 28 % 12:02d}/2004;{i % 24:02d}.00.00;{i % 50},{i % 10};{1000 + 20 * (i % 50) + 2 * (i % 10)};;" for i in range(300)]
    (tmp_path / "air.csv").write_text("Date;Time;CO(GT);PT08.S1(CO);;\n" + "\n".join(rows))
    a, b, c = (w.calibrate(spark, str(tmp_path / "air.csv"), s, runs=str(tmp_path / "runs")) for s in (0, 0, 1))
    assert a == b and a["r2"] > 0.999 and abs(a["slope"] - 0.05) < 1e-3
    main(["runs", str(tmp_path / "runs")])
    assert "seed-1" in capsys.readouterr().out


def test_plant(spark, tmp_path):
    tags = [{"name": "a", "unit": "kW"}, {"name": "b", "unit": "kW", "analyserIntervalHours": 0.1}]
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z"
    lines = [{"receivedAt": at(0), "topic": "p/birth", "payload": {"type": "birth", "sampleIntervalSeconds": 180, "accelerationFactor": 60, "tags": tags}}]
    for k in range(1, 9):
        held = 360 * (k * 180 // 360)
        metrics = [{"name": "a", "value": float(k), "statusCode": "Good", "sourceTimestamp": at(k * 180)}, {"name": "b", "value": 1.0 if k != 3 else None, "statusCode": "Good" if k != 3 else "Bad_DeviceFailure", "sourceTimestamp": at(held)}]
        lines.append({"receivedAt": at(k * 180 + 5), "topic": "p/telemetry", "payload": {"seq": k, "timestamp": at(k * 180), "isHistorical": False, "metrics": metrics}})
    (tmp_path / "c.ndjson").write_text("\n".join(map(json.dumps, lines)))
    got = w.plant(spark, str(tmp_path / "c.ndjson"), {"kW": (0.0, 100.0)}, {"Good", "Bad_DeviceFailure"})
    assert got["acceleration"] == 60 and got["quarantine"].count() == 1
    assert {r["tag"]: r["count"] for r in got["measured"].groupBy("tag").count().collect()} == {"a": 8, "b": 5}
    assert {r["tag"]: r["agrees"] for r in got["staleness"].collect()} == {"a": True, "b": True}
    assert got["sweep"].count() == 8


def test_exposure(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id) AS ts, CAST(id AS double) AS v FROM range(5)")
    assert w.exposure(df, "ts", "v").first()["area"] == 8.0


def test_evidence(spark, tmp_path):
    from fieldlark.sources import writers

    writers.log_run(spark, str(tmp_path / "runs"), "seed-0", {"seed": 0}, {"r2": 0.77554489})
    text = "slope=0.00576 r2=0.77554489"
    got = {r["name"]: r["passed"] for r in w.evidence(spark, text, text, "slope=0.00570 r2=0.7577", str(tmp_path / "runs")).collect()}
    assert got == {"same seed, same numbers": True, "other seed, other numbers": True, "a printed number is logged": True}
    assert not all(r["passed"] for r in w.evidence(spark, text, "1.5", text, str(tmp_path / "runs")).collect())
