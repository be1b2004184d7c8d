"""Named SQL: blocks of a file that start with ``-- name: <name>``."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the line that opens a block.
NAME = re.compile(r"--\s*name:\s*(\S+)\s*")
NAMED = Path(__file__).with_name("named.sql")
#: What the named queries ask of a mote log.
ARGUMENTS = {"a_hourly_avg_temperature": {"variable": "temperature"}, "c_rolling_1h_voltage": {"variable": "voltage"}}
PLAUSIBLE = (("temperature", 0.0, 50.0), ("humidity", 0.0, 100.0), ("light", 0.0, 2000.0), ("voltage", 2.0, 3.0))


def blocks(body: str) -> dict[str, str]:
    """Name to SQL, in the file's order; text before the first name is left out."""
    lines: dict[str, list[str]] = {}
    held: list[str] = []
    for line in body.splitlines():
        if opens := NAME.fullmatch(line):
            held = lines[opens.group(1)] = []
        else:
            held.append(line)
    return {name: "\n".join(own).strip().rstrip(";") for name, own in lines.items()}


def named(name: str, path: Path = NAMED) -> str:
    return blocks(path.read_text())[name]


def run(spark: SparkSession, name: str, views: dict[str, DataFrame], path: Path = NAMED, **arguments: object) -> DataFrame:
    """The named query over ``views``; PLAUSIBLE and ARGUMENTS stand in for what is not given."""
    if "bounds" not in views:
        views = views | {"bounds": spark.createDataFrame(PLAUSIBLE, "variable string, low double, high double")}
    for n, df in views.items():
        df.createOrReplaceTempView(n)
    sql = named(name, path)
    wanted = ARGUMENTS.get(name, {}) | arguments
    return spark.sql(sql, args=wanted) if wanted else spark.sql(sql)


def bench(df: Callable[[], DataFrame], repeats: int = 5) -> float:
    """Milliseconds of the best of ``repeats`` runs after a warm one; rows are made and dropped."""
    def once() -> float:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - began) * 1000

    once()
    return min(once() for _ in range(repeats))


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as ``explain`` prints it."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pruning(df: DataFrame) -> dict[str, list[str]]:
    """What reaches the scans: PartitionFilters, PushedFilters and ReadSchema lines of the plan."""
    text = plan_text(df)
    return {k: re.findall(rf"^{k}: (.*)$", text, re.MULTILINE) for k in ("PartitionFilters", "PushedFilters", "ReadSchema")}


def scan_range(df: DataFrame, low: str, high: str, ts: str = "ts", date: str = "date") -> DataFrame:
    """Rows with low <= ts < high, with the date filter that prunes partitions of a dated tree."""
    rows = df.where(f"{ts} >= timestamp_ntz'{low}' and {ts} < timestamp_ntz'{high}'")
    return rows.where(f"{date} >= to_date('{low[:10]}') and {date} <= to_date('{high[:10]}')") if date in df.columns else rows
