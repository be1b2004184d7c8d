"""Reading: logs, rosters, comma-decimal CSV, message captures, notebooks, tables."""

from __future__ import annotations

import json
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlark.functions.scalars import comma_decimal

MESSAGE = (
    "receivedAt string, topic string, payload struct<type: string, receivedAt: string, seq: int, timestamp: string, isHistorical: boolean,"
    " sampleIntervalSeconds: double, accelerationFactor: double,"
    " tags: array<struct<name: string, unit: string, analyserIntervalHours: double, deadTimeHours: double>>,"
    " metrics: array<struct<name: string, value: double, statusCode: string, sourceTimestamp: string>>>"
)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    """Parquet tables of a directory."""
    return tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Tables of a directory as temporary views, for SQL."""
    for n, df in zip(names, tables(spark, sf_dir, *names)):
        df.createOrReplaceTempView(n)


def parquet_tree(spark: SparkSession, path: str, columns: Iterable[str] | None = None, glob: str | None = None) -> DataFrame:
    """A partitioned Parquet tree, partition columns restored from the directories; only ``columns`` are read.

    ``glob`` picks files below ``path`` (``date=2004-03-*``) without losing the
    partition columns.
    """
    df = spark.read.option("basePath", path).parquet(f"{path}/{glob}" if glob else path)
    return df.select(*columns) if columns else df


def foreign_table(spark: SparkSession, url: str, table: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A table of another database, read only. Needs that database's driver jar on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    return reader.load()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of a text log. Line ends go, trailing blanks stay, broken UTF-8 becomes U+FFFD, empty lines are gone."""
    return spark.read.text(path).where("value <> ''")


def roster(lines: DataFrame) -> DataFrame:
    """(sensor_id, x_m, y_m) of lines ``id x y`` with any blanks between; empty lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "")
    return rows.select(parts[0].cast("int").alias("sensor_id"), parts[1].cast("double").alias("x_m"), parts[2].cast("double").alias("y_m"))


def comma_csv(spark: SparkSession, path: str, text: tuple[str, ...] = ("Date", "Time")) -> DataFrame:
    """A ``;`` CSV with header and decimal commas. Columns but ``text`` become doubles, what is no number null."""
    raw = spark.read.csv(path, sep=";", header=True)
    return raw.select(*(F.col(f"`{c}`") if c in text else comma_decimal(F.col(f"`{c}`")).alias(c) for c in raw.columns))


def fetch(url: str, member: str, to: str) -> Path:
    """``member`` of the zip file at ``url``, unpacked to ``to`` unless it is there already."""
    out = Path(to)
    if not out.exists():
        out.parent.mkdir(parents=True, exist_ok=True)
        packed, _ = urllib.request.urlretrieve(url)
        with zipfile.ZipFile(packed) as z, z.open(member) as src, out.open("wb") as dst:
            shutil.copyfileobj(src, dst)
    return out


def captured(spark: SparkSession, path: str) -> DataFrame:
    """(raw, message) of an NDJSON capture; raw keeps each line byte for byte."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.from_json("value", MESSAGE).alias("message"))


def capture(messages: Iterable[tuple[str, str]], out: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> int:
    """Appends (topic, payload) to the NDJSON file ``out``, payloads byte for byte; how many.

    The landing side of a broker subscription: any client that yields messages
    feeds it, and the directory is a stream source.
    """
    n = 0
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    with open(out, "a", encoding="utf-8") as f:
        for topic, payload in messages:
            at = clock().astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            f.write(f'{{"receivedAt": {json.dumps(at)}, "topic": {json.dumps(topic)}, "payload": {payload}}}\n')
            n += 1
    return n


def notebook_code(spark: SparkSession, path: str) -> DataFrame:
    """(cell, execution_count, code) of the code cells of a notebook file, in order."""
    schema = "cells array<struct<cell_type: string, execution_count: int, source: array<string>>>"
    cells = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("cells").alias("cell", "c"))
    code = cells.where("c.cell_type = 'code'")
    return code.select("cell", F.col("c.execution_count").alias("execution_count"), F.array_join("c.source", "").alias("code"))


def run_in_order(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, in_order): whether a notebook's code cells, all of them, have counts 1..n in their order.

    A cell that never ran is not in order. Without a cell there is no row if
    ``keys`` name notebooks, else null. A notebook's cells meet in one row.
    """
    counts = F.sort_array(F.collect_list(F.struct("cell", "execution_count")))
    right = F.forall(F.transform(counts, lambda x, i: x["execution_count"].eqNullSafe(i + 1)), lambda ok: ok)
    return cells.groupBy(*keys).agg(F.when(F.count("*") > 0, right).alias("in_order"))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows by a stated order."""
    return df.orderBy(*order).limit(n)


def file_sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of files below ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def tree_stats(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, partitions) of a tree partitioned by date."""
    files = file_sizes(spark, path, "*.parquet")
    day = F.regexp_extract("path", r"/(date=[^/]+)/", 1)
    return files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.countDistinct(F.when(day != "", day)).alias("partitions"))


def stray_data(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".db", ".parquet", ".zip"), most: int = 1_000_000) -> DataFrame:
    """Files of data suffixes, or larger than ``most`` bytes, below ``path``."""
    ends = F.lower(F.element_at(F.split("path", r"\."), -1))
    return file_sizes(spark, path).where(F.concat(F.lit("."), ends).isin(*suffixes) | (F.col("length") > most))
