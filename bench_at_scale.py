"""Times the log workload at full size: 2.3 million lines, 7.5 million readings.

The lines are those of the test events, one per event and copy, copies a
second apart from one another in a year of their own. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

LINES = 2_313_682


def measured(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Counts, the tree's size, seconds to load, milliseconds of mean and probe; best of five after a warm run."""
    from fieldlark.operators import aggregates as agg
    from fieldlark.plans import catalog, inputs, workflows as w
    from fieldlark.sources import readers

    with tempfile.TemporaryDirectory() as d:
        lines = inputs.log_text(spark, sf_dir)
        copies = -(-LINES // lines.count())
        year = F.lpad((F.lit(1900) + F.col("copy")).cast("string"), 4, "0")
        lines.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).select(F.concat(year, F.substring("value", 5, 1000)).alias("value")).limit(LINES).write.text(f"{d}/log")
        inputs.roster(spark).select(F.concat_ws(" ", "sensor_id", "x_m", "y_m").alias("value")).coalesce(1).write.text(f"{d}/roster")
        took = {}
        for warm in (True, False):
            began = time.perf_counter()
            report = {r["metric"]: r["value"] for r in w.load(spark, f"{d}/log", f"{d}/roster", f"{d}/tree{warm}").collect()}
            took["load_s"] = round(time.perf_counter() - began, 2)
        tree = readers.parquet_tree(spark, f"{d}/treeFalse")
        narrow = tree.where("variable = 'temperature'").select("sensor_id", "value")
        took["mean_per_sensor_ms"] = round(catalog.bench(lambda: agg.mean_per_key(narrow)), 1)
        probe = catalog.scan_range(tree, "1905-01-09 00:00:00", "1905-01-10 00:00:00").where("sensor_id = 22")
        took["point_probe_ms"] = round(catalog.bench(lambda: probe.agg(F.count("*").alias("n"))), 1)
        held = narrow.cache()
        held.count()
        took["mean_per_sensor_cached_ms"] = round(catalog.bench(lambda: agg.mean_per_key(held)), 1)
        held.unpersist()
        size = readers.tree_stats(spark, f"{d}/treeFalse").first()["bytes"]
    return {"lines": report["rows_in_file"], "readings": report["readings_loaded"], "tree_mb": round(size / 1e6), **took}


def main() -> None:
    from fieldlark.session import connect

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = connect("at-scale", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps(measured(spark, sf_dir)))


if __name__ == "__main__":
    main()
