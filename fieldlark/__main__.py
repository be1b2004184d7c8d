"""Command line: load, query, export, compare, calibrate, runs."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    from fieldlark.plans import catalog, workflows as w
    from fieldlark.session import connect
    from fieldlark.sources import readers, writers

    p = argparse.ArgumentParser("fieldlark", description=__doc__)
    p.add_argument("--master", default=None, help="Spark master; the environment's by default")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("load", help="a mote log into a dated Parquet tree")
    a.add_argument("log"), a.add_argument("roster"), a.add_argument("out")
    a = sub.add_parser("query", help="the named queries over a tree")
    a.add_argument("tree"), a.add_argument("roster"), a.add_argument("--name", default=None)
    a = sub.add_parser("export", help="a Parquet table as a dated tree")
    a.add_argument("table"), a.add_argument("out"), a.add_argument("--ts", default="ts")
    a = sub.add_parser("compare", help="one question asked three ways")
    a.add_argument("tree"), a.add_argument("--variable", default="temperature")
    a = sub.add_parser("calibrate", help="seeded least squares on an air-quality CSV")
    a.add_argument("--data-path", required=True), a.add_argument("--seed", type=int, default=0), a.add_argument("--runs", default=None)
    a = sub.add_parser("runs", help="the newest runs of a log")
    a.add_argument("store")
    o = p.parse_args(argv)
    spark = connect("fieldlark", o.master)
    if o.what == "load":
        w.load(spark, o.log, o.roster, o.out).show(100, False)
    elif o.what == "query":
        readings, sensors = readers.parquet_tree(spark, o.tree), readers.roster(spark.read.text(o.roster))
        for name in [o.name] if o.name else catalog.blocks(catalog.NAMED.read_text()):
            print(name)
            writers.preview(catalog.run(spark, name, {"readings": readings, "sensors": sensors}))
    elif o.what == "export":
        writers.by_date(spark.read.parquet(o.table), o.out, o.ts)
        readers.tree_stats(spark, o.out).show()
    elif o.what == "compare":
        print(w.compare(readers.parquet_tree(spark, o.tree, ["sensor_id", "variable", "value"]), o.variable))
    elif o.what == "calibrate":
        print(w.calibrate(spark, o.data_path, o.seed, runs=o.runs))
    else:
        writers.runs(spark, o.store, ("run_id", "run_name", "start_time", "params.seed", "params.data")).orderBy(F.desc("start_time")).show(10, False)


if __name__ == "__main__":
    main()
