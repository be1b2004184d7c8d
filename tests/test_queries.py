"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fieldlark.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return v + 0.0 if isinstance(v, float) else v

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_against_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    if name not in core.ORACLES:
        assert len(got)
        return
    want = duck.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_reports_the_whole_roster(spark):
    """Past the ids that the SQL of these queries stops at (c_custkey < 160)."""
    sf = "/root/testdata/sf0.1"
    customers = f"SELECT c_custkey AS sensor_id FROM '{sf}/customer.parquet'"
    views = f"SELECT user_id AS sensor_id, count(DISTINCT ts) AS n FROM '{sf}/events.parquet' WHERE event_type = 'view' GROUP BY 1"
    want = duckdb.sql(f"SELECT sensor_id, coalesce(n, 0) AS n FROM ({customers}) LEFT JOIN ({views}) USING (sensor_id)").fetchall()
    got = core.QUERIES["agg05_missing_all"](spark, sf).collect()
    assert sorted((r["sensor_id"], r["received"]) for r in got) == sorted(want) and len(got) > 159
    first = [r["sensor_id"] for r in sorted(got, key=lambda r: (-r["missing"], r["sensor_id"]))[:5]]
    for name in ("agg05_missing_intervals", "sql_b_missing_intervals", "joi02_most_missing", "sql_b_whole_roster"):
        assert sorted(r["sensor_id"] for r in core.QUERIES[name](spark, sf).collect()) == sorted(first)


def test_repeated_keys_past_65536(spark, tmp_path):
    """Event ids that agree modulo 1000 repeat a key (1, 2), those that agree modulo 65536 alone do not (464, 66000)."""
    ids = "(VALUES (1, 1), (66001, 1), (2, 1), (66002, 1), (464, 2), (66000, 2)) AS v(event_id, user_id)"
    columns = "CAST(event_id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, CAST(user_id AS BIGINT) AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, '{}' AS props"
    con = duckdb.connect()
    con.sql(f"COPY (SELECT {columns} FROM {ids}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = core.QUERIES["val14_constraints"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(core.ORACLES["val14_constraints"]).df())
    assert got.set_index("name")["n"]["repeated keys"] == 8


def test_missing_differs_from_its_sql_by_the_roster_alone(spark):
    """Rows of the ids that the SQL keeps (c_custkey < 160) are those of the SQL, past the size where all are."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for t in ("customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = core.QUERIES["agg05_missing_all"](spark, sf).where("sensor_id < 160").toPandas()
    assert rows(got) == rows(con.sql(core.ORACLES["agg05_missing_all"]).df())


@pytest.mark.parametrize("name", ["agg05_missing_intervals", "joi02_most_missing"])
def test_customers_without_a_key_come_last_among_ties(spark, tmp_path, name):
    """All ids are below 160 and seven sensors are silent, so the top five are those of the SQL."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT CAST(c AS BIGINT) AS c_custkey FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (NULL), (NULL)) AS t(c)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    columns = "range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range * 31) AS ts, range % 2 AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, '{}' AS props"
    con.sql(f"COPY (SELECT {columns} FROM range(20)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in ("customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = core.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(core.ORACLES[name]).df()
    assert got["sensor_id"].tolist() == want["sensor_id"].tolist() == [2, 3, 4, 5, 6]
    assert rows(got) == rows(want)


@pytest.mark.parametrize("keys, top", [([0, 1, 2, 3, 4, 5, 6, 7, 8, None, None], [2, 3, 4, 5, 6]), ([0, None, 2, None, 1], [2, None, None, 1, 0])])
def test_named_sql_puts_customers_without_a_key_last_among_ties(spark, tmp_path, keys, top):
    """Sensors 0 and 1 report, and so do views without a sensor, which are no customer's."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT CAST(c AS BIGINT) AS c_custkey FROM (VALUES {', '.join(f'({k})' for k in keys).replace('None', 'NULL')}) AS t(c)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    columns = "range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range * 31) AS ts, CASE WHEN range % 4 < 3 THEN range % 2 END AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, '{}' AS props"
    con.sql(f"COPY (SELECT {columns} FROM range(20)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in ("customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = core.QUERIES["agg05_missing_intervals"](spark, str(tmp_path))
    for name in ("sql_b_missing_intervals", "sql_b_whole_roster"):
        got = core.QUERIES[name](spark, str(tmp_path))
        assert [r["sensor_id"] for r in got.collect()] == top
        assert got.select(want.columns).collect() == want.collect() and dict(got.dtypes) == dict(want.dtypes)
        if None not in top:
            assert rows(got.toPandas()) == rows(con.sql(core.ORACLES[name]).df())
