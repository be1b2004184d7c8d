from __future__ import annotations

import math

import numpy as np
import pytest

from fieldlark.llm import topk_exact as t

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    good = {(i, tuple(math.floor(64 * np.float32(x).astype(float)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if (j, w) != (i, v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    got = sorted(tuple(r) for r in t.top_k(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as rank"), k, every).collect())
    assert got == brute(rows, k, every)


@pytest.mark.parametrize("blocks", [(1024, 16384, 128), (3, 20, 2)])
def test_random_and_copies(spark, blocks, monkeypatch):
    for name, x in zip(("QUERY_BLOCK", "CLASS_BLOCK", "SLICE"), blocks):
        monkeypatch.setattr(t, name, x)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(60)] + [(400 + i, rng.normal(size=8).round().tolist()) for i in range(60)]
    check(spark, rows)


def test_nulls_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, []), (10, [-1.0, 0.5]), (20, [2.0, 2.0, 2.0]), (20, [0.1, 0.0]), (0, [1.0, 2.0])]
    check(spark, rows)


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 0.0])])
    check(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    check(spark, [(1, [1.0, 0.0])])
    check(spark, [])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, (rng.normal(size=4) * 1e6).tolist()) for i in range(40)])


@pytest.mark.parametrize("most, kind", [(1.9, "tinyint"), (2.0, "smallint"), (511.9, "smallint"), (512.0, "int"), (2.0**25, "bigint")])
def test_components_travel_in_the_narrowest_integers(spark, most, kind):
    rows = [(i, [most, -(i % 7) / 4, 0.5]) for i in range(30)]
    found = t._narrow(t.quantised(spark.createDataFrame(rows, SCHEMA)))
    assert found.schema["v"].dataType.elementType.simpleString() == kind
    check(spark, rows)


def test_cutoffs_beyond_the_broadcast_count(spark, monkeypatch):
    monkeypatch.setattr(t, "dimension", lambda df: df)
    rng = np.random.default_rng(7)
    check(spark, [(i, rng.normal(size=6).tolist()) for i in range(100)])
