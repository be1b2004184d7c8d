from __future__ import annotations

import zlib
from math import comb

import numpy as np
import pytest

from fieldlark.llm import sharding as s


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 7, 4), (3, 2, 5), (0, 4, 2), (10, 0, 3), (6, 6, 12), (2, 9, 8)])
def test_hypergeometric_law(good, bad, draws):
    rng = np.random.default_rng(0)
    got = np.bincount([s.hypergeometric(rng, good, bad, draws) for _ in range(4000)], minlength=good + 1) / 4000
    want = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if 0 <= draws - k <= bad else 0 for k in range(good + 1)])
    assert np.abs(got - want).max() < 0.03


def test_large_populations():
    rng = np.random.default_rng(0)
    x = [s.hypergeometric(rng, 10**10, 15 * 10**10, 10**8) for _ in range(50)]
    assert abs(np.mean(x) - 10**8 / 16) < 4 * (10**8 * 15 / 256 / 50) ** 0.5


def test_matrix_margins():
    parts, shards = [100, 0, 37, 63], [67, 67, 66]
    m = s.communication_matrix(parts, shards, 1)
    assert m.sum(1).tolist() == parts and m.sum(0).tolist() == shards and (m >= 0).all()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permuted_is_a_bijection(size):
    n = np.arange(size)
    out = s.permuted(n, np.full(size, size), np.full(size, 5))
    assert sorted(out.tolist()) == n.tolist()


def test_uniform_first_slot():
    hits = np.array([s.permuted(np.array([0]), np.array([8]), np.array([k]))[0] for k in range(4000)])
    assert np.abs(np.bincount(hits, minlength=8) / 4000 - 1 / 8).max() < 0.03


@pytest.mark.parametrize("n", [0, 5, 3000])
def test_exact_sizes_and_slots(spark, n, monkeypatch):
    monkeypatch.setattr(s, "PART_ROWS", 256)
    rows = [(i, f"text {i % 7}", "x") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").drop("shard")
    out = s.shuffle_into_shards(s.digest(df), "doc_id").toPandas()
    assert len(out) == n and sorted(out["doc_id"]) == list(range(n))
    for j in range(16):
        assert sorted(out[out["shard"] == j]["slot"]) == list(range(n // 16 + (j < n % 16)))
    again = s.shuffle_into_shards(s.digest(df.repartition(7)), "doc_id").toPandas()
    key = ["doc_id", "shard", "slot"]
    assert out[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    if n == 3000:
        assert abs(np.corrcoef(out["doc_id"], out["shard"])[0, 1]) < 0.08 and abs(np.corrcoef(out["doc_id"], out["slot"])[0, 1]) < 0.08


def test_cases(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, ""), (2, "é😀"), (3, "z" * 100_000)]
    out = s.shuffle_into_shards(s.digest(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", 2).toPandas()
    assert sorted(zip(out["shard"], out["slot"])) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    one = out[out["doc_id"] == 2].iloc[0]
    assert one["size"] == 7 and one["text_crc32"] == zlib.crc32("é😀".encode())
    assert out[out["doc_id"] == 1][["size", "text_crc32"]].values.tolist() == [[1, 0], [1, 0]]


def test_query_shuffles_the_texts(spark, tmp_path, monkeypatch):
    from fieldlark.llm import queries

    rows = [(i, f"text {i} " * (i % 9), "en") for i in range(200)] + [(None, None, "de"), (7, "z" * 100_000, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, shuffle = [], s.shuffle_into_shards
    monkeypatch.setattr(s, "shuffle_into_shards", lambda df, *a: seen.append(shuffle(df, *a)) or seen[-1])
    out = queries.op6_sharding(spark, str(tmp_path)).collect()
    assert seen[0].columns == ["doc_id", "text", "lang", "shard", "slot"]
    moved = sorted((r["shard"], r["slot"], r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in seen[0].collect())
    assert moved == sorted((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in out) and len(out) == 202


@pytest.mark.parametrize("key", ["null", "id % 2", "id div 40000"])
def test_null_and_repeated_keys_do_not_share_a_part(spark, key):
    df = spark.range(60_000).selectExpr(f"cast({key} as long) as doc_id", "concat('text ', id) as text")
    out = s.shuffle_into_shards(df, "doc_id").toPandas()
    assert len(set(out["text"])) == 60_000
    for j in range(16):
        assert sorted(out[out["shard"] == j]["slot"]) == list(range(3750))


def test_rows_equal_in_every_column(spark):
    df = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'same' as text")
    out = s.shuffle_into_shards(df, "doc_id").groupBy("shard").agg({"slot": "max", "*": "count"}).toPandas()
    assert (out["max(slot)"] == 6249).all() and (out["count(1)"] == 6250).all()
