"""Uniform shuffle into shards of exact sizes.

Rows fall into logical parts by a hash of their key and their other columns. How many rows of each part
go to each shard is drawn exactly (multivariate hypergeometric), as a uniform
permutation of all rows would have it. Each part permutes its rows and deals
them out by its line of that matrix, rows are exchanged, and each shard
permutes again: a keyed bijection of 0..size-1, computed row by row, so that no
task ever holds a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldlark.llm.common import column, whole

SEED = 20240229
#: Rows of a logical part, and the most parts: bounds the matrix and its broadcast (16 MB for 16 shards).
PART_ROWS, MOST_PARTS = 8192, 1 << 16
#: Slots of a shard that are written side by side.
RUN = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` taken without return, by inversion over 15 standard deviations around the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    sd = (draws * (good / n) * (bad / n) * max(1e-12, (n - draws) / max(1, n - 1))) ** 0.5
    a, b = max(low, int(mode - 15 * sd - 30)), min(high, int(mode + 15 * sd + 30))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], "right"))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows from each part to each shard; lines sum to ``parts``, columns to ``shards``."""
    rng, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(parts), len(shards)), np.int64)
    for i, rows in enumerate(parts):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            out[i, j] = hypergeometric(rng, left[j], rest, rows)
            rows -= int(out[i, j])
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(place: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The keyed bijection of 0..size-1 at each ``place``: a Feistel network, walked until in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = place.astype(np.uint64), np.arange(len(place))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(6):
            left, right = right, left ^ (_mix(right + _mix(k + np.uint64(r + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shuffle_into_shards(rows: DataFrame, key: str, shards: int = 16, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard).

    Shard sizes are at most one apart, the larger ones first. The counts are
    drawn by the exact law; the places are pseudo-random, by ``seed``. Rows lie
    by shard and slot afterwards. Columns of ``rows`` named shard or slot give
    way. Rows are dealt by ``key`` and a hash of all other columns, so null and
    repeated keys fall into parts of their own; rows equal in every column
    share a part, in any order. With fewer rows than shards the last shards are
    empty; an empty table gives an empty result. Columns of maps are not
    supported.
    """
    spark = rows.sparkSession
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    others = [F.col("row")[c] for c in own if c != key]
    rows = whole(rows.select(*map(column, own)), "row").select("row", F.col("row")[key].alias("key"))
    total = rows.count()
    parts = max(1, min(MOST_PARTS, -(-total // PART_ROWS)))
    mark = [F.xxhash64("key", *others, F.lit(seed + k)) for k in (0, 1)]
    part = F.pmod(mark[0], F.lit(parts)).cast("int")
    counts = dict(rows.select(part.alias("_part")).groupBy("_part").count().collect())
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], sizes, seed)
    ends = np.cumsum(matrix, axis=1)
    before = np.cumsum(matrix, axis=0) - matrix
    # At most MOST_PARTS lines, so small at any size of the table.
    plan = spark.createDataFrame([(i, ends[i].tolist(), (before[i] - ends[i] + matrix[i]).tolist()) for i in range(parts)], "_part int, _ends array<long>, _base array<long>")
    dealt = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(mark[1])) - 1)
    dealt = dealt.join(F.broadcast(plan), "_part").withColumn("shard", F.expr("cast(size(filter(_ends, e -> e <= _rank)) as int)"))
    dealt = dealt.withColumn("_place", F.expr("_base[shard] + _rank")).withColumn("_size", F.element_at(F.array(*[F.lit(s).cast("long") for s in sizes]), F.col("shard") + 1))

    @F.pandas_udf("long")
    def again(place: pd.Series, size: pd.Series, shard: pd.Series) -> pd.Series:
        return pd.Series(permuted(place.to_numpy(np.int64), size.to_numpy(np.int64), shard.to_numpy(np.int64) + seed))

    dealt = dealt.select("row", "shard", again("_place", "_size", "shard").alias("slot"))
    runs = max(1, -(-total // RUN))
    moved = dealt.withColumn("_run", F.expr(f"slot div {RUN}")).repartition(min(runs, 100_000), "shard", "_run")
    return moved.sortWithinPartitions("shard", "slot").select(*(F.col("row")[c].alias(c) for c in own), "shard", "slot")


def digested(name: str) -> tuple:
    """UTF-8 bytes plus one and unsigned CRC-32 of a text; a null text counts as empty."""
    text = F.coalesce(name, F.lit(""))
    return (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of each row, as in ``digested``."""
    size, crc = digested("text")
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
