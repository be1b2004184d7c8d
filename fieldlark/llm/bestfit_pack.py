"""Best-fit packing of documents into bins under conflicts.

A bin takes no two documents of one source and no two of one duplicate
cluster. Documents are dealt by a hash of their row into groups of bounded
size; each group is packed on its own, longest first. Its bins stand in order
of room left, each with a bitmap of sources and one of clusters; the search
starts at the least room that is enough and goes on to the next bin until one
has no conflict.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldlark.llm.common import WORD

CAPACITY = 2048
#: Documents of a packing group, on average.
GROUP = 2048


def best_fit(items: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, place in it) of each (size, source, cluster) in the order given.

    Sources and clusters are small numbers, used as bits. Sizes are 0 to
    ``capacity``.
    """
    bins: list[tuple[int, int]] = []  # (room, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect.bisect_left(bins, (size, -1))
        while at < len(bins) and (sources[bins[at][1]] & s or clusters[bins[at][1]] & c):
            at += 1
        if at < len(bins):
            room, b = bins.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            room, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        out.append((b, capacity - room))
        bisect.insort(bins, (room - size, b))
    return out


def pack_table(x: pa.Table, capacity: int) -> pa.Table:
    """One group: pieces (doc_id, source, cluster, piece, n_words, ...) with their bin and place, longest first."""
    keys = x.select(["n_words", "_order", "piece"]).to_pandas()
    x = x.take(np.lexsort((keys["piece"], keys["_order"], -keys["n_words"])))
    source, cluster = (pd.factorize(x.column(c).to_pandas(), use_na_sentinel=False)[0].tolist() for c in ("source", "cluster"))
    got = best_fit(list(zip(x.column("n_words").to_pylist(), source, cluster)), capacity)
    for i, name in enumerate(("bin", "bin_offset")):
        x = x.append_column(name, pa.array([g[i] for g in got], pa.int64()))
    return x


def text_cluster(text):
    """Copies that differ in case or white space alone share it."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, piece, start_word, n_words, pack_group, bin, bin_offset): where each piece goes.

    ``docs`` has doc_id, text, source; ``cluster`` names a column of duplicate
    clusters, else texts that are equal but for case and white space form one.
    A bin is named by pack_group and bin and holds at most ``capacity`` words.

    A text of more words than ``capacity`` is cut into pieces, whole ones and a
    rest, which go to different bins. A null or empty text, or one without a
    word, is one piece of no words; such pieces keep to the same rules. Null
    sources count as one source; null clusters as one cluster. Null doc_ids
    and repeated rows keep their pieces; repeated rows are of one cluster and
    dealt over all groups. Of
    pieces of equal length the one of the lesser hash of id and cluster, then
    the earlier piece, is placed first; of equally tight bins the older takes
    it. An empty table gives an empty result; extra columns are not read.
    """
    n = docs.count()
    groups = max(1, -(-n // group))
    own = F.col(cluster) if cluster else text_cluster(F.col("text"))
    rows = docs.select("doc_id", "source", own.cast("string").alias("cluster"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_all"))
    # Repeated rows, counted before they travel, are dealt over all groups.
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_k", F.explode(F.expr("sequence(1L, _n)")))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "cluster", "_k"), F.lit(groups)))
    pieces = F.expr(f"transform(sequence(0, greatest(_all - 1, 0) div {capacity}), k -> struct(cast(k as int) as piece, k * {capacity} as start_word, least(_all - k * {capacity}, {capacity}) as n_words))")
    rows = rows.withColumn("_piece", F.explode(pieces)).select("doc_id", "source", "cluster", "pack_group", F.xxhash64("doc_id", "cluster").alias("_order"), "_piece.*")
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("source", docs.schema["source"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("pack_group", T.LongType()),
            T.StructField("bin", T.LongType()),
            T.StructField("bin_offset", T.LongType()),
        ]
    )

    def run(x: pa.Table) -> pa.Table:
        return pack_table(x, capacity).select(schema.names)

    return rows.groupBy("pack_group").applyInArrow(run, schema)
