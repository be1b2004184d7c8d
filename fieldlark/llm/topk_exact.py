"""Exact top-k by inner product: the three-phase uniform threshold.

A score is the sum of partial scores over ``LISTS`` slices of the components.
First each list gives its local best entries, from which k exact scores per
query set a cutoff. It is safe: an entry that reaches it has at least its
share, cutoff / LISTS, in some list. Then every list collects the entries with
that share, and last the remaining lists resolve their scores exactly.

Equal vectors form one class, kept with as many of their smallest ids as a
query can return, so copies cost nothing. Queries and classes meet in bounded
blocks, never all in one task and never by broadcast, as vectors of the
narrowest integers that hold every component. The cutoffs, one number a query,
are broadcast up to a checked count and joined by shuffle beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldlark.llm.common import kept
from fieldlark.session import dimension

K = 20
LISTS = 2
#: Queries and classes of a block, on average; queries scored at once.
QUERY_BLOCK, CLASS_BLOCK, SLICE = 16384, 8192, 128


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 * x) of each component; rows that take no part are gone."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long")).alias("v"))


def _narrow(rows: DataFrame) -> DataFrame:
    """``rows`` with v in the narrowest integers that hold its least and greatest component."""
    low, high = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kind = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**bits) <= (low or 0) and (high or 0) < 2**bits)
    return rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros."""
    column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _blocks(queries: pa.Table, classes: pa.Table) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Queries, classes and the lists' columns; floats where all sums of products stay exact, else integers."""
    width = max([1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (queries, classes))])
    q, c = _matrix(queries.column("v"), width), _matrix(classes.column("v"), width)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * width
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        q, c = q.astype(kind), c.astype(kind)
    step = -(-width // LISTS)
    return q, c, [slice(i, i + step) for i in range(0, width, step)]


def _own_room(qid: int, qv: np.ndarray, ids: list[int], cv: np.ndarray) -> int:
    """How many rows of a class may answer a query, its own excluded."""
    return len(ids) - (qid in ids and bool((qv == cv).all()))


def _first(share: int):
    """Phase one: the ``share`` best exact scores of a block, among the heads of its lists."""

    def run(key: tuple, queries: pa.Table, classes: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "score"]
        if not queries.num_rows or not classes.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q, c, lists = _blocks(queries, classes)
        qids, keys, ids = queries.column("vec_id").to_pylist(), queries.column("query_key").to_pylist(), classes.column("ids").to_pylist()
        out: list[tuple[int, int, int]] = []
        head = min(share + 1, len(c))
        for at in range(0, len(q), SLICE):
            part = q[at : at + SLICE]
            heads = np.concatenate([np.argpartition(-(part[:, s] @ c[:, s].T), head - 1, axis=1)[:, :head] for s in lists], axis=1)
            for i, row in enumerate(heads):
                row = np.unique(row)
                scores = c[row] @ part[i]
                left = share
                for j in np.argsort(-scores, kind="stable"):
                    n = min(left, _own_room(qids[at + i], part[i], ids[row[j]], c[row[j]]))
                    out += [(qids[at + i], keys[at + i], int(scores[j]))] * n
                    left -= n
                    if not left:
                        break
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*out) if out else [[]] * 3)})

    return run


def _second(k: int):
    """Phases two and three: entries with their share in some list, resolved, the best of the block."""

    def run(key: tuple, queries: pa.Table, classes: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not queries.num_rows or not classes.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q, c, lists = _blocks(queries, classes)
        qids, keys, ids = queries.column("vec_id").to_pylist(), queries.column("query_key").to_pylist(), classes.column("ids").to_pylist()
        cut = np.array([-np.inf if x is None else x for x in queries.column("cutoff").to_pylist()])
        out: list[tuple[int, int, int, int]] = []
        for at in range(0, len(q), SLICE):
            part, floor = q[at : at + SLICE], cut[at : at + SLICE]
            enough = np.zeros((len(part), len(c)), bool)
            for s in lists:
                enough |= part[:, s] @ c[:, s].T >= (floor / len(lists))[:, None]
            for i in range(len(part)):
                row = np.flatnonzero(enough[i])
                scores = c[row] @ part[i]
                good = scores >= floor[i]
                row, scores = row[good], scores[good]
                if len(row) > k + 1:  # classes beyond the k + 1 best, and below the last of them, cannot answer
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    row, scores = row[scores >= least], scores[scores >= least]
                found = []
                for j, r in enumerate(row):
                    own = qids[at + i] if qids[at + i] in ids[r] and (part[i] == c[r]).all() else None
                    found += [(-int(scores[j]), v) for v in ids[r] if v != own]
                out += [(qids[at + i], keys[at + i], v, -s) for s, v in sorted(found)[:k]]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*out) if out else [[]] * 4)})

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but the query's own. A query with fewer candidates gets them all.

    Rows with a null vec_id or vector, or a null or non-finite component, take
    no part. Rows that repeat both vec_id and quantised vector count once; a
    vec_id with several vectors is a row, and a query, for each. Vectors of
    unlike lengths compare as if the shorter ended in zeros. An empty table
    gives an empty result; extra columns are not read.
    """
    rows = _narrow(kept(quantised(embeddings).distinct()))
    least = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
    classes = kept(classes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = kept(rows.where(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("v")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    chunks = max(1, -(-classes.count() // CLASS_BLOCK))
    classes = classes.withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(chunks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    meet = ("block", "chunk")

    # The k-th best of any candidates is a safe cutoff, so a block need not send k of its own: four times its part will do.
    share = min(k, -(-4 * k // chunks) + 1)
    heads = queries.withColumn("chunk", spread).groupBy(*meet).cogroup(classes.groupBy(*meet)).applyInArrow(_first(share), "query_id long, query_key long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"))
    cut = heads.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy("query_id", "query_key").agg(F.min("score").alias("cutoff"), F.count("*").alias("_n"))
    cut = kept(cut.select(F.col("query_id").alias("vec_id"), "query_key", F.when(F.col("_n") == k, F.col("cutoff")).alias("cutoff")))

    known = queries.join(dimension(cut), ["vec_id", "query_key"], "left").withColumn("chunk", spread)
    found = known.groupBy(*meet).cogroup(classes.groupBy(*meet)).applyInArrow(_second(k), "query_id long, query_key long, vec_id long, score long")
    last = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
