"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints within ``RADIUS`` bits agree on at least one of ``RADIUS + 1``
bit blocks. For each block the distinct fingerprints are turned so that the
block leads, put in Gray order and cut into buckets by it: that block is the
root of a tree whose nodes hold the bits on which all codes below agree, less
those that a node above holds already. A search adds up the differences on the
way down and drops a whole subtree once they pass the radius.

A bucket beyond ``BUCKET`` codes is cut in the same way again: its codes agree
on the bits that lead, so two within the radius agree on one of
``RADIUS + 1`` blocks of those left. The hierarchy so grows with the bucket and
ends by itself, as few bits leave few codes. Every link is found at every size,
and no task holds more than a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from fieldlark.llm.common import kept, majority, map_texts, whole
from fieldlark.llm.components import connected_components
from fieldlark.llm.similar import similar_texts, text_key

RADIUS = 2
FAN = 8
BUCKET = FAN**5
#: Pairs of codes compared at once.
SLICE = 1 << 18
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text.

    A-Z lower-cased; words split at space and U+0009-U+000D; a text of fewer
    than ``shingle`` words is one shingle; no word gives zero. A bit is set if
    more than half of the shingles, repeats included, have it.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_digest
    codes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 8)
    return majority(codes)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text); fp is the signed view."""

    def run(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, "text", [("fp", T.LongType())], run)


def _gray_rank(col):
    """Rank of a code in the reflected Gray sequence, ordered as a signed long."""
    for k in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, k))
    return col.bitwiseXOR(F.lit(-(1 << 63)))


def _nodes(codes: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``span`` codes within each bucket: first code, shared bits, pattern."""
    at = np.arange(len(codes)) - start
    first = np.flatnonzero(at % span == 0)
    ones = np.bitwise_and.reduceat(codes, first)
    zeros = np.bitwise_and.reduceat(~codes, first)
    return first, ones | zeros, ones


def index_links(bucket: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of codes of one bucket within the radius, a bounded number at a time.

    ``codes`` (uint64) stand bucket by bucket in Gray order. The tree is as high
    as the largest bucket needs.
    """
    n = len(codes)
    if not n:
        return
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(heads, n))
    start, end = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
    height = next(k for k in range(64) if FAN**k >= sizes.max())
    tree = []
    above = np.zeros(n, np.uint64)  # bits that the nodes over each code hold already
    for level in range(height, -1, -1):
        first, mask, pattern = _nodes(codes, start, FAN**level)
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        tree.append((FAN**level, mask & ~above[first], pattern, own))
        above = mask[own]
    work = np.cumsum(end - start)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + SLICE, "right")))
        q = np.arange(at, to)
        node, seen = start[q], np.zeros(len(q), np.int64)  # a node goes by its first code
        for span, residual, pattern, own in tree:
            if span < FAN**height:
                kids = node[:, None] + np.arange(FAN) * span
                ok = kids < end[q][:, None]
                ok &= kids + span > q[:, None] + 1  # a pair is found from its first code
                q, seen, node = np.repeat(q, ok.sum(1)), np.repeat(seen, ok.sum(1)), kids[ok]
            k = own[node]
            seen = seen + np.bitwise_count((codes[q] ^ pattern[k]) & residual[k])
            ok = seen <= RADIUS
            q, node, seen = q[ok], node[ok], seen[ok]
        yield q, node
        at = to


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least index of each code's component so far, with pairs (a, b) joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := root[root], root):
            root = nxt


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star edges of each bucket; rows come by bucket and Gray rank."""
    held = None

    def edges(x: pd.DataFrame) -> pd.DataFrame:
        root = np.arange(len(x))
        for a, b in index_links(x["bucket"].to_numpy(np.int64), x["code"].to_numpy(np.int64).view(np.uint64)):
            root = _merged(root, a, b)
        fp = x["fp"].to_numpy(np.int64)
        moved = root != np.arange(len(x))
        return pd.DataFrame({"a": fp[moved], "b": fp[root[moved]]})

    for batch in batches:
        x = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(x):
            continue
        last = x["bucket"] == x["bucket"].iloc[-1]
        held = x[last]
        done = x[~last].reset_index(drop=True)
        if len(done):
            yield edges(done)
    if held is not None and len(held):
        yield edges(held.reset_index(drop=True))


def _cut(rows: DataFrame) -> DataFrame:
    """``rows`` (fp, bucket, code, lead) once for each block of the bits behind the ``lead`` first ones.

    Those bits are turned until the block leads among them; its bits join the
    bucket's name. Unlike buckets of one name do no harm but to be searched
    together.
    """
    n = RADIUS + 1
    rows = rows.selectExpr("*", "64 - lead as bits", f"cast((64 - lead) div {n} as int) as least", f"(64 - lead) % {n} as more", "shiftleft(code, lead) as tail")
    head = "if(lead = 0, 0L, shiftleft(shiftrightunsigned(code, bits), bits)) as head"
    cuts = ", ".join(f"struct({j} as j, {f'{j} * least + more' if j else '0'} as first, {'least' if j else 'least + more'} as width)" for j in range(n))
    rows = rows.selectExpr("fp", "bucket", "lead", "bits", "tail", head, f"inline(array({cuts}))")
    turned = "shiftleft(tail, first) | if(first = 0, 0L, shiftrightunsigned(tail, bits - first))"
    rows = rows.selectExpr("*", f"shiftleft(shiftrightunsigned({turned}, lead), lead) as turned")
    return rows.selectExpr("fp", "xxhash64(bucket, j, shiftrightunsigned(turned, 64 - width)) as bucket", "head | shiftrightunsigned(turned, lead) as code", "lead + width as lead")


def _peers(rows: DataFrame, bucket_cap: int) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets of two codes up to ``bucket_cap``, and of larger ones; of three bits none is larger."""
    sizes = kept(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    rows = kept(rows.join(sizes.hint("merge"), "bucket"))
    large = f"n > {bucket_cap} and lead < {64 - RADIUS}"
    return rows.where(f"not ({large})").drop("n"), rows.where(large).drop("n")


def links(codes: DataFrame, bucket_cap: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose closure is "at most two bits apart" over ``codes`` (fp, distinct)."""
    rest = codes.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("code"), F.lit(0).alias("lead"))
    rows = None
    while rows is None or not rest.isEmpty():
        small, rest = _peers(_cut(rest), bucket_cap)
        rows = small if rows is None else rows.union(small)
    near = rows.repartition("bucket").sortWithinPartitions("bucket", _gray_rank(F.col("code")))
    return near.select("bucket", "code", "fp").mapInPandas(_search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket_cap: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints link at ``RADIUS`` differing bits or fewer; ``component_id``
    is the smallest doc_id reachable, the row's own included.

    Null and empty texts, and texts without a word, have fingerprint zero and
    link like any other. A null doc_id keeps its row; it never names a
    component unless no linked row has an id, and then ``component_id`` is
    null. Repeated rows are kept. An empty table gives an empty result. Extra
    columns are not read.
    """
    prints = kept(fingerprints(docs, shingle))
    classes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp"), bucket_cap)).withColumnRenamed("node", "fp")
    linked = kept(roots.join(classes, "fp"))
    tops = linked.groupBy("root").agg(F.min("least").alias("top"))
    moved = linked.join(tops, "root").select("fp", "top")
    named = kept(classes.join(moved, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id")))
    # Both sides come from a plain exchange, so that a fingerprint of very many rows can be split.
    out = prints.join(named.hint("merge"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, keep_unnamed: bool = True) -> DataFrame:
    """One row of ``docs`` for each component of ``similar_texts``, columns unchanged.

    The row of least doc_id stays, nulls last; of rows that repeat that doc_id,
    one by the hash of the row. With ``keep_unnamed`` every row without a
    doc_id stays as well. Columns of maps are not supported.
    """
    own, key = F.col("row.doc_id"), text_key("row.text")
    rows = whole(docs, "row").select("row", key.alias("key"), F.xxhash64("row").alias("hash"))
    alike = rows.groupBy("key", own.alias("doc_id"), "hash").agg(F.count("*").alias("rows"))
    alike = kept(alike.join(similar_texts(docs, links).hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "key", "rows")
    named = alike.where("doc_id is not null") if keep_unnamed else alike
    stays = kept(named.groupBy("root").agg(F.min(rank).alias("best")).select("best.key", "best.hash", "best.doc_id", "best.rows"))
    marks = stays.withColumnRenamed("doc_id", "id")
    # What stays grows with the rows: never broadcast, small or large.
    out = rows.join(marks.hint("merge"), ["key", "hash"]).where(own.eqNullSafe(F.col("id")))
    once = out.where("rows = 1").select("row")
    if not stays.where("rows > 1").isEmpty():
        once = once.union(out.where("rows > 1").dropDuplicates(["key"]).select("row"))
    if keep_unnamed:
        once = once.union(rows.where(own.isNull()).select("row"))
    return once.select("row.*")
