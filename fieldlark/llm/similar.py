"""Texts that share at least four fifths of their five-word shingles.

Candidates share a block. Blocks are the components of the Gray-ordered SimHash
index over the same shingles, and ``BANDS`` bands of ``WIDTH`` minima for what
lies further apart than its radius: a pair at a similarity of exactly 0.8 shares
no band with a probability of 5e-8. Every link is confirmed on the two whole
shingle sets.

Texts of a block are held against one of them, its hub, first, so a large group
of copies of one text costs as much as its members. Texts that this leaves
apart are compared if they can still be alike: with the shingles in front that
neither the hub nor many others have, two texts at 0.8 have their first common
shingle near the front of both, and enough shingles behind it. Copies with changes of their own are so
told apart without being paired. No block is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from fieldlark.llm.common import kept, majority, map_texts
from fieldlark.llm.components import connected_components

SHINGLE = 5
BANDS, WIDTH = 32, 4
SEED = 43
_rng = np.random.default_rng(SEED)
_TURN = _rng.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FOLD = _rng.integers(0, 1 << 63, (BANDS, WIDTH), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def text_key(name: str):
    """What equal texts share; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(name, F.lit("")).cast("binary")))


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingle hashes of a whole text, sorted; words as in ``fingerprint``, a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint64))


def bands(grams: np.ndarray) -> np.ndarray:
    """One code for each band of minima over ``grams``."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max)
    for k in range(0, len(grams), 1024):
        np.minimum(least, (grams[k : k + 1024, None] * _TURN).min(0), out=least)
    least ^= least >> np.uint64(29)
    code = (least.reshape(BANDS, WIDTH) * _FOLD).sum(1, dtype=np.uint64)
    return (code ^ code >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)


def _signed(texts: list[str | None]) -> list:
    grams = [shingles(t) for t in texts]
    prints = np.array([majority(g.view(np.uint8).reshape(-1, 8)) for g in grams], np.uint64).view(np.int64)
    return [prints, [bands(g).view(np.int64) for g in grams], [len(g) for g in grams]]


def _sets(texts: list[str | None]) -> list:
    return [[shingles(t).view(np.int64) for t in texts]]


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of keys with the shingle sets of both as ``ga`` and ``gb``."""
    for key, name in ((a, "ga"), (b, "gb")):
        pairs = pairs.join(sets.select(F.col("key").alias(key), F.col("grams").alias(name)).hint("merge"), key)
    return pairs


def _hubs(shared: DataFrame) -> DataFrame:
    """(block, hub) from (block, key, met): the member that meets most, or else its own hub.

    A hub that shares two blocks or more with a text that meets more gives way
    to it, twice over: copies of one text then mostly have that text as hub.
    """
    hubs = kept(shared.groupBy("block").agg(F.max(F.struct("met", "key")).alias("top")).select("block", "top"))
    own = kept(shared.join(kept(hubs.select(F.col("top.key").alias("key")).distinct()).hint("merge"), "key", "left_semi"))
    often = own.join(hubs.hint("merge"), "block").groupBy("key", "top").agg(F.count("*").alias("n")).where("n > 1 or key = top.key")
    above = kept(often.groupBy("key").agg(F.max("top")["key"].alias("up")))
    over = above.select(F.col("key").alias("up"), F.col("up").alias("over"))
    above = above.join(over.hint("merge"), "up").select(F.col("key").alias("hub"), F.col("over").alias("up"))
    return hubs.select("block", F.col("top.key").alias("hub")).join(kept(above).hint("merge"), "hub").select("block", F.col("up").alias("hub"))


def _against_hubs(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """``stars`` (key, hub) with sizes n and m, ``both`` (shared shingles), and ``lacks``: of what the hub lacks, as much as a front takes."""
    rows = _with_sets(stars, sets, "key", "hub")
    both, lacks = F.size(F.array_intersect("ga", "gb")), F.array_except("ga", "gb")
    return rows.select("key", "hub", F.size("ga").alias("n"), F.size("gb").alias("m"), both.alias("both"), F.slice(lacks, 1, F.expr("size(ga) div 5 + 1")).alias("lacks"))


def _fronts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (key, hub, n, root, least, members, lacks) with ``front`` for the last two.

    A front is the beginning of a text's shingles, as far as the first one
    common with a text at 0.8 can lie. Those that the hub and most others have
    come last, each part in one order: ``often`` holds what the hub lacks but an
    eighth of its texts have, at most eight fronts of shingles.
    """
    often = rows.select("hub", "members", F.explode("lacks").alias("gram")).groupBy("hub", "gram").agg(F.count("*").alias("c"), F.max("members").alias("members"))
    often = kept(often.where("c > 1 and 8 * c >= members").groupBy("hub").agg(F.collect_list("gram").alias("often")))
    rows = _with_sets(rows.select("key", "hub", "n", "root", "least"), sets, "key", "hub").join(often.hint("merge"), "hub", "left")
    shared = F.concat("gb", F.coalesce("often", F.array().cast("array<bigint>")))
    ordered = F.concat(F.array_except("ga", shared), F.array_intersect("ga", shared))
    return rows.select("key", "hub", "n", "root", "least", F.slice(ordered, 1, F.expr("n div 5 + 1")).alias("front"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their key, itself if it has none."""
    rows = rows.join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left")
    return rows.withColumn("root", F.coalesce("root", "key"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The ``rows`` of slots that hold more than one component."""
    of = rows.select("slot", F.xxhash64("root").alias("r")).groupBy("slot").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    return kept(rows.join(kept(of.where("low <> high").select("slot")).hint("merge"), "slot"))


def _slots(met: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(slot, key, n, root, at): where the fronts of texts of one hub, but unlike components, meet."""
    placed = kept(_rooted(met.select("key", "hub", "n", "lacks"), roots))
    hubs = placed.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.count("*").alias("members"))
    hubs = kept(hubs.where("low <> high").select("hub", "least", "members"))
    rows = kept(_fronts(kept(placed.join(hubs.hint("merge"), "hub")), sets))
    # Of n and m shingles 4/9 (n + m) must be common, none before ``at``; the other text has at least ``least``.
    rows = rows.select("key", "hub", "n", "root", "least", F.posexplode("front").alias("at", "gram"))
    rows = rows.where("4 * (n + greatest(least, ceil(0.8 * n))) <= 9 * (n - at)")
    return _mixed(rows.select(F.xxhash64("hub", "gram").alias("slot"), "key", "n", "root", "at"))


CAN_BE = "root <> other and 4 * (n + m) <= 9 * least(n - at, m - bt)"


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _to_first(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text of a slot with that of fewest shingles in front of it."""
    first = rows.groupBy("slot").agg(F.min(F.struct("at", "key", "n", "root")).alias("first"))
    first = kept(first.selectExpr("slot", "first.key as b", "first.n as m", "first.root as other", "first.at as bt"))
    return _ordered(rows.join(first.hint("merge"), "slot").where(CAN_BE).selectExpr("key as a", "b"))


def _apart(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of a slot in unlike components that can be alike."""
    # The largest component of a slot is not paired with itself, however large.
    main = rows.groupBy("slot", "root").agg(F.count("*").alias("c")).groupBy("slot").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    rows = kept(rows.join(kept(main).hint("merge"), "slot"))
    left = rows.where("root <> main").selectExpr("slot", "key as a", "n", "root", "at")
    right = rows.selectExpr("slot", "key as b", "n as m", "root as other", "at as bt", "root = main as large")
    return _ordered(left.join(right.hint("merge"), "slot").where("large or a < b").where(CAN_BE))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) at 0.8 or more."""
    shared, sizes = F.size(F.array_intersect("ga", "gb")), F.size("ga") + F.size("gb")
    return kept(_with_sets(pairs, sets, "a", "b").where(9 * shared >= 4 * sizes).select("a", "b"))


def _linked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b) of nodes have joined components."""
    for end in "ab":
        links = _rooted(links.withColumnRenamed(end, "key"), roots).drop("key").withColumnRenamed("root", end)
    more = kept(connected_components(links))
    new = more.join(roots.select("node").hint("merge"), "node", "left_anti")
    top = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(top.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(new.select("node", "root"))


def similar_texts(docs: DataFrame, index: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, root) of every text of ``docs`` that another one is similar to, directly or through others.

    ``key`` is ``text_key``; ``root`` is some key of the component. ``index``
    makes links (a, b) of distinct fingerprints (fp). Null and empty texts, and
    texts without a word, are similar to each other.
    """
    keyed = docs.select(text_key("text").alias("key"), "text")
    longs = T.ArrayType(T.LongType())
    prints = kept(map_texts(keyed, "text", [("fp", T.LongType()), ("codes", longs), ("n", T.IntegerType())], _signed, ("key",)))
    prints = kept(prints.groupBy("key").agg(F.first("fp").alias("fp"), F.first("codes").alias("codes")))
    near = connected_components(index(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    blocks = prints.select("key", F.explode("codes").alias("block"))
    blocks = blocks.union(prints.join(near.hint("merge"), "fp", "left").select("key", F.xxhash64(F.coalesce("root", "fp"), F.lit("index"))))
    peers = kept(blocks.groupBy("block").agg(F.count("*").alias("peers")).where("peers > 1"))
    shared = kept(blocks.join(peers.hint("merge"), "block"))
    # Each text travels once, as text: shingle sets are larger and made only of those with a candidate.
    asked = keyed.dropDuplicates(["key"]).join(kept(shared.select("key").distinct()).hint("merge"), "key", "left_semi")
    sets = kept(map_texts(asked, "text", [("grams", longs)], _sets, ("key",)))

    # The text that meets most others is the likeliest to be what the others are copies of.
    shared = kept(shared.join(kept(shared.groupBy("key").agg(F.sum("peers").alias("met"))).hint("merge"), "key").select("block", "key", "met"))
    hubs = kept(_hubs(shared))
    stars = kept(shared.join(hubs.hint("merge"), "block").where("key <> hub").select("key", "hub").distinct())
    met = kept(_against_hubs(stars, sets))
    sure = met.where("9 * both >= 4 * (n + m)").select(F.col("key").alias("a"), F.col("hub").alias("b"))

    roots = kept(connected_components(sure))
    rows = _slots(met, roots, sets)
    if not rows.isEmpty():
        roots = kept(_linked(roots, _alike(kept(_to_first(rows)), sets)))
        rows = _mixed(_rooted(rows.drop("root"), roots))
        roots = _linked(roots, _alike(kept(_apart(rows)), sets))
    return roots.withColumnRenamed("node", "key")
