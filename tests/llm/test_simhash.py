from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from fieldlark.llm import simhash_dedup as s
from fieldlark.llm.components import connected_components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    codes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b\x0bC\x0cd e É", "x y z " * 50, "ÀB cd ef gh", "a b c d e f"])
def test_fingerprint(text):
    assert s.fingerprint(text) == plain(text)


def test_long_text_matches():
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 500, 70_000)))
    assert s.fingerprint(text) == plain(text)


def gray(x):
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


@pytest.mark.parametrize("slice_", [1 << 20, 64])
def test_index_finds_every_pair(slice_, monkeypatch):
    monkeypatch.setattr(s, "SLICE", slice_)
    rng = np.random.default_rng(1)
    codes = set()
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(25):
            c = int(base)
            for k in rng.integers(0, 42, rng.integers(0, 4)):
                c ^= 1 << int(k)
            codes.add(c)
    codes = np.array(sorted(codes), np.uint64)
    bucket = (codes >> np.uint64(42)).astype(np.int64)
    order = np.lexsort((gray(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    a, b = map(np.concatenate, zip(*s.index_links(bucket, codes)))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bucket[i] == bucket[j] and bin(int(codes[i] ^ codes[j])).count("1") <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("cap", [s.BUCKET, 3])
def test_links_close_over_all_pairs(spark, cap):
    rng = np.random.default_rng(2)
    codes = set()
    for base in rng.integers(-(1 << 63), (1 << 63) - 1, 12):
        c = int(base)
        for _ in range(12):  # chains as well as stars, over all bits
            c ^= 1 << 63 if rng.random() < 0.1 else 1 << int(rng.integers(0, 63))
            if rng.random() < 0.5:
                c ^= 1 << int(rng.integers(0, 63))
            codes.add((c + (1 << 63)) % (1 << 64) - (1 << 63))
    codes = sorted(codes)
    got = {(r["node"]): r["root"] for r in connected_components(s.links(spark.createDataFrame([(c,) for c in codes], "fp long"), cap)).collect()}
    label = {c: c for c in codes}
    while True:
        new = {c: min(label[d] for d in codes if bin((c ^ d) & ((1 << 64) - 1)).count("1") <= 2) for c in codes}
        if new == label:
            break
        label = new
    groups = {}
    for c in codes:
        groups.setdefault(label[c], set()).add(got.get(c, c))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(80)}) == 1
    assert 5000 not in got and len(set(got.values())) == 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


ROWS = [(10, "the cat sat on the mat"), (4, "The cat SAT on the\tmat"), (7, "something else entirely here now"), (9, None), (8, ""), (11, "the cat sat on the mat"), (None, "the cat sat on the mat"), (None, "alone without an id at all"), (7, "something else entirely here now")]


def test_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as fingerprint")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fingerprint"], r["component_id"]) for r in s.near_duplicates(df).collect())
    f = lambda t: f"{s.fingerprint(t):016x}"
    cat, other, alone = f(ROWS[0][1]), f(ROWS[2][1]), f(ROWS[7][1])
    assert [x[0] for x in got] == [-1, -1, 4, 7, 7, 8, 9, 10, 11]
    assert {(i, c) for i, p, c in got if p == cat} == {(-1, 4), (4, 4), (10, 4), (11, 4)}
    assert {(i, c) for i, p, c in got if p == "0" * 16} == {(8, 8), (9, 8)}
    assert {(i, c) for i, p, c in got if p == alone} == {(-1, None)} and {c for i, p, c in got if p == other} == {7}
    assert s.near_duplicates(df.limit(0)).collect() == []


def test_one_row_of_each_component_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as lang")
    out = s.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect()) == [-1, -1, 4, 7, 8]


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def test_copies_at_four_fifths_go(spark):
    """Copies with a word in fifty changed lie more than two bits away; copies of copies may be less alike than 0.8."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        for n in (0, 3, 5, 6, 12):
            copy = list(base)
            for at in rng.choice(60, n, replace=False):
                copy[int(at) * 5] = f"new{rng.integers(0, 10**9)}"
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    far = 0
    for _ in range(4):
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if len(x & y) / len(x | y) >= 0.8:
                    far += bin(s.fingerprint(texts[i]) ^ s.fingerprint(texts[j])).count("1") > 2
                    root[i] = root[j] = min(root[i], root[j])
    assert far
    got = s.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_rows_are_judged_not_ids(spark):
    """Unlike texts of one id stay, copies under a shared id go, and so do copies without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, c), (None, c), (None, d), (None, d), (7, d + " x"), (9, b), (None, "e f g"), (None, "e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as hash", "1 as rows", "2 as key")
    out = s.drop_near_duplicates(df, keep_unnamed=False)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(1, a), (5, b), (5, c), (7, d + " x"), (0, "e f g")])
    kept = s.drop_near_duplicates(df)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (5, b), (5, c), (7, d + " x"), (0, c), (0, d), (0, d), (0, "e f g"), (0, "e f g")])


def test_cut_turns_blocks_to_the_front(spark):
    """Every cut keeps all bits, puts the block behind those that lead, and names buckets by what is shared."""
    rng = np.random.default_rng(6)
    codes = [int(c) for c in rng.integers(-(1 << 63), (1 << 63) - 1, 40)] + [0, -1, 1, -(1 << 63)]
    rows = spark.createDataFrame([(c, 0, c, 0) for c in codes], "fp long, bucket long, code long, lead int")
    string = lambda c: f"{c & ((1 << 64) - 1):064b}"
    for depth in range(4):
        lead = {r["lead"] for r in rows.collect()}
        rows = s._cut(rows).cache()
        got = rows.collect()
        assert len(got) == len(codes) * 3 ** (depth + 1)
        buckets = {}
        for r in got:
            assert string(r["code"]).count("1") == string(r["fp"]).count("1")
            buckets.setdefault((r["bucket"], r["lead"]), set()).add(string(r["code"])[: r["lead"]])
        assert all(len(b) == 1 for b in buckets.values()) and min(r["lead"] for r in got) > max(lead | {0}) - 20


def test_large_buckets_go_deeper(spark):
    """Codes that agree on all but a few bits: found however small the buckets are kept."""
    codes = sorted({sum(1 << int(k) for k in np.random.default_rng(i).integers(0, 30, 4)) for i in range(700)})
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    want = {(a, b) for a in codes for b in codes if a < b and bin(a ^ b).count("1") <= 2}
    for cap in (s.BUCKET, 50, 4):
        roots = {r["node"]: r["root"] for r in connected_components(s.links(df, cap)).collect()}
        assert all(roots[a] == roots[b] for a, b in want)
        assert set(roots) == {x for p in want for x in p}
