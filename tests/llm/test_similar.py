"""Similar texts against a comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from fieldlark.llm import similar, simhash_dedup


def closed(texts):
    """Groups of texts whose pairs at 0.8 or more, all compared, link them."""
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    out = {}
    for i, t in enumerate(texts):
        out.setdefault(top(i), set()).add(t)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def edited(rng, words, n, kind):
    out = list(words)
    for at in sorted(rng.choice(len(words), n, replace=False), reverse=True):
        if kind == "replace":
            out[at] = f"x{rng.integers(0, 10**9)}"
        elif kind == "insert":
            out.insert(at, f"x{rng.integers(0, 10**9)}")
        else:
            del out[at]
    return out


def families(seed, with_base, size):
    """Copies, copies of copies and texts that share half, at all similarities around the threshold."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(3):
        base = [f"w{k}" for k in rng.integers(0, 10**6, int(rng.integers(60, 200)))]
        other = base[: len(base) * 3 // 4] + [f"w{k}" for k in rng.integers(0, 10**6, len(base) // 4)]
        texts += [" ".join(base)] * with_base
        for _ in range(size):
            copy = edited(rng, base if rng.random() < 0.6 else other, int(rng.integers(0, 9)), rng.choice(["replace", "replace", "insert", "delete"]))
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                texts.append(" ".join(edited(rng, copy, int(rng.integers(0, 6)), "replace")))
            if rng.random() < 0.1:
                texts.append(" ".join(copy[: int(len(copy) * rng.uniform(0.7, 1))]))
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("seed,with_base,size", [(1, True, 60), (2, False, 60), (3, True, 15)])
def test_all_links_and_no_others(spark, seed, with_base, size):
    texts = families(seed, with_base, size)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    named = df.select(similar.text_key("text").alias("key"), "text").join(similar.similar_texts(df, simhash_dedup.links), "key")
    got = {}
    for r in named.collect():
        got.setdefault(bytes(r["root"]), set()).add(r["text"])
    assert {frozenset(g) for g in got.values()} == closed(texts)


@pytest.mark.parametrize("with_base", [True, False])
def test_pairs_do_not_grow_with_the_square(spark, with_base, monkeypatch):
    """Copies too far from their text to link are as far from each other: few pairs are made beside those with the hub."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)] * with_base + [" ".join(edited(rng, base, int(rng.integers(1, 9)), "replace")) for _ in range(800)]
    made = []

    def counted(plain):
        def run(*args):
            out = plain(*args)
            made.append(out.count())
            return out

        return run

    for name in ("_to_first", "_apart"):
        monkeypatch.setattr(similar, name, counted(getattr(similar, name)))
    n = similar.similar_texts(spark.createDataFrame([(t,) for t in texts], "text string"), simhash_dedup.links).count()
    assert n > 200 and sum(made) < 4 * len(texts)


def test_odd_texts(spark):
    a = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None,), ("",), (" \n",), ("x",), ("X ",), ("x y",), (a,), (a + " z",), (a,)]
    df = spark.createDataFrame(rows, "text string")
    got = similar.similar_texts(df, simhash_dedup.links).collect()
    assert len(got) == 2 + 2 + 2  # two spellings without a word, two of one word, two long texts
    assert len({bytes(r["root"]) for r in got}) == 3
    assert similar.similar_texts(df.limit(0), simhash_dedup.links).collect() == []
