from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldlark.llm import bestfit_pack as p, token_output as o


def brute_fit(items, capacity):
    """The fullest bin without a conflict, looked for in all of them; of equal ones the oldest."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(room, b) for b, (room, ss, cs) in enumerate(bins) if room >= size and source not in ss and cluster not in cs]
        b = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((capacity, set(), set()))
        room, ss, cs = bins[b]
        out.append((b, capacity - room))
        bins[b] = (room - size, ss | {source}, cs | {cluster})
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4), st.integers(0, 6)), max_size=60))
def test_tightest_compatible_bin(items):
    assert p.best_fit(items, 20) == brute_fit(items, 20)


def test_pack_is_whole_and_free_of_conflicts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))) + f" d{i % 50}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    rows += [(1000, "x " * 95, "s1"), (1001, None, None), (1002, "", None), (None, "a b", "s2"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as piece", "'c' as cluster", "0 as bin")
    got = p.pack(df, capacity=30, group=200).collect()
    words = lambda t: len((t or "").split())
    assert sum(r["n_words"] for r in got) == sum(words(t) for _, t, _ in rows)
    assert len(got) == sum(max(1, -(-words(t) // 30)) for _, t, _ in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r["pack_group"], r["bin"]].append(r)
    text = {i: (t or "").lower().split() for i, t, _ in rows}
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 30
        assert len({r["source"] for r in own}) == len(own)
        assert len({tuple(text[r["doc_id"]]) for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: (r["bin_offset"], r["n_words"])):
            assert r["bin_offset"] == at
            at += r["n_words"]
    assert [(r["piece"], r["start_word"], r["n_words"]) for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == 1000] == [(0, 0, 30), (1, 30, 30), (2, 60, 30), (3, 90, 5)]
    assert p.pack(df.limit(0)).collect() == []


def test_given_clusters(spark):
    df = spark.createDataFrame([(i, "a", f"s{i}", 1) for i in range(5)], "doc_id long, text string, source string, c int")
    assert len({r["bin"] for r in p.pack(df, cluster="c").collect()}) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_segment_tree_is_best_fit_decreasing(sizes):
    got = o.best_fit_decreasing(sizes, 16)
    room = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        before = [r for r in room if r >= sizes[i]]
        if got[i] == len(room):
            assert not before
            room.append(16)
        assert room[got[i]] == (min(before) if before else 16)
        room[got[i]] -= sizes[i]
    assert all(r >= 0 for r in room)


def test_packed_rows_round_trip(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    tok = o.tokenizer()
    rows = [(i, "word " * (i % 90) + str(i)) for i in range(300)] + [(900, "long text " * 500), (901, None), (902, ""), (None, "no id"), (5, "word " * 5 + "5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as row")
    got = o.packed_rows(df, row=64, window=4000).toPandas()
    m = o.id_matrix(got)
    assert m.shape == (len(got), 64)
    assert len(set(zip(got["part"], got["row"]))) == len(got)
    pieces = defaultdict(list)
    for ids, r in zip(m, got.itertuples()):
        ends = list(r.cu_seqlens)
        assert ends[0] == 0 and ends[-1] == r.n_tokens and list(r.position_resets) == ends[:-1]
        assert (ids[r.n_tokens :] == tok.end).all()
        for a, b, d, s in zip(ends, ends[1:], r.doc_ids, r.doc_starts):
            pieces[-1 if d is None or np.isnan(d) else int(d)].append((int(s), ids[a:b]))
    want = defaultdict(list)
    for d, t in rows:
        want[-1 if d is None else d].append(tok.ids(t or ""))
    for d, own in want.items():
        if len(own) == 1:
            parts = [x for _, x in sorted(pieces[d], key=lambda x: x[0])]
            assert np.array_equal(np.concatenate(parts), own[0])
    assert sum(len(x) for p in pieces.values() for _, x in p) == sum(len(x) for w in want.values() for x in w)
    assert tok.text(tok.ids("Round trip é\n")) == "Round trip é\n"
    assert o.packed_rows(df.limit(0)).count() == 0
    o.write_packed(df, str(tmp_path / "out"), row=64)
    assert spark.read.parquet(str(tmp_path / "out")).schema == o.SCHEMA


def test_many_repeated_rows_are_dealt_out(spark):
    """Equal rows conflict with each other: in one group their cost would grow with the square of their number."""
    df = spark.range(100_000).selectExpr("if(id < 50000, 1, null) as doc_id", "'same text' as text", "'s' as source")
    got = p.pack(df).groupBy("pack_group").count().collect()
    assert sum(r["count"] for r in got) == 100_000 and max(r["count"] for r in got) < 1.3 * p.GROUP


def test_clusters_ignore_case_and_blanks(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "A  b ", "t"), (3, "\ta\nB", "u"), (4, "a bb", "v")], "doc_id long, text string, source string")
    marks = {r["doc_id"]: r["c"] for r in df.select("doc_id", p.text_cluster(df["text"]).alias("c")).collect()}
    assert marks[1] == marks[2] == marks[3] != marks[4]
