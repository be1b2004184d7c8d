"""The pipeline, stage by stage, against the same decisions made row by row."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from fieldlark.llm import bestfit_pack, quality_rules as q, secret_scan, simhash_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"



@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words, int(rng.integers(60, 200))))
        if i % 6 == 5:
            text = " ".join(w + "***" for w in text.split())
        if i % 10 == 3:
            text += f' password = "{"ab12" * 5}" end'
        rows.append((i, text, "en", "hot" if i % 3 == 0 else f"s{i % 5}", len(text)))
    rows += [(1000 + i, rows[i % 7][1], "en", "hot", len(rows[i % 7][1])) for i in range(60)]  # a third of some source, exact copies
    rows += [(2000, rows[1][1].upper(), "de", "s1", None), (2001, None, None, None, None), (2002, "", "en", "s2", 0), (2003, "too short", "en", "s2", 9), (None, " ".join(rng.choice(words, 90)), "en", "s3", 5), (8, rows[8][1], "en", "s3", 1)]
    rows.append((2004, " ".join(rng.choice(words, 9000)), "en", "s4", 1))
    labels = [(i, int(i % 6 != 5), 0) for i in range(240)]
    d = str(tmp_path_factory.mktemp("tables"))
    odd = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS `a.b`", "2 AS kept", "3 AS rows", "'r' AS row", "4 AS rule", "5 AS fp")
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def plain_run(rows, rules):
    """Rows that reach packing, with their text."""
    good = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        grams = defaultdict(int)
        for i in range(len(words) - 2):
            grams[tuple(words[i : i + 3])] += 1
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            continue
        symbols = len(re.findall(r"[#*$%&|<>]", r[1])) / len(words)
        assert all(c.feature == "symbols_per_word" for rule in rules for c in rule)
        if not any(all(c.holds({"symbols_per_word": symbols}) for c in rule) for rule in rules):
            good.append(r)
    prints = [simhash_dedup.fingerprint(r[1]) for r in good]
    root = list(range(len(good)))
    changed = True
    while changed:
        changed = False
        for i in range(len(good)):
            for j in range(len(good)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    groups = defaultdict(list)
    for i, r in zip(root, good):
        groups[i].append(r)
    kept = []
    for own in groups.values():
        ids = [r for r in own if r[0] is not None]
        kept += sorted(ids, key=lambda r: r[0])[:1] + [r for r in own if r[0] is None]
    return {r[0]: secret_scan.redacted(r[1]) for r in kept}


def test_stages(spark, corpus):
    d, rows = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rules = q.learn(q.labelled_rows(docs, spark.read.parquet(f"{d}/labels.parquet")))
    want = plain_run(rows, rules)
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        docs = cp.kept(out)
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want)
    assert {tuple(r[c] for c in ("a.b", "kept", "rows", "row", "rule", "fp")) for r in got} == {(1, 2, 3, "r", 4, 5)}
    assert all("[secret]" in r["text"] and r["n_chars"] == len(r["text"]) for r in got if r["doc_id"] and r["doc_id"] < 240 and r["doc_id"] % 10 == 3)
    packed = cp.STAGES[-1][1](spark, docs, d).collect()
    per = defaultdict(int)
    for r in packed:
        per[r["doc_id"]] += r["n_words"]
    assert per == {i: len(t.split()) for i, t in want.items()}
    bins = defaultdict(list)
    for r in packed:
        bins[r["pack_group"], r["bin"]].append(r)
    assert all(sum(r["n_words"] for r in b) <= bestfit_pack.CAPACITY and len({r["source"] for r in b}) == len(b) for b in bins.values())


def test_run_is_the_stages(spark, corpus):
    d, rows = corpus
    out = cp.run(spark, d)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} >= {0, 2004}
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
