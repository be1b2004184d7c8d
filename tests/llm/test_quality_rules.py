from __future__ import annotations

import re
from collections import Counter

import numpy as np

from fieldlark.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = np.random.default_rng(4)
    out = [None, "", " \n\t ", "one", "one two", "a b c", "a b c a b c", "x\x0by\x0cz\r\nx", "é😀 #*$ | <b> &amp; %", "l\nl\nl\n\n \nl ", "a a a a a a", "ÀÉ ù ß"]
    for n in (30, 80, 900, 2000):
        words = rng.choice(["the", "of", "and", "cat", "#x", "dog|", "é"], n)
        seps = rng.choice([" ", "  ", "\n", "\t", "\r\n", " \x0c"], n)
        out.append("".join(w + s for w, s in zip(words, seps)))
    out.append(" ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(["again and again"] * 3000))
    return out


def test_statistics_against_counting(spark):
    rows = list(enumerate(texts()))
    got = q.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[n] for n in q.BASE) == plain(rows[r["doc_id"]][1]), rows[r["doc_id"]][1][:80]


def test_repeats_in_a_very_long_text(spark):
    """Over 2^20 windows, three quarters of them repeated, of more kinds than can have upper bits of their own."""
    rng = np.random.default_rng(9)
    once = [f"u{i}" for i in range(280_000)]
    pairs = [f"r{i}" for i in range(420_000)]
    words = [*once, *pairs, "middle", *(pairs[i] for k in rng.permutation(4200) for i in range(100 * k, 100 * k + 100))]
    text = " ".join(words)
    (row,) = q.statistics(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["n_words"] > 1 << 20 and tuple(row[n] for n in q.BASE) == plain(text)


def test_learns_planted_rules():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        r = {f: float(rng.random()) for f in q.FEATURES}
        noisy = rng.random() < 0.01
        r["bad"] = int((r["symbols_per_word"] > 0.8 or (r["upper_per_char"] > 0.7 and r["exclaims_per_word"] > 0.6)) ^ noisy)
        r["fold"] = i % 3
        rows.append(r)
    rules = q.learn(rows)
    assert rules and rules == q.learn(list(rows))
    caught = lambda r: any(all(c.holds(r) for c in rule) for rule in rules)
    hits = [r for r in rows if caught(r)]
    assert sum(r["bad"] for r in hits) >= 0.9 * len(hits) and sum(r["bad"] for r in hits) >= 0.7 * sum(r["bad"] for r in rows)


def test_no_rule_without_both_labels():
    row = dict.fromkeys(q.FEATURES, 0.5) | {"bad": 0, "fold": 1}
    assert q.learn([row] * 20) == [] and q.learn([row | {"bad": 1}] * 20) == [] and q.learn([]) == []


def corpus(spark, n=300):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"{w}" + ("***" if bad else "") for w in rng.integers(0, 5000, 80)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1 - bad, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_verdicts(spark):
    docs, labels = corpus(spark)
    more = spark.createDataFrame([(1000, None, None), (1001, "", None), (None, "a b c", None), (1, "short again", None)], "doc_id long, text string, lang string")
    odd = labels.union(spark.createDataFrame([(None, 0, 0), (5, None, 0), (9999, 0, 0), (8, 0, 0)], labels.schema))
    got = q.verdicts(docs.union(more).selectExpr("*", "1 as kept", "2 as n_words"), odd).collect()
    assert len(got) == 304
    for r in got:
        words = r["n_words"]
        assert r["base_failed"] == (words < 50 or 100 * r["n_repeat_words"] > 50 * words)
        if words >= 50:
            assert r["kept"] == (r["doc_id"] % 4 != 0)
        else:
            assert not r["kept"]


def test_native_and_whole(spark):
    from fieldlark.plans.catalog import plan_text

    docs, labels = corpus(spark)
    rules = q.learn(q.labelled_rows(docs, labels))
    plan = plan_text(q.judge(docs, rules))
    assert not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "Exchange"))
    kept = q.keep_good(docs.selectExpr("*", "1 as n_words"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "n_words"] and {r["n_words"] for r in kept.collect()} == {1}
    assert kept.count() == 225


def test_empty_tables(spark):
    docs, labels = corpus(spark, 8)
    assert q.verdicts(docs.limit(0), labels).collect() == []
    got = q.verdicts(docs, labels.limit(0)).collect()
    assert len(got) == 8 and all(r["kept"] for r in got)


def test_ordered_conditions(spark):
    rules = [(q.Condition("symbols_per_word", True, 1.0),), (q.Condition("symbols_per_word", True, 0.5), q.Condition("repeat_per_word", False, 0.1))]
    df = spark.createDataFrame([(2.0, 0.0), (0.7, 0.0), (0.7, 0.5), (0.1, 0.0)], "symbols_per_word double, repeat_per_word double")
    assert [r[0] for r in df.select(q.rule_column(rules)).collect()] == [1, 2, None, None]
