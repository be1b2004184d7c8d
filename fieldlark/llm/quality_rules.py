"""Quality rules: a learned decision list over text statistics, all in Spark expressions.

Statistics are array and string functions of a row, so a text never leaves its
task. Rules are learnt by sequential covering from a bounded sample of labelled
rows: each is grown one threshold at a time by information gain, pruned on rows
it was not grown on, and kept if it stays precise there. The list becomes one
ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.llm.common import whole

#: Labelled rows that rules are learnt from at most: those of least id hash.
SAMPLE = 4000
MOST_RULES, MOST_CONDITIONS, MOST_CUTS = 12, 3, 48
#: A rule needs so much precision, and at least so many bad rows and such a share of all rows to show it on.
LEAST_PRECISION, LEAST_COVER, LEAST_SHARE = 0.95, 3, 0.004

BLANK = " \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, made from the statistics.
FEATURES = ("symbols_per_word", "upper_per_char", "exclaims_per_word", "distinct_per_word", "repeat_per_word", "dup_lines_per_word", "chars_per_word")


def _once(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Adds a column that later expressions, lambdas above all, use without computing it again.

    A generator stops the optimizer from copying ``expr`` into its users.
    """
    return df.select("*", F.explode_outer(F.array(F.expr(expr))).alias(name))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of BASE, all long, and n_upper, n_exclaim, n_distinct."""
    own = docs.columns
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_trim", F.expr(f"trim(BOTH '{BLANK}' FROM _t)"))
    df = _once(df, "_w", r"if(_trim = '', array(), split(_trim, '[\\x20\\x09-\\x0D]+', -1))")
    df = _once(df, "_lines", f"filter(split(_t, '\\n', -1), l -> trim(BOTH '{BLANK}' FROM l) <> '')")
    df = _once(df, "_h", "transform(_w, w -> xxhash64(w))")
    # Hashes of all windows of three words. Sorted by their upper 33 bits with the place below, those that share
    # these bits with no other are single; the rest, few unless the text repeats itself, are sorted by the whole hash.
    df = _once(df, "_win", "if(size(_h) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_h) - 3), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2])))")
    df = _once(df, "_s", "sort_array(transform(_win, (h, i) -> shiftleft(h, 31) | i))")
    beside = "(k > 0 and {0} = {1}) or (k < size({3}) - 1 and {0} = {2})"
    near = beside.format("shiftright(x, 31)", "shiftright(_s[k - 1], 31)", "shiftright(_s[k + 1], 31)", "_s")
    df = _once(df, "_c", f"transform(filter(_s, (x, k) -> {near}), x -> cast(x & 2147483647L as int))")
    df = _once(df, "_e", "sort_array(transform(_c, i -> struct(_win[i] as h, i as i)))")
    same = beside.format("x.h", "_e[k - 1].h", "_e[k + 1].h", "_e")
    df = _once(df, "_f", f"sort_array(transform(filter(_e, (x, k) -> {same}), x -> cast(x.i as bigint)))")
    stats = {
        "n_words": "size(_w)",
        "word_chars": "length(array_join(_w, ''))",
        "n_symbols": r"length(_t) - length(regexp_replace(_t, '[#*$%&|<>]+', ''))",
        "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
        "n_repeat_words": "aggregate(transform(_f, (p, k) -> if(k < size(_f) - 1, least(3L, _f[k + 1] - p), 3L)), 0L, (a, x) -> a + x)",
        "n_upper": r"length(regexp_replace(_t, '[^\\p{Lu}]+', ''))",
        "n_exclaim": "length(_t) - length(replace(_t, '!', ''))",
        "n_distinct": "size(array_distinct(_h))",
    }
    return df.select(*own, *(F.expr(e).cast("long").alias(n) for n, e in stats.items()))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def features(df: DataFrame) -> DataFrame:
    """The ratios of FEATURES; zero where there is no word."""
    per_word = {"symbols_per_word": "n_symbols", "exclaims_per_word": "n_exclaim", "distinct_per_word": "n_distinct", "repeat_per_word": "n_repeat_words", "dup_lines_per_word": "n_dup_lines", "chars_per_word": "word_chars"}
    ratios = {n: F.expr(f"coalesce(try_divide(cast({c} as double), n_words), 0D)") for n, c in per_word.items()}
    ratios["upper_per_char"] = F.expr("coalesce(try_divide(cast(n_upper as double), word_chars), 0D)")
    return df.withColumns(ratios)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _cuts(values: list[float]) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned evenly by rank."""
    distinct = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]
    step = max(1, -(-len(mid) // MOST_CUTS))
    return mid[step // 2 :: step]


def _best_condition(rows: list[dict]) -> Condition | None:
    """The threshold of most FOIL gain."""
    bad, good = _counts(rows)
    before = math.log2(bad / (bad + good))
    best, found = 1e-9, None
    for f in FEATURES:
        column = [(r[f], r["bad"]) for r in rows]
        for cut in _cuts([v for v, _ in column]):
            over_bad = sum(b for v, b in column if v > cut)
            over = sum(v > cut for v, _ in column)
            for above, p, n in ((True, over_bad, over - over_bad), (False, bad - over_bad, len(rows) - over - bad + over_bad)):
                gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                if gain > best:
                    best, found = gain, Condition(f, above, cut)
    return found


def _grown(rows: list[dict]) -> Rule:
    rule: Rule = ()
    inside = rows
    while len(rule) < MOST_CONDITIONS and all(_counts(inside)):
        c = _best_condition(inside)
        if c is None:
            break
        rule += (c,)
        inside = _covered(rule, rows)
    return rule


def _pruned(rule: Rule, rows: list[dict]) -> Rule:
    """The beginning of ``rule`` that is best on rows it was not grown on."""

    def worth(k: int) -> tuple[float, int]:
        bad, good = _counts(_covered(rule[:k], rows))
        return (bad - good) / max(1, bad + good), -k

    return rule[: max(range(1, len(rule) + 1), key=worth)] if rule else rule


def learn(rows: list[dict]) -> list[Rule]:
    """An ordered list of rules that reject, from rows with FEATURES, ``bad`` (0 or 1) and ``fold``.

    Rows of fold 0 prune, the others grow. Without bad or without good rows
    there is no rule.
    """
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        grow, prune = [r for r in left if r["fold"]], [r for r in left if not r["fold"]]
        if not all(_counts(grow)):
            break
        rule = _pruned(_grown(grow), prune)
        inside = _covered(rule, left) if rule else []
        (bad, good), (held_bad, held_good) = _counts(inside), _counts(_covered(rule, prune) if rule else [])
        if bad < max(LEAST_COVER, LEAST_SHARE * len(rows)) or bad < LEAST_PRECISION * (bad + good) or held_bad < LEAST_PRECISION * (held_bad + held_good):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """FEATURES, ``bad`` and ``fold`` of at most ``sample`` labelled documents that pass the base rule."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = features(statistics(text)).where(~base_failed())
    rows = found.select(*FEATURES, (F.col("quality") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("fold"))
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: tuple(r[f] for f in FEATURES))


def rule_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[i - 1]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with BASE, base_failed, rule and kept.

    A null or empty text, or one without a word, has zero counts and fails the
    base rule. Very long texts are counted whole. Repeated rows and null ids
    keep their rows; an empty table gives an empty result. Columns of ``docs``
    that bear one of the new names give way to it.
    """
    names = {*BASE, "n_upper", "n_exclaim", "n_distinct", *FEATURES, "base_failed", "rule", "kept"}
    df = features(statistics(docs.drop(*(names & set(docs.columns)))))
    df = df.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rule_column(rules)))
    own = [c for c in docs.columns if c not in names]
    return df.select(*own, *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE, base_failed, rule, kept) with rules learnt from ``labels`` (doc_id, quality); see ``judge``."""
    return judge(docs.select("doc_id", "text"), learn(labelled_rows(docs, labels))).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged."""
    rules = learn(labelled_rows(docs, labels))
    rows = whole(docs, "row").select("row", F.col("row.text").alias("text"))
    return judge(rows, rules).where("kept").select("row.*")
