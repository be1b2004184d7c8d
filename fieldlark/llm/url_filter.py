"""URL filters: allow and block rules first, gradient-boosted trees for the rest.

The trees see lexical features alone: lengths, depth, digit share, entropy,
parameter counts and how often labelled URLs under the same host suffix were
bad. They are fitted to labelled URLs on the driver, whose number is bounded,
and go to the tasks as a few arrays.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.llm.common import ascii_lower

# The rules, as verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs used at most.
SAMPLE = 6000
#: Parts of them, each seen with the suffix statistics of the others when trees are fitted.
FOLDS = 5
NAMES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digits", "hyphens", "host_entropy", "path_entropy", "parameters", "query_length", "longest_part", "fragment", "secure", "top_rate", "domain_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased, and path up to ``? #``; empty without ``://``."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.char_length(rest) + 4)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.when(there, ascii_lower(host)).otherwise(""), F.when(there, path).otherwise("")


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, of equally long ones the later in order of text; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _parts(url: str) -> tuple[str, str, str, str]:
    scheme, _, rest = url.partition("://") if "://" in url else ("", "", url)
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return scheme, host.lower(), slash + path, query + ("#" if fragment else "")


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


class Suffixes:
    """Log odds of bad URLs by host suffix, smoothed to zero where little is known."""

    def __init__(self, urls: list[str], bad: list[int], smooth: float = 20.0):
        self.seen, self.hits, self.smooth = Counter(), Counter(), smooth
        for u, b in zip(urls, bad):
            for s in set(_suffixes(_parts(u)[1])):
                self.seen[s] += 1
                self.hits[s] += b
        self.rate = (sum(bad) + 1) / (len(bad) + 2)

    def odds(self, suffix: str) -> float:
        p = (self.hits[suffix] + self.smooth * self.rate) / (self.seen[suffix] + self.smooth)
        return math.log(p / (1 - p)) - math.log(self.rate / (1 - self.rate))

    def features(self, urls: list[str | None]) -> np.ndarray:
        """NAMES of each url."""
        out = np.zeros((len(urls), len(NAMES)))
        for i, u in enumerate(urls):
            u = u or ""
            scheme, host, path, query = _parts(u)
            top, domain = map(self.odds, _suffixes(host))
            own = query.rstrip("#")
            out[i] = (
                len(u), len(host), len(path), sum(map(bool, path.split("/"))), host.count(".") + 1,
                sum(map(str.isdigit, u)) / max(1, len(u)), sum(map(str.isdigit, host)), host.count("-"),
                _entropy(host), _entropy(path), own.count("&") + bool(own), len(own), max(map(len, host.split("."))),
                query.endswith("#"), scheme == "https", top, domain,
            )
        return out


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 1) / (len(y) + 2)
        self.start = math.log(p / (1 - p))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(binned, cuts, y - q, q * (1 - q))
            self.trees.append(tree)
            score += leaf
        return self

    def _tree(self, binned, cuts, grad, hess):
        """(feature, cut, leaf value) of a full binary tree in heap order, and each row's leaf value."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node, out = np.zeros(len(grad), np.int64), np.zeros(len(grad))
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            g, h = grad[rows], hess[rows]
            value[k] = self.rate * g.sum() / (h.sum() + self.ridge)
            best = (1e-6, -1, -1)
            if k < size // 2 and len(rows) >= 2 * self.least:
                whole = g.sum() ** 2 / (h.sum() + self.ridge)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(b))))
                    gr, hr = g.sum() - gl, h.sum() - hl
                    gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - whole
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, i)
            if best[1] < 0:
                out[rows] = value[k]
                continue
            feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
            node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
        return (feature, cut, value), out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of bad."""
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                node[go] = 2 * node[go] + 1 + (x[go, f[go]] > cut[node[go]])
            out += value[node]
        return out


SYLLABLES = "ba co di fe go hi ka lu me no pa qui ro sa te vu wa xe yo zu bran cel dor fin gal hem".split()
HEX = "0123456789abcdef"


def example_urls(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, int]]:
    """``n`` labelled URLs, 1 for bad, from a small grammar of how addresses are built.

    Good ones are names of one word, at times two, with dated, filed or plain
    paths; bad ones are chains of words, drawn characters, heaps of labels or
    numbers as hosts, or plain hosts with trails of opaque parameters. Words
    are random syllables, so none can be learnt.
    """
    rng = random.Random(seed)
    pick, choose = rng.random, rng.choice
    word = lambda a, b: "".join(choose(SYLLABLES) for _ in range(rng.randint(a, b)))
    opaque = lambda a, b: "".join(choose(HEX) for _ in range(rng.randint(a, b)))

    def path() -> str:
        return choose((
            "", "/", f"/{word(1, 3)}", f"/{word(1, 2)}/{word(1, 3)}", f"/{word(1, 2)}/{rng.randint(1, 9999)}", f"/{rng.randint(1999, 2026)}/{rng.randint(1, 12)}/{'-'.join(word(1, 3) for _ in range(rng.randint(2, 6)))}",
            f"/{word(1, 1)}/{word(1, 3)}.{choose(('php', 'htm', 'pdf', 'aspx'))}", "/" + "/".join(word(1, 3) for _ in range(rng.randint(2, 5))),
        )) + choose(("", "", "", "/", f"?{word(1, 1)}={rng.randint(1, 99)}", f"?q={word(1, 2)}+{word(1, 2)}", f"#{word(1, 2)}", f"?{word(1, 1)}={word(1, 2)}&{word(1, 1)}={word(1, 2)}"))

    out = []
    for _ in range(n):
        bad = pick() < 0.35
        front, rest = choose(("", "", "www.", "www.", "m.", f"{word(1, 2)}.", f"{word(1, 2)}.{word(1, 3)}.")), path()
        top = choose(("com", "net", "org", "info", "eu", "co", "co.uk", "edu"))
        if not bad:
            name = word(1, 6) if pick() < 0.985 else f"{word(1, 3)}-{word(1, 3)}"
        elif (r := pick()) < 0.6:
            name = "-".join(word(1, 3) for _ in range(rng.randint(2, 4)))
        elif r < 0.7:
            name = opaque(10, 24)
        elif r < 0.78:
            name = ".".join(word(1, 2) for _ in range(rng.randint(4, 7)))
        elif r < 0.86:
            front, name, top = "", ".".join(str(rng.randint(1, 255)) for _ in range(3)), str(rng.randint(1, 255))
        else:
            name = word(2, 4) + str(rng.randint(10, 9999))
            rest = f"/{opaque(6, 20)}?" + "&".join(f"{word(1, 1)}={opaque(8, 40)}" for _ in range(rng.randint(2, 6)))
        if bad and pick() < 0.2:
            top = choose(("xyz", "top", "click", "biz"))
        out.append((f"http{choose(('', 's'))}://{front}{name}.{top}{rest}", int(bad)))
    return out


def fitted(labelled: list[tuple[str, int]] | None = None) -> tuple[Suffixes, BoostedTrees]:
    """Suffix statistics and trees of labelled URLs, those ``SAMPLE`` of least hash; without any, of ``example_urls``."""
    rows = sorted(labelled or example_urls(), key=lambda r: (xxhash.xxh64_intdigest(r[0]), r))[:SAMPLE]
    x, bad = np.zeros((len(rows), len(NAMES))), np.array([b for _, b in rows], float)
    for k in range(FOLDS):  # a URL's own label must not reach the trees through its suffix
        rest = [r for i, r in enumerate(rows) if i % FOLDS != k]
        x[k::FOLDS] = Suffixes([u for u, _ in rest], [b for _, b in rest]).features([u for u, _ in rows[k::FOLDS]])
    return Suffixes([u for u, _ in rows], [b for _, b in rows]), BoostedTrees().fit(x, bad)


def judge(pages: DataFrame, labelled: list[tuple[str, int]] | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row of ``pages``.

    ``verdict`` is that of the longest rule that fits, else the trees'; the
    trees' log odds stand in ``score`` for every row. A null or empty url, or
    one without ``://``, has empty host and path, fits no rule and is judged by
    the trees like any other. Very long urls are read whole. Null ids and
    repeated rows keep their rows; an empty table gives an empty result; extra
    columns are not read.
    """
    suffixes, trees = fitted(labelled)

    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        return pd.Series(trees.scores(suffixes.features(url.where(url.notna(), None).tolist())))

    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), ruled.alias("_ruled"), score("url").alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
