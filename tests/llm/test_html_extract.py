from __future__ import annotations

import itertools
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from fieldlark.llm import html_extract as h


def test_held_out_pages():
    chain = h.fitted()
    pages = [h.blocks(p) for p in h.example_pages(300, seed=77)]
    right = [[int(b.gold) for b in p] == chain.decode(p) for p in pages]
    assert np.mean(right) > 0.97


def test_viterbi_is_the_best_path():
    chain, rng = h.Chain(), np.random.default_rng(0)
    chain.moves = rng.normal(size=(2, 2))
    for n in (1, 2, 7):
        emit = rng.normal(size=(n, 2))
        chain.emissions = lambda page, e=emit: e
        score = lambda p, e=emit: sum(e[i, k] for i, k in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(chain.decode([None] * n)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_marginals_by_enumeration():
    chain, rng = h.Chain(), np.random.default_rng(1)
    chain.moves = rng.normal(size=(2, 2))
    emit = rng.normal(size=(5, 2))
    one, two = chain._marginals(emit)
    want, pairs, total = np.zeros((5, 2)), np.zeros((2, 2)), 0.0
    for p in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(emit[i, k] for i, k in enumerate(p)) + sum(chain.moves[a, b] for a, b in zip(p, p[1:])))
        total += w
        for i, k in enumerate(p):
            want[i, k] += w
        for a, b in zip(p, p[1:]):
            pairs[a, b] += w
    assert np.allclose(one, want / total) and np.allclose(two, pairs / total)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a &amp; b<p>c<br>d", ["a & b", "c d"]),
        ("<div>x<script>var a='</p>';</script>y</div>", ["xy"]),
        ("<!-- no --><P CLASS='q'>  many \n\t blanks </P>", ["many blanks"]),
        ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]),
        ("a < b and <b>bold</b>", ["a < b and bold"]),
        ("<p>unclosed <!-- comment", ["unclosed"]),
        ("<script>never closed", []),
        ("</div></p>text</b>", ["text"]),
        ("<a title=\"x > y\">link</a>", ["link"]),
        ("&#233;&nbsp;&lt;tag&gt;", ["é\xa0<tag>"]),
        ("", []),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in h.blocks(page)] == texts


PAGE = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Big title</h1><p><b>Start here.<br><p>First, some words &amp; more.</p><p>Second part.</p></article><footer>&copy; x</footer></body></html>'


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE), (5, "u", "<article>" + "<p>Some words, here.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = h.extract(df).collect()
    want = "Big title\nStart here.\nFirst, some words & more.\nSecond part."
    assert sorted((str(r["page_id"]), r["text"]) for r in got if r["page_id"] != 5) == [("1", want), ("1", want), ("2", ""), ("3", ""), ("None", want)]
    long = next(r for r in got if r["page_id"] == 5)
    assert long["text"] == "\n".join(["Some words, here."] * 5000) and long["n_chars"] == len(long["text"])
    assert h.extract(df.limit(0)).collect() == []


def family(rng, kind):
    """Labelled pages of layouts that no training page has: (html, blocks of the article)."""
    words = lambda a, b: " ".join("".join(rng.choice(list("aeioubcdfglmnprst"), rng.integers(2, 9))) for _ in range(rng.integers(a, b)))
    line = lambda a=4, b=25: words(a, b).capitalize() + "."
    body = [line() + " " + line() for _ in range(rng.integers(2, 9))]
    title = words(3, 9)
    if kind == "wiki":
        texts, rows = [title], ""
        for p in body:
            head = words(1, 4)
            texts += [head, p]
            rows += f"<h2>{head}</h2><p>{p}</p>"
        return f'<body><div id="mw-head" role="navigation"><ul><li><a href="/a">{words(1, 2)}</a><li><a href="/b">{words(1, 2)}</a></ul></div><main id="bodyContent"><h1>{title}</h1>{rows}</main><footer><ul><li>{words(2, 5)}<li><a href="/p">{words(1, 3)}</a></ul></footer></body>', texts
    if kind == "news":
        mid = len(body) // 2
        return f'<div class="site-header header-top"><a href="/">{words(1, 2)}</a></div><main><article class="story-page"><header-x></header-x><h1>{title}</h1>' + "".join(f"<p>{p}" for p in body[:mid]) + f'<div class="advert-box ad">{line(3, 9)}</div>' + "".join(f"<p>{p}" for p in body[mid:]) + f'</article></main><aside class="most-read"><h3>{words(1, 3)}</h3><ol><li><a href="/1">{words(3, 8)}</a><li><a href="/2">{words(3, 8)}</a></ol></aside><section id="comments-area" class="comments"><p>{line()}</p><p>{line()}</p></section>', [title, *body]
    return f'<html><body><div class="cookie-consent-popup"><p>{line()}</p><button>ok</button></div><div class="page-wrap"><div class="post-content entry"><h1>{title}</h1>' + "<br>".join(f"<p><strong>{p}</strong></p>" for p in body) + f'</div><div class="related widget"><h4>{words(1, 3)}</h4><p>{line(3, 9)}</p></div></div><div class="footer-bottom footer"><p>© {line(2, 6)}</p></div></body></html>', [title, *body]


@pytest.mark.parametrize("kind", ["wiki", "news", "blog"])
def test_families_that_training_lacks(kind):
    chain, rng, right, of = h.fitted(), np.random.default_rng(3), 0, 0
    for _ in range(60):
        page, want = family(rng, kind)
        got = h.main_text(page, chain).split("\n")
        right += len(set(got) & set(want))
        of += len(set(got) | set(want))
    assert right / of > 0.9, (kind, right / of)


class Articles(HTMLParser):
    """Another reading of well-nested pages: the text inside ``article``, outside ``skip``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        self.off += tag in ("script", "style")
        if tag in ("p", "h1", "div", "article"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article"):
            self.lines.append("")
        self.depth -= tag == "article"
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.off:
            self.lines[-1] += data


def test_whole_table_against_another_reading(spark):
    """Every page of the table: its article, read by the parser of the standard library."""
    from fieldlark.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        parser = Articles()
        parser.feed(r["html"] or "")
        lines = [" ".join(re.split("[ \t\n\x0b\x0c\r]+", x)).strip(" ") for x in parser.lines]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x), r["page_id"]


@pytest.mark.parametrize("part", ["<a ", "<div>x", "<div><p>x", "<b>x", '<a "', "<a '>", '<a ">" ', "<!", "<!--", "<script>", "<table><tr><td>x", "<x-{i} class=k{i}>y", "</p>", "<p><span>x", "&#", "<li>x", "<p class='a", "<"])
def test_time_grows_with_the_page(part):
    chain = h.fitted()
    page = "".join(part.replace("{i}", str(i)) for i in range(1_000_000 // len(part)))
    for tail in ("", ">"):
        began = time.process_time()
        h.main_text(page + tail, chain)
        assert time.process_time() - began < 30, part
