"""Main-text extraction: a linear-chain conditional random field over leaf blocks.

A page is cut into the text blocks between its block-level tags. Each block is
described by its ancestors' tags and class words and by its text. A two-label
chain over these features, fitted by maximum likelihood to labelled pages, is
decoded by Viterbi; the blocks it calls text are the article.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Container
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, types as T

from fieldlark.llm.common import map_texts

# Element classes of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object canvas".split())
CLOSES_P = BLOCK_TAGS - {"button", "option", "optgroup", "body", "html", "head"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select menu".split())

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[>\"']")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW_TAGS}
NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]{2,}")
BLANKS = re.compile(r"[ \t\n\x0b\x0c\r]+")
GOLD = "data-gold"


@dataclass
class Block:
    """A text with the tag right around it, the innermost block tag, and features of all its ancestors."""

    text: str
    tag: str
    block: str
    inside: frozenset[str]
    linked: int
    gold: bool = False


@dataclass
class _Open:
    tag: str
    block: str
    inside: frozenset[str]
    gold: bool


class _Stack:
    """The open elements. Whatever the depth, a look at it takes the same time.

    An element holds the features of all its ancestors; one that adds nothing
    shares its parent's set. ``known`` bounds the features, and so the sets.
    """

    def __init__(self, known: Container[str] | None):
        self.open = [_Open("", "", frozenset(), False)]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.known = known

    def push(self, tag: str, attributes: str) -> None:
        top = self.open[-1]
        names = [f"in={tag}"]
        if attributes:
            named = " ".join("".join(x[1:]) for x in NAMING.findall(attributes)).lower()
            names += [f"named={w}" for w in WORDS.findall(named)]
        new = [f for f in names if f not in top.inside and (self.known is None or f in self.known)]
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(_Open(tag, tag if tag in BLOCK_TAGS else top.block, top.inside.union(new) if new else top.inside, top.gold or GOLD in attributes))

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, 0 if none is open."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close(self, tags: tuple[str, ...]) -> None:
        """Ends the innermost of ``tags`` unless a list or table was opened within it."""
        at = max(map(self.last, tags))
        if at and at > (self.scopes[-1] if self.scopes else 0):
            self.cut(at)


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """The text blocks of a page in order; raw elements, comments and markup are gone.

    Takes time in proportion to the page, however broken: a tag ends at the
    next ``>`` outside quotes or, once a page has a tag for which there is
    none, at the next ``>`` of any kind; with none left, ``<`` is text.
    """
    out: list[Block] = []
    page = page or ""
    stack = _Stack(known)
    held: list[str] = []
    linked = 0
    quoted, at, size = True, 0, len(page)
    final = {c: page.rfind(c) for c in ">\"'"}

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = BLANKS.sub(" ", html.unescape(raw)).strip(" ")
            if text:
                top = stack.open[-1]
                out.append(Block(text, top.tag, top.block, top.inside, round(10 * linked / max(1, len(raw))), top.gold))
            held.clear()
            linked = 0

    def tag_end(start: int) -> int:
        """Behind the ``>`` of the tag whose attributes begin at ``start``."""
        nonlocal quoted
        i = start
        while quoted:
            m = STOP.search(page, i)
            if m is None:
                quoted = False
                break
            c, i = m.group(), m.end()
            if c == ">":
                return i
            if final[c] >= i:
                i = page.index(c, i) + 1
        return page.index(">", start) + 1

    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            held.append(page[at:end])
            linked += (end - at) * bool(stack.last("a"))
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        m = TAG.match(page, at) if final[">"] > at else None
        if m is None:
            if final[">"] > at and page[at + 1] in "!?":
                at = page.index(">", at) + 1
            else:
                held.append("<")
                linked += bool(stack.last("a"))
                at += 1
            continue
        at = tag_end(m.end())
        tag, attributes = m.group(2).lower(), page[m.end() : at - 1]
        if m.group(1):
            if tag in BLOCK_TAGS:
                flush()
            if found := stack.last(tag):
                stack.cut(found)
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P:
                stack.close(("p",))
            if tag in SELF_CLOSING:
                stack.close(SELF_CLOSING[tag])
        if tag == "br":
            held.append(" ")
        if tag in RAW_TAGS and not attributes.rstrip().endswith("/"):
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag not in VOID_TAGS:
            stack.push(tag, attributes)
    flush()
    return out


def describe(b: Block, place: int, count: int) -> list[str]:
    """Names of the features a block has."""
    n = b.text.count(" ") + 1
    out = ["any", f"tag={b.tag}", f"words={min(7, int(math.log2(n)))}", f"linked={b.linked // 2}", f"block={b.block}", *b.inside]
    if b.text[-1] in ".!?:;\"')":
        out.append("stops")
    if b.text[0] in "©|»·" or "©" in b.text:
        out.append("sign")
    out.append(f"commas={min(3, b.text.count(','))}")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


@dataclass
class Chain:
    """Weights (feature, label) and transitions; label 1 is article text."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, b in enumerate(page):
            known = [self.names[f] for f in describe(b, i, len(page)) if f in self.names]
            out[i] = self.weights[known].sum(0)
        return out

    def fit(self, pages: list[list[Block]], epochs: int = 12, rate: float = 0.3, ridge: float = 1e-4, seed: int = 5) -> Chain:
        """Maximum likelihood by AdaGrad over pages whose blocks carry ``gold``."""
        data = []
        for page in pages:
            feats = [[self.names.setdefault(f, len(self.names)) for f in describe(b, i, len(page))] for i, b in enumerate(page)]
            if feats:
                data.append((np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.array([int(b.gold) for b in page])))
        self.weights = np.zeros((len(self.names), 2))
        seen_w, seen_m = np.full_like(self.weights, 1e-8), np.full((2, 2), 1e-8)
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(data)
            for flat, of, gold in data:
                n = len(gold)
                emit = np.zeros((n, 2))
                np.add.at(emit, of, self.weights[flat])
                one, two = self._marginals(emit)
                diff = -one
                diff[np.arange(n), gold] += 1
                grad = np.zeros_like(self.weights)
                np.add.at(grad, flat, diff[of])
                used = np.unique(flat)
                g = grad[used] - ridge * self.weights[used]
                seen_w[used] += g * g
                self.weights[used] += rate * g / np.sqrt(seen_w[used])
                moves = -two
                np.add.at(moves, (gold[:-1], gold[1:]), 1)
                moves -= ridge * self.moves
                seen_m += moves * moves
                self.moves += rate * moves / np.sqrt(seen_m)
        return self

    def _marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of each block, and expected transitions."""
        n = len(emit)
        e, m = np.exp(emit - emit.max(1, keepdims=True)), np.exp(self.moves)
        ahead, back = np.zeros((n, 2)), np.ones((n, 2))
        ahead[0] = e[0] / e[0].sum()
        for i in range(1, n):
            a = (ahead[i - 1] @ m) * e[i]
            ahead[i] = a / a.sum()
        for i in range(n - 2, -1, -1):
            b = m @ (e[i + 1] * back[i + 1])
            back[i] = b / b.sum()
        one = ahead * back
        one /= one.sum(1, keepdims=True)
        pairs = ahead[:-1, :, None] * m * (e[1:] * back[1:])[:, None, :]
        return one, (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi; of equal paths the one with boilerplate earlier."""
        if not page:
            return []
        emit, m = self.emissions(page).tolist(), self.moves.tolist()
        best, came = emit[0], []
        for e in emit[1:]:
            step = [max((0, 1), key=lambda a, k=k: best[a] + m[a][k]) for k in (0, 1)]
            best = [best[step[k]] + m[step[k]][k] + e[k] for k in (0, 1)]
            came.append(step)
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(came):
            label = step[label]
            out.append(label)
        return out[::-1]


SOUNDS = "ba de fi go hu ka le mi no pu ra se ti vo wy zan ber dis fol gar hem jin kor lum".split()


def example_page(rng: random.Random) -> str:
    """A page from a grammar of common layouts; elements of the article carry ``data-gold``.

    Layouts, class words and tag soup are those that HTML at large has; nothing
    is taken from the pages the operator is run on.
    """
    pick, choose = rng.random, rng.choice
    word = lambda: "".join(choose(SOUNDS) for _ in range(rng.randint(1, 4)))
    noise = choose(("", "", "", "", "~~", "@", "&amp;"))
    some = lambda a, b: " ".join(word() + choose(("", "", "", "", "", ",")) + noise for _ in range(rng.randint(a, b)))
    line = lambda a, b: some(a, b).capitalize() + choose((".", ".", ".", "!", "?", ""))
    text = lambda: " ".join(line(1, 18) for _ in range(rng.randint(1, 6)))
    link = lambda: f'<a href="{choose(("/", "#", "?q=", "https://"))}{word()}">{some(1, 3)}</a>'
    listed = lambda k: "".join(f"<li>{link()}{choose(("</li>", "</li>", ""))}" for _ in range(k))
    named = lambda *words: f'{choose(("class", "class", "id"))}="{choose(words)}"'

    def soup(inner: str) -> str:
        """``inner`` in inline tags that may be left open or closed in the wrong order."""
        tag, other = rng.sample(("b", "i", "em", "strong", "span", "u", "small"), 2)
        return choose((f"<{tag}>{inner}</{tag}>", f"<{tag}>{inner}", f"<{tag}><{other}>{inner}</{tag}></{other}>", f"{inner}</{tag}>", f"{inner}<br>", f"<{tag}>{inner}<br/>"))

    def boiler(kind: str) -> str:
        return {
            "nav": f"<nav>{choose(('', f'<h2>{some(1, 2)}</h2>'))}<ul>{listed(rng.randint(2, 8))}</ul></nav>",
            "menu": f'<div {named("menu", "navigation", "navbar", "breadcrumb", "topbar", "site-nav")}>' + choose((f"<ul>{listed(rng.randint(2, 8))}</ul>", " | ".join(link() for _ in range(4)))) + "</div>",
            "header": f"<header>{link()}<p>{line(2, 8)}</p></header>",
            "masthead": f'<div {named("header", "masthead", "banner", "logo")}><p>{line(1, 6)}</p>{link()}</div>',
            "footer": f"<footer>{choose(('', '<p>'))}{choose(('©', '&copy;', 'Copyright'))} {rng.randint(1995, 2030)} {line(1, 12)}{choose(('', ' ' + link()))}</footer>",
            "foot": f'<div {named("footer", "colophon", "bottom", "legal")}><p>{choose(("©", "&#169;", ""))} {line(1, 9)}</p><ul>{listed(3)}</ul></div>',
            "aside": f"<aside {named('sidebar', 'right', 'more')}><h3>{some(1, 3)}</h3><p>{text()}</p><ul>{listed(rng.randint(1, 5))}</ul></aside>",
            "side": f'<div {named("sidebar", "widget", "related", "teaser", "recommended", "tags")}><h4>{some(1, 4)}</h4><p>{line(3, 20)}</p></div>',
            "ad": f'<div {named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot")}>{choose(("", "<p>"))}{line(2, 14)}</div>',
            "notice": f'<div {named("cookie", "notice", "consent", "alert", "popup", "gdpr", "cookie-bar")}><p>{line(4, 20)}</p><button>{word()}</button></div>',
            "form": f'<form action="/{word()}"><label>{some(1, 3)}</label><input name="{word()}"><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>',
            "signup": f'<form {named("newsletter", "signup", "search", "login")}><p>{line(4, 14)}</p><input type="text"><button>{some(1, 2)}</button></form>',
            "comments": f'<{(s := choose(("section", "div")))} {named("comments", "comment-list", "responses", "discussion", "replies")}><h2>{some(1, 2)}</h2>' + "".join(f"<div {named('comment', 'reply')}><b>{word()}</b><p>{text()}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{s}>",
            "replies": f"<ol {named('comments', 'thread')}>" + "".join(f"<li>{text()}" for _ in range(rng.randint(1, 4))) + "</ol>",
            "share": f'<div {named("share", "social", "toolbar")}>{link()} {link()}</div>',
            "script": f"<script>if (a < {rng.randint(0, 9)}) {{ {word()}('<p>'); }}</script>",
            "note": f"<!-- {choose(('<p>', ''))}{line(2, 6)} -->",
        }[kind]

    def piece() -> str:
        r = pick()
        if r < 0.56:
            return f"<p>{text()}{choose(('</p>', '</p>', '</p>', ''))}"
        if r < 0.7:
            return f"<p>{soup(text())}" + choose(("</p>", "", "<p>" + text()))
        if r < 0.77:
            return f"<h{(h := rng.randint(2, 4))}>{some(1, 8)}</h{h}>"
        if r < 0.83:
            return f"<{(t := choose(('ul', 'ol')))}>" + "".join(f"<li>{line(1, 12)}{choose(('</li>', ''))}" for _ in range(rng.randint(2, 5))) + f"</{t}>"
        if r < 0.88:
            return f"<p>{line(3, 9)} {link()} <em>{some(1, 4)}</em> {line(2, 20)}</p>"
        if r < 0.92:
            return f"<blockquote>{text()}</blockquote>"
        if r < 0.95:
            return f"<figure><figcaption>{line(3, 9)}</figcaption></figure>"
        if r < 0.98:
            return "<table>" + "".join(f"<tr><td>{some(1, 3)}<td>{some(1, 3)}" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<pre>{some(3, 20)}</pre>"

    tag, name = choose((("article", ""), ("article", ""), ("article", f" {named('post', 'entry', 'hentry')}"), ("main", ""), ("div", f" {named('content', 'main', 'article', 'article-body')}"), ("div", f" {named('entry', 'post', 'post-body', 'text')}"), ("section", f" {named('story', 'body', 'article')}")))
    inside = [f"<h1>{some(1, 12)}</h1>"] * (pick() < 0.85) + [piece() for _ in range(rng.randint(1, 14))]
    article = "".join(inside)
    if pick() < 0.35:  # boilerplate inside the article's element
        cut = rng.randint(1, len(inside))
        extra = boiler(choose(("ad", "share", "side", "form", "signup", "comments", "aside", "notice")))
        body = f"<{tag}{name}><div {GOLD}>{''.join(inside[:cut])}</div>{extra}<div {GOLD}>{''.join(inside[cut:])}</div></{tag}>"
    else:
        body = f"<{tag}{name} {GOLD}>{article}</{tag}>"
    before = [boiler(k) for k in rng.sample(("nav", "menu", "header", "masthead", "ad", "notice", "form", "script", "note", "signup"), rng.randint(0, 5))]
    after = [boiler(k) for k in rng.sample(("footer", "foot", "aside", "side", "ad", "comments", "replies", "share", "form", "nav", "script", "notice"), rng.randint(0, 5))]
    if pick() < 0.04:
        return f"<p {GOLD}>{text()}"
    if pick() < 0.15:
        body = f"<main>{body}</main>" if tag != "main" else f"<div {named('wrap', 'page', 'container')}>{body}</div>"
    style = choose(("", f"<style>.{word()} {{ color: red }}</style>"))
    return f"{choose(('', '<!doctype html>'))}<html><head><title>{some(1, 10)}</title>{style}</head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def example_pages(n: int = 400, seed: int = 3) -> list[str]:
    """``n`` labelled pages of many layouts."""
    rng = random.Random(seed)
    return [example_page(rng) for _ in range(n)]


_fitted: dict[tuple[int, int], Chain] = {}


def fitted(n: int = 400, seed: int = 3) -> Chain:
    """The chain of ``n`` labelled pages, fitted once per driver."""
    if (n, seed) not in _fitted:
        _fitted[n, seed] = Chain().fit([blocks(p) for p in example_pages(n, seed)])
    return _fitted[n, seed]


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page, chain.names)
    return "\n".join(b.text for b, label in zip(found, chain.decode(found)) if label)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``; n_chars counts code points.

    A null or empty html, or one without a block of text, gives "" and 0. Very
    long pages are read whole; unclosed tags and comments are borne. Null ids
    and urls and repeated rows keep their rows; an empty table gives an empty
    result; extra columns are not read.
    """
    chain = chain or fitted()

    def run(texts: list[str | None]) -> list:
        out = [main_text(t, chain) for t in texts]
        return [out, [len(t) for t in out]]

    return map_texts(pages, "html", [("text", T.StringType()), ("n_chars", T.LongType())], run, ("page_id", "url"))
