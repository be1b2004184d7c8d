"""SentencePiece merge-type encoding and decoding, checked against the library.

A text is cut where no vocabulary entry can reach across: before a run of
spaces, around line breaks and between letters or digits and other characters.
Each stretch is merged with a score-ordered agenda of adjacent symbol pairs. Encoded stretches are
remembered in a bounded table, and every stretch is put to the sentencepiece
library before its ids are used for the first time in a batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, types as T

from fieldlark.llm.common import map_texts

SPACE = "▁"
#: Stretches remembered per Python worker, and the longest one remembered.
REMEMBERED = 1_200_000
LONGEST = 200
#: Symbols up to which the agenda is a plain row, and the cost of a pair that never merges.
SHORT, NEVER = 48, float("inf")

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def public_tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


class Codec:
    """Encoder and decoder of one merge-type vocabulary file."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("only merge-type vocabularies with byte fallback are covered")
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
            raise ValueError("only identity normalisation with a leading space is covered")
        self.pieces: list[str] = []
        self.cost: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i, (_, entry) in enumerate((k, v) for k, v in top if k == 1):
            e = dict(_fields(entry))
            piece, kind = e[1].decode(), e.get(3, NORMAL)
            self.pieces.append(piece)
            self.raw.append(b"" if kind in (CONTROL, UNKNOWN) else piece.replace(SPACE, " ").encode())
            if kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(piece[1:-1], 16)])
            elif kind == NORMAL:
                self.cost[piece] = -struct.unpack("<f", e.get(2, b"\0\0\0\0"))[0]
                self.ids[piece] = i
            elif kind in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused entries are not covered")
        self.end = self.library.eos_id()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("an entry reaches across the start of a word")
        word, other = r"[^\W_]", r"[^\w\n]|_"
        mixed = [p for p in self.ids if not re.fullmatch(f"{SPACE}*({word}+|({other})*)", p)]
        if mixed:  # their letters and digits count as other characters
            odd = "".join(sorted({re.escape(ch) for p in mixed for ch in p if re.match(word, ch)}))
            word, other = rf"[^\W_{odd}]", rf"[^\w\n]|[_{odd}]"
        if not all(re.fullmatch(f"{SPACE}*({word}+|({other})*)", p) for p in self.ids):
            raise ValueError("an entry reaches across a line break or the end of a word")
        self.cut = re.compile(rf" *{word}+| *(?:(?! )(?:{other}))+| +|\n").findall
        self.lead = self.merged(" ") + self.merged("\n")
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merged(self, stretch: str) -> list[int]:
        """Ids of a stretch without cuts, spaces as such."""
        sym = list(stretch.replace(" ", SPACE))
        sym = self._short(sym) if len(sym) <= SHORT else self._long(sym)
        ids = list(map(self.ids.get, sym))
        if None in ids:  # characters without an entry are spelt as bytes
            ids = [x for i, p in zip(ids, sym) for x in ([i] if i is not None else [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")])]
        return ids

    def _short(self, sym: list[str]) -> list[str]:
        """The agenda as a row of costs beside the symbols: least cost first, then leftmost."""
        get, never = self.cost.get, NEVER
        costs = [get(a + b, never) for a, b in zip(sym, sym[1:])]
        while costs and (least := min(costs)) is not never:
            i = costs.index(least)
            one = sym[i] = sym[i] + sym.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(one + sym[i + 1], never)
            if i:
                costs[i - 1] = get(sym[i - 1] + one, never)
        return sym

    def _long(self, sym: list[str]) -> list[str]:
        """The agenda as a heap; an entry is stale once either symbol has changed."""
        n, get = len(sym), self.cost.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n and (c := get(sym[i] + sym[j])) is not None:
                heapq.heappush(agenda, (c, i, j, len(sym[i]) + len(sym[j])))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or after[i] != j or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(i, after[i])
            propose(before[i], i)
        return [p for p in sym if p]

    def _against(self, fresh: dict[str, list[int]]) -> None:
        """Raises if the library encodes or decodes any of the stretches differently.

        All are asked for at once, each after a line break: no entry reaches
        across one, and the library puts nothing before what follows it.
        """
        text = "\n" + "\n".join(fresh)
        want, line = list(self.lead[:-1]), self.lead[-1]
        for ids in fresh.values():
            want.append(line)
            want += ids
        if self.library.encode(text, num_threads=1) != want:
            raise ValueError(f"library and agenda differ on one of {list(fresh)[:20]}")
        if self.library.decode(want) != text:
            raise ValueError(f"library does not decode to one of {list(fresh)[:20]}")
        if b" " + text.encode() != self.bytes_of(want):
            raise ValueError(f"library and table decode one of {list(fresh)[:20]} differently")

    def bytes_of(self, ids: list[int]) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids])

    def learn(self, stretches: set[str]) -> dict[str, str]:
        """Ids, as text, of the stretches that were not known; the library has agreed to each, and that they decode to it."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unseen = stretches.difference(known)
        known.update((s, older[s]) for s in unseen if s in older)
        fresh = {s: self.merged(s) for s in unseen if s not in older}
        if self.check and fresh:
            self._against(fresh)
        made = {s: " ".join(map(str, ids)) for s, ids in fresh.items()}
        known.update((s, v) for s, v in made.items() if len(s) <= LONGEST)
        return made

    def stretches(self, text: str) -> list[str]:
        """Where a text may be cut; its leading space is put first, as the library does."""
        return self.cut(" " + text.replace(SPACE, " ")) if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[str]:
        """Ids, as text, of each text without end id; learnt for a bounded number of texts at once."""
        for k in range(0, len(texts), 256):
            cuts = [self.stretches(t) for t in texts[k : k + 256]]
            made = self.learn(set().union(*cuts))
            known = self.known
            for c in cuts:
                try:
                    yield " ".join(map(known.__getitem__, c))
                except KeyError:  # too long to remember
                    yield " ".join([known[s] if s in known else made[s] for s in c])

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [int(i) for i in next(self.encode_batch([text])).split()]
        return ids + [self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the library has agreed to it, or made it if they hold what no text encodes to."""
        try:
            text = self.bytes_of(ids).removeprefix(b" ").decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode(ids)
        if self.check and (made := self.library.decode(ids)) != text:
            if self.library.unk_id() in ids:
                return made
            raise ValueError(f"library and table decode {ids[:20]} ... differently")
        return text


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, check: bool = True) -> Codec:
    """One codec per Python worker and file."""
    if (path, check) not in _codecs:
        _codecs[path, check] = Codec(path, check)
    return _codecs[path, check]


def digest_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``.

    Ids are those of the sentencepiece library with an end id; the decoded
    text is made from these ids, all of them, and is the library's. A null or empty text has the end id
    alone and decodes to "". Null and repeated doc_ids keep their rows; very
    long texts are encoded whole; an empty table gives an empty result; extra
    columns are not read.
    """

    def run(texts: list[str | None]) -> list:
        c = codec(path or public_tokenizer())
        n, ids, decoded = [], [], []
        for spelt in c.encode_batch([t or "" for t in texts]):
            spelt = f"{spelt} {c.end}" if spelt else str(c.end)
            own = np.fromstring(spelt, np.int32, sep=" ").tolist()
            n.append(len(own))
            ids.append(hashlib.sha256(spelt.encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
        return [n, ids, decoded]

    return map_texts(docs, "text", [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], run)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) with the end id, one row per row of ``docs``; cases as in ``digest_rows``."""

    def run(texts: list[str | None]) -> list:
        c = codec(path or public_tokenizer())
        return [[np.array([*spelt.split(), c.end], np.int32) for spelt in c.encode_batch([t or "" for t in texts])]]

    return map_texts(docs, "text", [("ids", T.ArrayType(T.IntegerType()))], run)


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids decode to ""."""

    def run(ids: list[list[int] | None]) -> list:
        c = codec(path or public_tokenizer())
        return [[c.decode(x or []) for x in ids]]

    return map_texts(rows, "ids", [("text", T.StringType())], run)
