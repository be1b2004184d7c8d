"""Secret scans: keywords first, then patterns anchored at their hits, then checksums.

One Aho-Corasick automaton over the ASCII-lower-cased text finds every
keyword. A pattern is only tried where one of its keywords starts, from left to
right and never inside a match of its own kind. Kinds that carry a checksum or
an encoded header are kept only if that is right. Runs of hexadecimal digits
have no keyword: one search of the whole text finds them by their length.
Every search takes time in proportion to the text, whatever it repeats.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame, functions as F, types as T

from fieldlark.llm.common import map_texts, whole

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "forge", "registry", "webtoken", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry": ("npm_",),
    "webtoken": ("eyj",),
    "pem": ("-----begin ",),
}
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
REGISTRY = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
WEBTOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PART = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of ``body`` in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = DIGITS62[k] + out
    return out


def _body_checksum(m: re.Match) -> bool:
    token = m.group().partition("_")[2]
    return checksum62(token[:-6]) == token[-6:]


def _decoded(part: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    except (binascii.Error, ValueError):
        return None


def _token_header(m: re.Match) -> bool:
    try:
        head = json.loads(_decoded(m.group().partition(".")[0]) or b"")
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


def _key_body(m: re.Match) -> bool:
    """The body of a private key: base64 of an OpenSSH key, of DER of the length it states, or of enciphered blocks."""
    head, blank, rest = m.group(2).strip().replace("\r", "").partition("\n\n")
    if not blank or ":" not in head:
        head, rest = "", f"{head}\n{rest}"
    try:
        key = base64.b64decode("".join(rest.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if "ENCRYPTED" in head:
        return len(key) > 0 and len(key) % 8 == 0
    if key.startswith(b"openssh-key-v1\0"):
        return True
    if len(key) < 2 or key[0] != 0x30:
        return False
    more = key[1] - 128 if key[1] > 128 else 0
    size = int.from_bytes(key[2 : 2 + more], "big") if more else key[1]
    return len(key) == 2 + more + size


RULES = {
    "assign": (ASSIGN, lambda m: len(m.group(2)) >= LEAST["assign"]),
    "access": (ACCESS, lambda m: len(m.group()) >= LEAST["access"]),
    "forge": (FORGE, _body_checksum),
    "registry": (REGISTRY, _body_checksum),
    "webtoken": (WEBTOKEN, _token_header),
    "pem": (PEM, _key_body),
}

_automaton = None


def automaton():
    """Keyword automaton, one per Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                made.add_word(w, (kind, len(w)))
        made.make_automaton()
        _automaton = made
    return _automaton


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    if not text:
        return []
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    starts: dict[str, set[int]] = {}
    for last, (kind, size) in automaton().iter(lower):
        starts.setdefault(kind, set()).add(last - size + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, at in starts.items():
        pattern, good = RULES[kind]
        free = 0
        for s in sorted(at):
            if s < free:
                continue
            if m := pattern.match(text, s):
                free = m.end()
                if good(m):
                    found.append((s, free, kind))
            elif kind == "webtoken":  # its parts end where they end from any start within the first
                free = PART.match(text, s).end() if text.startswith("eyJ", s) else free
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e, _ in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


SCAN = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row per row of ``docs``.

    ``spans`` lists ``kind:start:end`` of all kinds, ``base_sha256`` is the
    digest of that list over the base kinds. A null or empty text has no span:
    zero counts, the digest of "", and "". Very long texts are scanned whole.
    Null and repeated doc_ids keep their rows; an empty table gives an empty
    result; extra columns are not read.
    """

    def run(texts: list[str | None]) -> list:
        rows = []
        for text in texts:
            spans = find_secrets(text)
            base = [x for x in spans if x[2] in LEAST]
            n = [sum(k == kind for *_, k in base) for kind in LEAST]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return list(map(list, zip(*rows))) or [[]] * len(SCAN)

    return map_texts(docs, "text", SCAN, run)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced and, where that changed it, ``n_chars`` counted anew; no row goes."""

    rows = whole(docs, "row").select("row", F.col("row.text").alias("own"))
    out = map_texts(rows, "own", [("text", T.StringType())], lambda texts: [list(map(redacted, texts))], ("row",))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        same = F.col("text").eqNullSafe(F.col("row.text"))
        columns["n_chars"] = F.when(same, columns["n_chars"]).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(c.alias(n) for n, c in columns.items()))
