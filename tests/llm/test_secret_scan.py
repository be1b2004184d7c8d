from __future__ import annotations

import base64
import hashlib
import re
import textwrap
import time

from hypothesis import given, settings, strategies as st

from fieldlark.llm import secret_scan as s

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out, key=lambda x: (x[0], s.KINDS.index(x[2])))


pieces = st.sampled_from(["password", "PassWD", "secret", "tokentoken", "api_key", "apikey", "API_Key", "AKIA", "AKIAAKIA", "=", ": ", '"', "'", " ", "\n", "abcdef", "0123456789abcdef" * 2, "A1B2" * 5, "é", "İ", "ſecret", "toKen", "Key", "😀", "x", "-", "/"])


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_base_spans_are_those_of_plain_search(text):
    assert [x for x in s.find_secrets(text) if x[2] in s.LEAST] == brute(text)


def test_checksummed_kinds():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + s.checksum62(body)
    assert (1, 41, "forge") in s.find_secrets(f"({good})")
    assert "forge" not in {k for *_, k in s.find_secrets(f"({good[:-1]}{'0' if good[-1] != '0' else '1'})")}
    assert ("npm_" + body + s.checksum62(body),) and "registry" in {k for *_, k in s.find_secrets("npm_" + body + s.checksum62(body))}
    assert "webtoken" in {k for *_, k in s.find_secrets("x eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln y")}
    assert "webtoken" not in {k for *_, k in s.find_secrets("x eyJxx.eyJzdWIiOiIxIn0.c2ln y")}


def test_redaction_merges_overlaps():
    assert s.redacted("a token = abcdef0123456789abcdef0123 b") == "a [secret] b"
    assert s.redacted("nothing here") == "nothing here"
    assert s.redacted(None) is None


def test_scan_cases(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdef"), (3, "token=abcdef"), (None, "x"), (5, "y " * 200_000 + "AKIA" + "A" * 16)]
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_hex")).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == empty and by[1]["spans"] == ""
    assert by[3]["n_assign"] == 1 and by[3]["base_sha256"] == hashlib.sha256(b"assign:0:12").hexdigest()
    assert by[5]["spans"] == "access:400000:400020"
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_redact_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "secret: abcdefg", "en", "s", 15), (2, "clean", "en", "s", None), (3, None, "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in s.redact(df).collect()}
    assert s.redact(df).columns == df.columns
    assert (got[1]["text"], got[1]["n_chars"]) == ("[secret]", 8)
    assert (got[2]["text"], got[2]["n_chars"]) == ("clean", None)
    assert (got[3]["text"], got[3]["n_chars"]) == (None, 7)


def der(n):
    """``n`` bytes as a DER sequence, in base64 lines."""
    raw = b"\x30\x82" + n.to_bytes(2, "big") + bytes(range(256)) * (n // 256) + bytes(n % 256)
    return "\n".join(textwrap.wrap(base64.b64encode(raw).decode(), 64))


def test_private_keys():
    pem = lambda body, kind="RSA PRIVATE KEY": f"x -----BEGIN {kind}-----\n{body}\n-----END {kind}----- y"
    found = lambda t: [x for x in s.find_secrets(t) if x[2] == "pem"]
    enciphered = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123456789ABCDEF\n\n" + base64.b64encode(b"x" * 64).decode()
    opened = base64.b64encode(b"openssh-key-v1\0" + b"k" * 40).decode()
    for body, kind in ((der(600), "RSA PRIVATE KEY"), (der(600).replace("\n", "\r\n"), "PRIVATE KEY"), (enciphered, "RSA PRIVATE KEY"), (opened, "OPENSSH PRIVATE KEY")):
        t = pem(body, kind)
        assert found(t) == [(2, len(t) - 2, "pem")]
        assert s.redacted(t) == "x [secret] y"
    cut = der(600).split("\n")
    for body in ("hello", "", "\n".join(cut[1:]), "\n".join(cut[:-1]), enciphered[:-3], "é" * 40):
        assert found(pem(body)) == []
    assert found(pem(der(600)).replace("END RSA", "END EC")) == []
    two = pem(der(300)) + pem("hello") + pem(der(300))
    assert len(found(two)) == 2


def test_time_grows_with_the_text():
    for part in ("eyJ", "eyJ.", "eyJa.eyJ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN ", "token", "token  ", "AKIA", "ghp_", "0123456789abcdef g "):
        began = time.process_time()
        s.find_secrets(part * (2_000_000 // len(part)))
        assert time.process_time() - began < 20, part
