from __future__ import annotations

import hashlib
import os

import pytest
from hypothesis import given, settings, strategies as st

from fieldlark.llm import sentencepiece_codec as c

pytest.importorskip("public_tokenizers")
CODEC = c.Codec(c.public_tokenizer())
texts = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "▁", "the", "thing", "und", "é", "漢字", "😀", "​", "　", "\x00", "<0x41>", "</s>", "<unk>", "².", "²", "12", "3.5", "___", "a" * 60, "&&&", "İ", "é", "\r\n"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_as_the_library(text):
    ids = CODEC.library.encode(text, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == CODEC.library.decode(ids)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.library.encode(text, add_eos=True)
    assert CODEC.encode(text) == ids and CODEC.decode(ids) == CODEC.library.decode(ids)


def test_both_agendas_agree():
    for word in (" thenationalization", "a" * 40, " internationalisation", "qwertzuiop"):
        sym = list(word.replace(" ", c.SPACE))
        assert CODEC._short(list(sym)) == CODEC._long(list(sym))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(c, "REMEMBERED", 20)
    codec = c.Codec(c.public_tokenizer())
    for i in range(50):
        assert codec.encode(f"word{i} other{i}") == codec.library.encode(f"word{i} other{i}", add_eos=True)
        assert len(codec.known) + len(codec.older) < 60


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello  world\n▁x"), (3, "Hello  world\n▁x"), (None, "y"), (6, "lo ng\n" * 60_000 + "a" * 3000)]
    got = c.digest_rows(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows:
        ids = CODEC.library.encode(t or "", add_eos=True)
        assert (by[i]["n_tokens"], by[i]["ids_sha256"], by[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(CODEC.library.decode(ids)))
    assert c.digest_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "a b\nc"), (2, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in c.decode_documents(c.encode_documents(df)).collect()}
    assert back == {1: "a b\nc", 2: ""}
    assert os.path.exists(c.public_tokenizer())


def test_decoding_reads_the_ids():
    """The decoded text is made from ids, not from what was encoded; ids that no text has are the library's."""
    ids = CODEC.encode("some text")
    other = CODEC.encode("another")
    assert CODEC.decode(ids[:-1] + other) == CODEC.library.decode(ids[:-1] + other)
    odd = [CODEC.byte_id[0xC3], CODEC.byte_id[0x41], CODEC.library.unk_id()]
    assert CODEC.decode(odd) == CODEC.library.decode(odd)
    wrong = c.Codec(c.public_tokenizer())
    wrong.raw[ids[0]] = b"x"
    with pytest.raises(ValueError):
        wrong.decode(ids)
