"""The registered queries: contract columns and types, whole tables, and SQL where there is some."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldlark.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CONTRACT = {
    "op1_quality_rules": ("documents", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
    "op2_secret_scans": ("documents", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
    "op4_exact_top_k": (None, "query_id bigint, rank int, vec_id bigint, score bigint"),
    "op5_url_filter": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op6_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op7_sentencepiece": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op8_html_extraction": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op9_simhash_near_dedup": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    table, columns = CONTRACT[name]
    out = llm.QUERIES[name](spark, SF)
    have = dict(out.dtypes)
    for c in columns.split(", "):
        col, kind = c.split(" ")
        assert have[col] == kind
    if table:
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_one_query_an_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_top_k_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in llm.QUERIES["op4_exact_top_k"](spark, SF).collect())
    assert got == sorted(con.sql(llm.ORACLES["op4_exact_top_k"]).fetchall())
