"""The corpus pipeline: documents in, packed bins out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``, extra
ones included whatever their names. An empty table runs through to an empty
result, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlark.llm import bestfit_pack, quality_rules, secret_scan, simhash_dedup
from fieldlark.llm.common import kept, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learnt from ``labels`` reject go.

    Null, empty and wordless texts, and all below fifty words, fail the base
    rule and go. Repeated rows and rows without a doc_id are judged like any
    other; without usable labels only the base rule holds.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays: the one of least doc_id.

    Texts are similar that share four fifths of their five-word shingles.

    Of rows that repeat that doc_id in the component one stays; unlike texts of
    one doc_id are documents of their own. Rows without a doc_id come last.
    Texts without a word form one component.
    """
    return simhash_dedup.drop_near_duplicates(docs, keep_unnamed=False)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced and n_chars follows; every row stays, clean ones as they are, null texts null."""
    return secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a long one, goes; a null or empty text is one piece of no words."""
    return bestfit_pack.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: Learned rules, fingerprints and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
