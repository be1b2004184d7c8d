"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldlark.session import kept, shared_dir  # noqa: F401

#: Texts turned into Python strings at once.
ROWS = 1024
#: Text white space of every contract here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z lower-cased and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def majority(codes: np.ndarray) -> int:
    """The unsigned 64-bit number of the bits set in over half of ``codes`` (n x 8 bytes)."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(codes), 65536):
        counts += np.unpackbits(codes[k : k + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(codes)).tobytes(), "big")


def map_texts(docs: DataFrame, text: str, fields: list[tuple[str, T.DataType]], fn: Callable[[list[str | None]], list[list]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, *fields): ``fn`` makes the fields' columns from a batch of texts; keys pass through as they are."""
    names, types = [n for n, _ in fields], [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            made = fn(b.column(len(keys)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(made, types))], [*keys, *names])

    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(n, t) for n, t in fields)])
    return docs.select(*keys, text).mapInArrow(run, schema)


def column(name: str):
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its row as the one struct ``name``, so that no column of it can clash with another."""
    return df.select(F.struct(*(column(c).alias(c) for c in df.columns)).alias(name))
