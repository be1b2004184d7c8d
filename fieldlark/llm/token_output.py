"""Packed token rows as binary output.

Tasks read their part of the table once and pack it as it streams by: the
documents of a bounded window are tokenised, cut losslessly where they exceed
a row, and placed by best-fit decreasing. A segment tree over room left finds
the fullest open row that still takes a piece. No row moves between tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldlark.llm.common import ROWS

ROW = 2048
#: Tokens of a window, above which its documents are packed and sent out.
WINDOW = 1 << 21

SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_starts", T.ArrayType(T.LongType())),
    ]
)


class RoomTree:
    """Open rows by room left; finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room >= need, taken out."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], row: int = ROW) -> list[int]:
    """The row of each piece (sizes 1 to ``row``), rows numbered from 0."""
    tree, out, n = RoomTree(row), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        room, at = found if found else (row, n)
        n += found is None
        out[i] = at
        if room > sizes[i]:
            tree.put(room - sizes[i], at)
    return out


def pack_window(docs: list[tuple[int | None, np.ndarray]], row: int, pad: int) -> list[tuple]:
    """Packed rows of (doc_id, ids): n_tokens, ids as bytes, lengths so far, resets, documents, their first token."""
    pieces = [(d, k, ids[k : k + row]) for d, ids in docs for k in range(0, len(ids), row)]
    rows: dict[int, list[int]] = {}
    for i, r in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], row)):
        rows.setdefault(r, []).append(i)
    out = []
    for r in sorted(rows):
        own = [pieces[i] for i in rows[r]]
        ends = np.cumsum([len(p[2]) for p in own])
        flat = np.full(row, pad, own[0][2].dtype)
        flat[: ends[-1]] = np.concatenate([p[2] for p in own])
        ends = ends.tolist()
        out.append((ends[-1], flat.tobytes(), [0, *ends], [0, *ends[:-1]], [p[0] for p in own], [p[1] for p in own]))
    return out


class Tokenizer:
    """A byte-level vocabulary; ``end`` closes every document."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        return np.array([*self.inner.encode_ordinary(text), self.end], self.dtype)

    def text(self, ids: np.ndarray) -> str:
        return self.inner.decode([int(i) for i in ids if i != self.end])


_tokenizers: dict[str | None, Tokenizer] = {}


def tokenizer(path: str | None = None) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def packed_rows(docs: DataFrame, path: str | None = None, row: int = ROW, window: int = WINDOW) -> DataFrame:
    """Rows of the packed id matrix (``SCHEMA``) over ``docs`` (doc_id, text).

    ``ids`` holds ``row`` little-endian ids, unused places filled with the end
    id; the first ``n_tokens`` count. ``cu_seqlens`` are the segments' lengths
    so far from 0; positions restart at ``position_resets``. A segment is the
    part of document ``doc_ids[k]`` from its token ``doc_starts[k]`` on.

    Every document ends with the end id, so a null or empty text is one token.
    Documents over a row are cut into whole rows and a rest. Null doc_ids and
    repeated rows keep their segments. Of pieces of equal length the earlier in
    the window is placed first; of equally full rows the one filled last takes
    it. An empty table gives no row. Extra columns are not read. ``part`` and ``row`` name a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, n = tokenizer(path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            rows = pack_window(held, row, tok.end)
            columns = [[part] * len(rows), range(n, n + len(rows)), *map(list, zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SCHEMA.names)

        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((d, tok.ids(t or "")))
                size += len(held[-1][1])
                if size >= window:
                    out = packed()
                    yield out
                    n, held, size = n + out.num_rows, [], 0
        if held:
            yield packed()

    types = [to_arrow_type(f.dataType) for f in SCHEMA.fields]
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, out: str, path: str | None = None, row: int = ROW) -> None:
    """``packed_rows`` written as Parquet, binary rows as they are."""
    packed_rows(docs, path, row).write.mode("overwrite").parquet(out)


def id_matrix(rows: pd.DataFrame, dtype: str = "<u2") -> np.ndarray:
    """The id matrix of some collected rows."""
    return np.stack([np.frombuffer(x, dtype) for x in rows["ids"]])
