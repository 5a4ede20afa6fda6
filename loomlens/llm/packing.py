"""Packing: concatenate and cut.

Pass 1 turns each document into ids and adds them up within its partition; the table is written to
the shared checkpoint folder. Pass 2 sums the partitions' totals, which gives each document its place
in the concatenation of all ids, and cuts that at every multiple of the sequence length. A document
that crosses a cut has one boundary record on either side. Only the last sequence needs padding.

Nulls: a null text is an empty document (one id, the end); a null doc_id is carried as it is. Repeated
rows are packed as often as they stand there. An empty table gives no pieces. Very long texts are taken whole. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The tokenizer, the id that ends a document and the sequence length.
TOKENIZER, END, LENGTH = "byte_bpe_50k.json", 1, 2048

_TOKENS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SQL = {pa.int64(): "long", pa.binary(): "binary"}
MOST_ROWS, MOST_BYTES = 2000, 16 << 20


def sql_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL.get(f.type, 'double')}" for f in schema)


def batches_of(rows, schema: pa.Schema, weigh=lambda row: 64):
    """Arrow batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= MOST_ROWS * 8 or weight >= MOST_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Pass 1: (part, doc_id, local start, n, ids as bytes), checkpointed, so that later passes see the same order."""

    def encode(batches):
        from .tokens import byte_level

        ids_of, part = byte_level(tokenizer), C.part_id()

        def rows():
            local = 0
            for doc_id, text in C.pairs(batches):
                ids = np.append(ids_of(text), np.uint32(end))
                held = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                yield part, doc_id, local, len(ids), bytes([held.itemsize]) + held.tobytes()
                local += len(ids)

        yield from batches_of(rows(), _TOKENS, lambda r: len(r[4]) + 64)

    return C.text_bytes(docs).mapInArrow(encode, sql_schema(_TOKENS)).checkpoint()


def ids_in(held: bytes) -> np.ndarray:
    return np.frombuffer(held, dtype=f"<u{held[0]}", offset=1)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds its ids (array of int), the packed output itself."""
    C.prepare(docs.sparkSession)
    tokens = tokenized(docs, tokenizer, end)
    placed = tokens.join(F.broadcast(C.bases(tokens, ["part"], "n")), "part").select("doc_id", (F.col("base") + F.col("local")).alias("at"), "ids")
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def cut(batches):
        def rows():
            for b in batches:
                for doc_id, at, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids, start = ids_in(held), 0
                    while start < len(ids):
                        sequence, offset = divmod(at + start, length)
                        piece = ids[start : start + length - offset]
                        yield (doc_id, start, len(piece), C.crc(piece), len(ids), sequence, offset, *([piece.astype(np.int32)] if with_ids else []))
                        start += len(piece)

        yield from batches_of(rows(), schema, lambda r: 64 + 4 * r[2] * with_ids)

    return placed.mapInArrow(cut, sql_schema(_PIECES) + ", ids array<int>" * with_ids)
