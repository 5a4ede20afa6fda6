"""Token-id files: Elias-Fano document boundaries over a concatenated array of ids.

A file is a run of blocks. A block holds the ids of consecutive documents as one array and, in place
of a table of 64-bit offsets, the documents' ends as an Elias-Fano sequence: the low bits of each end
packed together, the high bits in unary, and a sample of where every 64th one-bit stands. select(i)
starts from a sample and gives a document's borders without decoding the rest. The doc_ids, which
ascend, are held in the same way. Blocks are self-contained byte strings; Spark's Parquet writer puts
them into the shared folder, so that a lost executor's output is written again and committed once,
and ``export`` saves them as plain files.

Nulls: a null text is an empty document (one id, the end). Rows with a null doc_id come first. Equal
doc_ids stand in the order of their texts. An empty table gives no block and no row. Very long texts are taken whole. Columns other than doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .packing import batches_of, sql_schema

#: The tokenizer and the id that ends a document.
TOKENIZER, END = "word_bpe_49k.json", 2
#: A block is closed when it has this many ids (a longer document has a block of its own).
BLOCK_IDS = 1 << 19
SAMPLE = 64
MAGIC = b"EFID1\0"

_BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class EliasFano:
    """A non-descending sequence of numbers of at least 0, in about 2 + log2(last / count) bits each."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number, read from the nearest sample on."""
        at, ahead = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left = int(self.high[byte]) >> (at & 7) << (at & 7)
        while ahead >= (k := left.bit_count()):
            ahead -= k
            byte += 1
            left = int(self.high[byte])
        for _ in range(ahead):
            left &= left - 1
        one = (byte << 3) + (left & -left).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return (one - i << self.low_bits) | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        lows = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.count) << self.low_bits) + (lows << np.arange(self.low_bits)).sum(axis=1)

    def dump(self) -> bytes:
        return struct.pack("<IBIII", self.count, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        count, low_bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += struct.calcsize("<IBIII")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(count, low_bits, low, high, samples), at + a + b + 4 * c


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a block. Null doc_ids stand before the others, which ascend."""
    known = [x for x in doc_ids if x is not None]
    first = known[0] if known else 0
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = MAGIC + struct.pack("<BIqQ", width, len(doc_ids) - len(known), first, len(ids))
    gaps = np.array([x - first for x in known], dtype=np.uint64)
    return head + EliasFano.of(gaps).dump() + EliasFano.of(np.cumsum(lengths)).dump() + ids.astype(f"<u{width}").tobytes()


class Block:
    """Random access to a block's documents."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of token ids")
        width, self.nulls, self.first, n = struct.unpack_from("<BIqQ", data, len(MAGIC))
        self.names, at = EliasFano.load(data, len(MAGIC) + struct.calcsize("<BIqQ"))
        self.ends, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", n, at)

    def __len__(self) -> int:
        return self.ends.count

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.names.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def blocks(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(part, block, n_docs, n_ids, data): documents in ascending doc_id order over the partitions and blocks."""

    def encode(batches):
        from .tokens import word_level

        ids_of, part = word_level(tokenizer), C.part_id()

        def rows():
            names, lengths, parts, size, block = [], [], [], 0, 0
            for doc_id, text in C.pairs(batches):
                ids = np.append(ids_of(text), np.uint32(end))
                if names and size + len(ids) > block_ids:
                    yield part, block, len(names), size, write_block(names, lengths, np.concatenate(parts))
                    names, lengths, parts, size, block = [], [], [], 0, block + 1
                names.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                size += len(ids)
            if names:
                yield part, block, len(names), size, write_block(names, lengths, np.concatenate(parts))

        yield from batches_of(rows(), _BLOCKS, lambda r: len(r[4]))

    # The texts stay out of the range's sample, which goes to the driver.
    return C.text_bytes(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, sql_schema(_BLOCKS))


def write(docs: DataFrame, path: str, **how) -> str:
    """Write the files below ``path``, a folder that all executors share; gives the path."""
    C.prepare(docs.sparkSession)
    blocks(docs, **how).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens and ids_crc32, by way of select."""
    held = spark.read.parquet(path)
    base = C.bases(held.select("part", "block", "n_ids"), ["part", "block"], "n_ids")

    def decode(batches):
        def rows():
            for b in batches:
                for data, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    block = Block(data)
                    a = 0
                    for i in range(len(block)):
                        z = block.ends.select(i)
                        yield block.doc_id(i), at + a, z - a, C.crc(block.ids[a:z])
                        a = z

        yield from batches_of(rows(), _DOCS)

    return held.join(F.broadcast(base), ["part", "block"]).select("data", "base").mapInArrow(decode, sql_schema(_DOCS))


def export(spark, path: str, folder: str) -> int:
    """Save every block as a plain file in a folder that the driver sees, one at a time; gives how many."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for n, row in enumerate(spark.read.parquet(path).orderBy("part", "block").toLocalIterator(), 1):
        with open(f"{folder}/{row['part']:06d}-{row['block']:06d}.efid", "wb") as f:
            f.write(row["data"])
    return n


def shared_path(spark, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    C.prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, shared_path(spark, "id-files")))
