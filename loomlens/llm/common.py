"""What the operators of this subpackage share: session set-up, checkpoints, offsets, tokens."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes that separate words: all ASCII but digits and lower-case letters (texts are lower-cased first).
NOT_WORD = rb"\x00-\x2f\x3a-\x60\x7b-\x7f"


_BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Give the session a checkpoint folder if it has none, and let Python workers import this package.

    On a cluster ``spark.checkpoint.dir`` names the shared folder and is only read here; without it a temporary folder
    does for a master within one machine, and nothing else.
    """
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    if not sc.getConf().contains(_BYTES_A_BATCH):
        spark.conf.set(_BYTES_A_BATCH, "16MB")  # long texts: a batch is bounded by its bytes, not by its rows alone
    path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def spare(columns: list[str], name: str) -> str:
    """A column name that isn't taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes); a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"))


def pairs(batches: Iterator) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, text) of the rows of Arrow batches."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def part_id() -> int:
    return TaskContext.get().partitionId()


#: Rows of a few numbers that a file of scratch data holds, where there are so many.
ROWS_A_FILE = 200_000


def in_few_files(rows: DataFrame, most: int) -> DataFrame:
    """Checkpoint of rows of a few numbers, about ``most`` of them at most, in no more files than they need or cores can write.

    A local file system starts two processes a file to set its rights, and each reader has a task a file. It decides how many
    tasks there are, not what they do: with more rows than ROWS_A_FILE a file the files stay as they are dealt.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS_A_FILE))).checkpoint()


def bases(rows: DataFrame, keys: list[str], count: str, base: str = "base") -> DataFrame:
    """Second pass of a two-pass prefix sum: for each group of ``keys`` the total of ``count`` in all groups before it.

    The groups are partitions or blocks of a written table, so there is one row for megabytes of input.
    """
    totals = rows.groupBy(*keys).agg(F.sum(count).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias(base))


def crc(ids: np.ndarray) -> int:
    from zlib import crc32

    return crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def crc_bucket(doc_id, n: int):
    """crc32 of the decimal doc_id modulo n, as a column; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Keys that hold more than one row in SHARE are sent to all tasks: there are at most SHARE of them, whatever the data.
SHARE = 1000


def by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join of ``rows`` with ``keyed``, which has one row for each of its keys and says in ``count`` how many rows have it.

    A key of many rows isn't put into one task: such keys, at most SHARE of them, are broadcast and their rows stay where they
    are; only the others are shuffled. Both sides are read more than once and should be written or checkpointed before. Null
    keys meet nothing.
    """
    least = (keyed.agg(F.sum(count)).first()[0] or 0) // SHARE
    met = rows.join(F.broadcast(keyed.where(F.col(count) > least)), keys, "left")
    rest = met.where(F.col(count).isNull()).select(*rows.columns).join(keyed.where(F.col(count) <= least), keys, "left")
    return met.where(F.col(count).isNotNull()).unionByName(rest)


def without(text, chars: str):
    """A text with each of the ASCII characters given deleted, by searches of bytes: a good deal faster than a pattern or translate."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
