"""Tables that change: whole versions with an atomic pointer, and a cache keyed by content.

A version is written beside those there are, then claimed by creating its mark, which a file system does for one writer alone, and put in its
place; a reader takes the highest mark that has its version. A writer that was beaten starts again from the new version. One that fails before the mark leaves a draft that nobody
reads; should it fail between mark and place, which are two calls in a row, later writers report a conflict until the mark is deleted. Old versions stay readable until they are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as RD


class Conflict(RuntimeError):
    """Others wrote a version first, each time."""


class Versions:
    """A stored table; ``path`` lies in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self) -> list[int]:
        folder = self._at(f"{self.path}/_marks")
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(folder)) if self.files.exists(folder) else []

    def version(self) -> int:
        """The highest version, 0 if there is none."""
        return next((v for v in reversed(self._marks()) if self.files.exists(self._at(self.folder(v)))), 0)

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(version or self.version()))

    def _claim(self, version: int) -> bool:
        self.files.mkdirs(self._at(f"{self.path}/_marks"))
        return self.files.createNewFile(self._at(f"{self.path}/_marks/{version}"))

    def write(self, rows: DataFrame, version: int) -> bool:
        """Writes one version and claims it; False if another writer has it."""
        from uuid import uuid4

        draft = f"{self.path}/_draft-{uuid4().hex}"
        rows.write.parquet(draft)
        folder = self._at(self.folder(version))
        # The mark comes first: renaming onto a folder that is there would put one into the other.
        if not self._claim(version):
            self.files.delete(self._at(draft), True)
            return False
        if not self.files.rename(self._at(draft), folder):
            self.files.delete(self._at(f"{self.path}/_marks/{version}"), False)
            raise OSError(f"{draft} can't be moved")
        return True

    def change(self, step: Callable[[DataFrame], DataFrame], tries: int = 5) -> DataFrame:
        """A new version made from the latest; from a later one, if others write meanwhile."""
        for _ in range(tries):
            now = self.version()
            if self.write(step(self.read(now)), now + 1):
                return self.read(now + 1)
            time.sleep(0.1)  # the other writer is about to put its version in place
        raise Conflict(self.path)

    def drop_before(self, version: int) -> None:
        """Old versions go, marks first; the latest stays."""
        for v in self._marks():
            if v < min(version, self.version()):
                self.files.delete(self._at(f"{self.path}/_marks/{v}"), False)
                self.files.delete(self._at(self.folder(v)), True)


class Runs(Versions):
    """Runs (run_id, status, published, updated, ...) and what is done to them."""

    def publish(self, run_id, on: bool = True) -> DataFrame:
        return self.change(lambda r: RD.published(r, F.col("run_id") == run_id, on))

    def publish_all(self) -> DataFrame:
        """Every completed run."""
        return self.change(lambda r: RD.published(r, F.lit(True)))

    def delete(self, run_id) -> DataFrame:
        return self.change(lambda r: RD.without(r, F.col("run_id") == run_id))

    def cancel(self, run_id) -> DataFrame:
        """A run that is queued or processing fails; any other stays as it is."""
        open_ = (F.col("run_id") == run_id) & F.col("status").isin("queued", "processing")
        return self.change(lambda r: r.withColumn("status", F.when(open_, "failed").otherwise(F.col("status"))))

    def sweep(self, older_than: str) -> DataFrame:
        return self.change(lambda r: RD.swept(r, older_than))

    def merge(self, fresh: DataFrame, replace: bool = False) -> DataFrame:
        """Runs that aren't there are added; those that are stay, or are replaced. Of fresh runs with one id the latest counts."""
        last = fresh.groupBy("run_id").agg(F.max_by(F.struct(*fresh.columns), "updated").alias("x")).select("x.*")

        def step(rows: DataFrame) -> DataFrame:
            kept, added = (rows.join(last, "run_id", "left_anti"), last) if replace else (rows, last.join(rows, "run_id", "left_anti"))
            return kept.unionByName(added.select(*rows.columns))

        return self.change(step)


def cache_key(text: Column, model: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of text and model."""
    return F.left(F.sha2(F.concat_ws(":", F.coalesce(text, F.lit("")), model).cast("binary"), 256), F.lit(32))


class Cache:
    """Results by content, such as embeddings of texts or the recognized text of files: (key, model, value, at).

    A put writes its own folder, named after the batch, and replaces it if the put is run again; a retried task's files are those of the
    committed attempt alone. So a batch counts once however often it is tried, and nothing is rewritten. Of a key put by several batches the newest counts.
    """

    def __init__(self, spark: SparkSession, path: str, value: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, model string, value {value}, at timestamp, batch string"

    def rows(self) -> DataFrame:
        """One row a key."""
        try:
            stored = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = self.spark.createDataFrame([], self.schema)
        return stored.groupBy("key").agg(F.max_by(F.struct("model", "value", "at", "batch"), F.struct("at", "batch")).alias("x")).select("key", "x.*")

    def get(self, requests: DataFrame, text: str, model: Column) -> DataFrame:
        """``requests`` with key and value; null is a miss. Each different text is looked up once."""
        wanted = requests.withColumn("key", cache_key(F.col(text), model))
        found = wanted.select("key").distinct().join(self.rows().select("key", "value"), "key")
        return wanted.join(found, "key", "left")

    def misses(self, requests: DataFrame, text: str, model: Column) -> DataFrame:
        """(key, text) of what has to be computed, once each."""
        wanted = requests.groupBy(cache_key(F.col(text), model).alias("key")).agg(F.first(text).alias(text))
        return wanted.join(self.rows().select("key"), "key", "left_anti")

    def put(self, found: DataFrame, batch: str, model: Column, at: Column) -> None:
        """Keeps (key, value) of a batch; keys that are there already are left out."""
        if not batch.replace("-", "").isalnum():
            raise ValueError("a batch is named by letters, digits and hyphens")
        others = self.rows().where(F.col("batch") != batch).select("key")
        fresh = found.dropDuplicates(["key"]).join(others, "key", "left_anti")
        fresh.select("key", model.alias("model"), "value", at.cast("timestamp").alias("at")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def stats(self) -> DataFrame:
        """Entries, the oldest and the newest by model."""
        return self.rows().groupBy("model").agg(F.count("*").alias("entries"), F.min("at").alias("oldest"), F.max("at").alias("newest"))

    def aged(self, before: Column) -> DataFrame:
        """What is left when entries older than a time are cleared."""
        return self.rows().where(F.col("at") >= before)

    def clear(self, before: Column, into: str) -> Cache:
        """A cache at another path that holds what isn't older than a time; this one stays as it is for those who still read it."""
        other = Cache(self.spark, into, self.schema.split("value ")[1].split(", at timestamp")[0])
        self.aged(before).select("key", "model", "value", "at").write.mode("overwrite").parquet(f"{other.path}/batch=kept")
        return other


def merged_pages(pages: DataFrame, by: str, least: int = 30, most_pages: int = 150) -> DataFrame:
    """(by, text, page_count, ocr_pages, ocr_truncated) of pages (by, page_number, embedded, recognized): a page's own text if it has ``least`` characters, else what was recognized, if anything was.

    ``most_pages`` is the feature's limit on pages that are recognized; documents beyond it are marked.
    """
    own = F.coalesce(F.col("embedded"), F.lit(""))
    poor = F.length(F.regexp_replace(own, r"^\s+|\s+$", "")) < least
    text = F.when(poor, F.coalesce("recognized", own)).otherwise(own)
    rows = pages.select(by, "page_number", text.alias("t"), (poor & F.col("recognized").isNotNull()).alias("o"))
    whole = rows.groupBy(by).agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(F.when(F.col("page_number") <= most_pages, F.struct("page_number", "t", "o")))).alias("p"))
    return whole.select(by, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"), "page_count", F.size(F.filter("p", lambda x: x["o"])).alias("ocr_pages"), (F.col("page_count") > most_pages).alias("ocr_truncated"))
