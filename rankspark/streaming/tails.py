"""Structured Streaming over append-only JSON logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankspark.session import scratch_path
from rankspark.sources.jsonl import AUDIT_SCHEMA, parse_lines


def tail_jsonl(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream of the whole lines of a log folder; torn lines are skipped."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_lines(reader.text(path), schema)


def access_counts(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, split: str = "split", **kw) -> DataFrame:
    """Running number of accesses per split (complete mode)."""
    return tail_jsonl(spark, path, schema, **kw).groupBy(split).agg(F.count(F.lit(1)).alias("accesses"))


def latest_state(stream: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Last row per key by ``at``; the state keeps one row per key (complete or update mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(at, *columns), at).alias("_row")).select(key, "_row.*")


def upsert(stream: DataFrame, keys: Sequence[str], label: str, compact_every: int = 10) -> "KeyedTable":
    """Run a stream in update mode into a keyed table: a batch appends the keys it changed, not the whole state.

    Every ``compact_every`` batches the rows written so far are folded to the newest per key in one new base folder, so
    reading stays in proportion to keys, and what a batch writes to what it changed.  A batch that runs again replaces its own folders.
    """
    spark = stream.sparkSession
    table = KeyedTable(spark, scratch_path(spark, label), tuple(keys), stream.schema)
    state = scratch_path(spark, f"{label}_state")

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table.path}/delta/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            table.compact(epoch)

    query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("update").foreachBatch(store).start()
    query.awaitTermination()
    return table


@dataclass(frozen=True)
class KeyedTable:
    """Changed rows by batch under ``delta``, folded rows under ``base``; the row of the latest batch counts for its key."""
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: StructType

    def _epochs(self, kind: str) -> list[int]:
        """Numbers of the complete folders: a handful of names, as folding keeps them few."""
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        found = fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(folder, "epoch=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("epoch=")) for f in found)

    def read(self) -> DataFrame:
        """Newest row per key."""
        return self._newest(self._epochs("base"), self._epochs("delta"))

    def _newest(self, bases: list[int], deltas: list[int]) -> DataFrame:
        after = bases[-1] if bases else -1
        names = [("base", e) for e in bases[-1:]] + [("delta", e) for e in deltas if e > after]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/epoch={e}").withColumn("_epoch", F.lit(e))
                                              for kind, e in names])
        values = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_epoch").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self.schema.names)

    def compact(self, epoch: int) -> None:
        """Fold all batches up to ``epoch`` into a base.

        The base before it and the batches since then stay until the next fold, for readers that started on them and for
        a batch that runs again.
        """
        old = [e for e in self._epochs("base") if e < epoch]
        deltas = [e for e in self._epochs("delta") if e <= epoch]
        self._newest(old, deltas).write.mode("overwrite").parquet(f"{self.path}/base/epoch={epoch}")
        done = [("base", e) for e in old[:-1]] + [("delta", e) for e in deltas if old and e <= old[-1]]
        sc = self.spark.sparkContext
        for kind, e in done:
            folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/epoch={e}")
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB instead of on the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def first_seen(stream: DataFrame, text: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Drop texts already seen in this run (append mode).

    State grows with the number of distinct texts; give ``event_time`` and ``within`` to bound it to
    copies that arrive within that time of each other.  Rows older than the watermark when they arrive are dropped,
    be they copies or not; of copies in one batch an arbitrary one stays.
    """
    hashed = stream.withColumn("text_hash", F.sha1(text))
    if event_time and within:
        return hashed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["text_hash"])
    return hashed.dropDuplicates(["text_hash"])


def drain(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over everything available into a table in the shared folder and read it.

    ``append`` writes each row once; ``complete`` keeps one folder per micro-batch and
    reads the newest, so a restarted batch replaces its own folder.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}_state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        def replace(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    table = spark.read.parquet(out)
    newest = table.agg(F.max("epoch").alias("e")).first()["e"]
    return table.where(F.col("epoch") == newest).drop("epoch")
