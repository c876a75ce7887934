"""Session settings and the shared scratch folder.

Every operator takes its session from the DataFrame it is given.  ``tune``
switches on the runtime settings the operators count on; ``pin`` cuts lineage by
writing a table under the shared folder named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed lookup join even where that costs one more exchange later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffle files go when their query ends; otherwise those of every epoch and round stay until the driver collects garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

CHECKPOINT_KEY = "spark.checkpoint.dir"

_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a local temp folder only on local masters."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write ``df`` once and read it back: survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_path = path
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def release(df: DataFrame) -> None:
    """Remove the table that ``pin`` wrote for ``df``; nothing may read it later.  Other frames are left alone."""
    path = getattr(df, "pinned_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at the end, also after an error, what ``pin`` wrote inside, but for the tables given to the function it yields.

    Nothing that is read later may depend on a removed table.  Tables written by other threads are left alone.
    """
    own, kept = [], []
    token = _written.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.pinned_path)
        return df
    try:
        yield keep
    finally:
        _written.reset(token)
        outer = _written.get()
        for df in own:
            if df.pinned_path not in kept:
                release(df)
            elif outer is not None:
                outer.append(df)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when a small input arrives in fewer partitions than there are cores.

    Large inputs have more partitions than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
