"""Folders of small files read whole: one digest per folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, content) of all files below ``path``; ``folder`` is the address of the file's folder.

    Spark's reader passes over empty files, so they count as absent, unlike in a digest that opens each named file.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    cut = lambda part: F.regexp_extract("path", "^(.*)/([^/]*)$", part)
    return raw.select(cut(1).alias("folder"), cut(2).alias("name"), "content")


def set_digest(files: DataFrame, names: Sequence[str], by: str = "folder") -> DataFrame:
    """sha256 over the named files of each folder: for each that exists, in the order named, its name and its bytes.

    Other files do not count; a folder with none of them has the digest of nothing.  A group holds at most
    ``len(names)`` files, so its bytes meet in one row.  Of a name that a folder has twice, all copies count, least content first.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    both: Column = F.concat(F.col("name").cast("binary"), F.coalesce("content", F.lit(b"")))
    kept = F.sort_array(F.collect_list(F.when(place > 0, F.struct(place.alias("at"), both.alias("body")))))
    whole = F.aggregate(kept, F.lit(b""), lambda a, p: F.concat(a, p["body"]))
    return files.groupBy(by).agg(F.sha2(whole, 256).alias("sha256"), F.count_if(place > 0).alias("files"))
