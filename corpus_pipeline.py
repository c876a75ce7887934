"""The corpus pipeline: documents in, shards of a cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.  ``run`` writes each stage's rows under the shared
folder and reads them again for the next, so a lost executor never repeats an earlier stage.  Once they are written, the tables that the
stage made on the way and the rows of the stage before are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import decontam, mixing, nearcopies, sharding, simhash, toxicity
from rankspark.llm.queries import read
from rankspark.session import passing, pin, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 24
#: Documents that score at least this are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones among them, does not call toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles at least 0.8, directly or by steps) the document with the
    smallest id, of equal ids the one with the smallest row number; documents without an id stay.  Compared are documents that op4's
    fingerprints link and those that share a min-hash key."""
    own = pin(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    groups = nearcopies.near_copies(own.select("row", "text"), likely=simhash.linked_rows(own))
    named = groups.join(own.select("row", "doc_id"), "row").where("doc_id is not null")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    return own.join(first, "row", "left_semi").unionByName(own.where("doc_id is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), list(COLUMNS)).where("n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass in which the mix takes words of a document: its text if all are taken, else those taken."""
    taken = mixing.mixed_documents(docs, list(COLUMNS))
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; equal texts share a shard."""
    return sharding.shard_documents(docs, SHARDS, list(COLUMNS)).select(*COLUMNS, "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: A learned model and hashed fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with passing() as keep:
            docs = keep(pin(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        release(before)  # the given table was not pinned and stays
    return docs
