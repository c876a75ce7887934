"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A change has the state of a document's count before and after it: an insert has no before, a delete no after, a revision both.
Each state gives one signed row (-1 before, +1 after), so a revised count, source or language needs no other case.  A batch of
changes is summed to one row per group and written under its id; then its commit is written.  Totals are sums over committed batches only:
a batch that failed half-way does not count, one that is sent again under the same id is written over if it was not
committed and left alone if it was.  No document is read again when totals change.

One writer at a time is assumed.  ``compact`` folds what is committed into one batch.

Defined cases: null source, language and version are groups of their own; null or empty texts have 0 tokens but count as documents; a change with neither
state, or one that repeats within a batch, is summed like any other; empty batches commit; groups whose documents and tokens are all gone
leave the totals; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.texts import add_columns, words

GROUP = ("source", "lang", "version")
_STATE = "struct<source:string,lang:string,version:string,tokens:bigint>"
_DELTA = "source string, lang string, version string, documents bigint, tokens bigint, batch string"

#: Fixed value: how the byte-pair vocabulary splits a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def state(source: str = "source", lang: str = "lang", version: str = "version", tokens: str = "tokens"):
    """The columns of a count as one state of a change."""
    return F.struct(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                    F.col(version).cast("string").alias("version"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(None).cast(_STATE).alias("before"), state().alias("after"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(state().alias("before"), F.lit(None).cast(_STATE).alias("after"))


def revisions(counts: DataFrame, revised: str = "revised") -> DataFrame:
    """Changes of the column tokens to the column ``revised``."""
    return counts.select(state().alias("before"), state(tokens=revised).alias("after"))


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch's signed rows per group."""
    each = changes.select(F.inline(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")))))
    return (each.where("s is not null").groupBy(*[F.col(f"s.{g}").alias(g) for g in GROUP])
            .agg(F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.col("s.tokens")).alias("tokens")))


class Rollup:
    """The totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str, batch: str):
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def committed(self) -> list[str]:
        """Ids of committed batches: one short row each."""
        try:
            rows = self.spark.read.schema("at timestamp, batch string").parquet(f"{self.path}/commits").select("batch").distinct().collect()
        except Exception as error:  # nothing has been committed yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        return sorted(r["batch"] for r in rows)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False if this id was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if batch in self.committed():
            return False
        self._write(signed(changes), "deltas", batch)
        self._write(self.spark.range(1).select(F.current_timestamp().alias("at")), "commits", batch)
        return True

    def totals(self) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], _DELTA).drop("batch")
        deltas = self.spark.read.schema(_DELTA).option("basePath", f"{self.path}/deltas").parquet(*[f"{self.path}/deltas/batch={b}" for b in done])
        return (deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .where("documents <> 0 or tokens <> 0"))

    def compact(self, batch: str) -> "Rollup":
        """The totals as one committed batch in a new folder; batch ids seen before are kept as committed."""
        folded = Rollup(self.spark, f"{self.path}/compact-{batch}")
        folded._write(self.totals(), "deltas", batch)
        for b in self.committed():
            folded._write(self.totals().limit(0), "deltas", b)
            folded._write(self.spark.range(1).select(F.current_timestamp().alias("at")), "commits", b)
        folded._write(self.spark.range(1).select(F.current_timestamp().alias("at")), "commits", batch)
        return folded


def byte_pair_counts(df: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """``df`` with the number of byte-pair tokens of each whole text.  The vocabulary file (one rank a line) is read by the driver and sent along."""
    with open(vocabulary, "rb") as f:
        table = f.read()

    def make():
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
        encoding = tiktoken.Encoding("vocabulary", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: ([len(encoding.encode_ordinary(t)) if t else 0 for t in texts],)
    return add_columns(df, {name: "long"}, [text], make)


def word_counts(df: DataFrame, text: str = "text", name: str = "tokens") -> DataFrame:
    def make():
        return lambda texts: ([len(words(t)) for t in texts],)
    return add_columns(df, {name: "long"}, [text], make)
