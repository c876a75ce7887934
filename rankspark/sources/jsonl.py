"""Append-only JSON logs: tolerant reading, repair, flattening, appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = "split string, timestamp string, epoch double, pid int, stack array<string>"

NODE_SCHEMA = """iter int, id string, parent_id string, operation string, status string, evidence_type string,
code_dir string, hypothesis struct<mechanism: string, success_criterion_paired: string, implementation_sketch: string>,
diagnosis struct<bottleneck: string, evidence: string, confidence: double, component: string>,
per_seed_primary map<string, double>, per_seed_gauc map<string, double>, per_seed_ndcg5 map<string, double>,
mean_delta double, p_positive double, lower_95 double, fix_attempts int, wallclock_used_s double,
per_user_by_seed map<string, map<string, double>>, seeds_run array<int>, local_best_score double, n_visits int,
confirm_primary double"""

PROGRESS_SCHEMA = """updated_at double, metric string, baseline_primary double, iters_completed int, global_best double,
iterations array<struct<iter: int, elapsed_s: double, running_best: double, candidates: array<struct<
id: string, primary: double, gauc: double, ndcg5: double, n_seeds: int, mean_delta: double, p_positive: double,
lower_95: double, confirm_primary: double, status: string, evidence_type: string>>>>"""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def parse_lines(lines: DataFrame, schema: str | T.StructType, column: str = "value") -> DataFrame:
    """Parse one JSON object per line; blank, torn and non-object lines are dropped."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    body = F.trim(F.col(column))
    whole = F.try_parse_json(column).isNotNull()
    kept = lines.where(body.startswith("{") & whole)
    return kept.select(*[c for c in lines.columns if c != column], F.from_json(column, ddl).alias("_j")).select(
        *[c for c in lines.columns if c != column], "_j.*")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Tolerant JSONL reader; a missing file is an empty log."""
    if not _exists(spark, path):
        parsed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return spark.createDataFrame([], parsed)
    return parse_lines(spark.read.text(path), schema)


def recover_glued(lines: DataFrame, schema: str, marker: str = '{"iter":', column: str = "value") -> DataFrame:
    """Split lines that hold several glued objects at each marker.

    Adds ``ok`` (the piece parsed) so callers can count the skipped pieces; text after the
    object's closing brace, such as a literal newline escape, is cut off.
    """
    starts = F.split(F.col(column), f"(?={_quoted(marker)})")
    pieces = lines.select(*[c for c in lines.columns if c != column], F.posexplode(starts).alias("piece", "_t"))
    pieces = pieces.where(F.trim("_t") != "")
    body = F.regexp_extract("_t", r"(?s)^\s*(\{.*\})", 1)
    parsed = pieces.withColumn("_body", body).withColumn(
        "ok", F.try_parse_json("_body").isNotNull() & (F.col("_body") != ""))
    return parsed.withColumn("_j", F.from_json("_body", schema)).select(
        *[c for c in lines.columns if c != column], "piece", "ok", "_j.*")


def _quoted(marker: str) -> str:
    return "".join("\\" + c if c in r"\{}[]()^$.|?*+" else c for c in marker)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per progress document."""
    return spark.read.schema(PROGRESS_SCHEMA).option("multiLine", True).json(path)


def flatten_progress(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents -> iterations -> candidates; iterations without candidates keep one row."""
    its = docs.select(*keys, F.explode("iterations").alias("it"))
    return its.select(*keys, F.col("it.iter").alias("iter"), F.col("it.elapsed_s").alias("elapsed_s"),
                      F.explode_outer("it.candidates").alias("c")).select(*keys, "iter", "elapsed_s", "c.*")


def append_audit(df: DataFrame, path: str) -> bool:
    """Append access records; a failed write is reported, not raised."""
    try:
        df.write.mode("append").json(path)
        return True
    except Exception as exc:  # the access was already granted
        import logging
        logging.getLogger("rankspark.audit").warning("audit entries not written to %s: %s", path, exc)
        return False


def append_nodes(df: DataFrame, path: str) -> None:
    """Append experiment rows, one folder per iteration."""
    df.write.mode("append").partitionBy("iter").json(path)
