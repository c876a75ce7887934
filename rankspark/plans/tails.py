"""Registered streaming and append-sink queries over logs written from the events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.session import scratch_path
from rankspark.sources import jsonl as J
from rankspark.sources import tables as T
from rankspark.streaming import tails

_EVENT = "split string, event_id bigint, user_id bigint, value double"


def _event_log(spark, sf_dir):
    """Events as a JSONL log of several files with torn lines."""
    ev = T.table(spark, sf_dir, "events")
    text = F.to_json(F.struct(F.col("event_type").alias("split"), "event_id", "user_id", "value"))
    torn = F.when(F.col("event_id") % 37 == 1, F.expr("substring(t, 1, length(t) - 3)")).otherwise(F.col("t"))
    path = scratch_path(spark, "event_log")
    ev.select(text.alias("t"), "event_id").select(torn.alias("value"), "event_id").repartition(4, "event_id").select("value").write.text(path)
    return path


def stream_access_counts(spark, sf_dir):
    return tails.drain(tails.access_counts(spark, _event_log(spark, sf_dir), _EVENT, max_files=2), "complete", "access_counts")


def stream_latest_state(spark, sf_dir):
    stream = tails.tail_jsonl(spark, _event_log(spark, sf_dir), _EVENT, max_files=2)
    return tails.upsert(tails.latest_state(stream, "user_id", "event_id", ["split", "value"]), ["user_id"], "latest_state", compact_every=2).read()


def stream_dedup(spark, sf_dir):
    """Distinct document texts; the same text counts once however often it arrives."""
    path = scratch_path(spark, "texts")
    T.table(spark, sf_dir, "documents").select("doc_id", "text").write.json(path)
    stream = tails.tail_jsonl(spark, path, "doc_id bigint, text string", max_files=1)
    return tails.drain(tails.first_seen(stream, "text"), "append", "dedup").select("text_hash", F.length("text").alias("chars"))


#: Copies of a text this far apart or closer are dropped; state older than that is forgotten.
HORIZON = "40 days"


def stream_dedup_within(spark, sf_dir):
    """Messages of every user, the first of each (user, type) kept; all events lie within the horizon, as the query's SQL counts on."""
    ev = T.table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    path = scratch_path(spark, "messages")
    ev.write.parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 4).parquet(path)
    with tails.state_on_disk(spark):
        return tails.drain(tails.first_seen(stream, "text", "at", HORIZON), "append", "dedup_within").select("text_hash", "text")


def audit_append(spark, sf_dir):
    """Append access records in two writes, then count them."""
    ev = T.table(spark, sf_dir, "events")
    rows = ev.select(F.col("event_type").alias("split"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                     F.unix_timestamp("ts").cast("double").alias("epoch"), F.col("user_id").cast("int").alias("pid"),
                     F.array(F.lit("reader")).alias("stack"))
    path = scratch_path(spark, "audit")
    J.append_audit(rows.where("pid % 2 = 0"), path)
    J.append_audit(rows.where("pid % 2 = 1"), path)
    log = J.read_jsonl(spark, path, J.AUDIT_SCHEMA)
    return log.groupBy("split").agg(F.count(F.lit(1)).alias("accesses"), F.max("timestamp").alias("last"), F.count_distinct("pid").alias("readers"))


def node_append(spark, sf_dir):
    """Append experiment rows by iteration and read them back with their iteration."""
    ev = T.table(spark, sf_dir, "events").select(
        F.dayofmonth("ts").alias("iter"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("status"),
        F.map_from_arrays(F.array(F.lit("0")), F.array("value")).alias("per_seed_primary"))
    path = scratch_path(spark, "nodes")
    J.append_nodes(ev.where("iter <= 15"), path)
    J.append_nodes(ev.where("iter > 15"), path)
    back = spark.read.schema("id string, status string, per_seed_primary map<string, double>, iter int").json(path)
    return back.groupBy("iter", "status").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.col("per_seed_primary")["0"]).alias("best"))


QUERIES = {f.__name__: f for f in (stream_access_counts, stream_latest_state, stream_dedup, stream_dedup_within, audit_append, node_append)}

SQL = {
    "stream_access_counts": "SELECT event_type AS split, count(*) AS accesses FROM events WHERE event_id % 37 <> 1 GROUP BY 1",
    "stream_latest_state": """SELECT user_id, event_id, event_type AS split, value FROM events WHERE event_id % 37 <> 1
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "stream_dedup": "SELECT sha1(text) AS text_hash, length(text)::INTEGER AS chars FROM documents GROUP BY ALL",
    "stream_dedup_within": "SELECT DISTINCT sha1(user_id || '|' || event_type) AS text_hash, user_id || '|' || event_type AS text FROM events",
    "audit_append": """SELECT event_type AS split, count(*) AS accesses, strftime(max(date_trunc('second', ts)), '%Y-%m-%dT%H:%M:%S') AS last,
        count(DISTINCT user_id) AS readers FROM events GROUP BY 1""",
    "node_append": "SELECT day(ts)::INTEGER AS iter, event_type AS status, count(*) AS nodes, max(value) AS best FROM events GROUP BY 1, 2",
}
