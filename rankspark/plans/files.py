"""Registered queries over files and small lookups: digests of file sets, previews, progress documents, keys and map means."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import map_mean, topic_key
from rankspark.session import scratch_path
from rankspark.sources import files as W
from rankspark.sources import jsonl as J
from rankspark.sources import logs as L
from rankspark.sources import tables as T

#: Files of each source's folder that its digest covers, in this order; the last is nowhere.
COVERED = ("lang=fr", "lang=en", "lang=none")
PREVIEW = 100
PREVIEWED = ("part", "customer", "orders", "events")
#: Events of one progress document.
IN_DOCUMENT = 1024


def file_set_digests(spark, sf_dir):
    """Each source keeps one file a language that states its documents; some files of each folder are digested."""
    docs = T.table(spark, sf_dir, "documents")
    said = docs.groupBy("source", "lang").agg(F.concat_ws(" ", F.count(F.lit(1)), F.sum("n_chars"), F.min("doc_id"), F.max("doc_id")).alias("value"))
    path = scratch_path(spark, "stated")
    said.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    # the writer names its files itself: take the folder of a file as its name
    found = W.read_files(spark, path).select(F.regexp_extract("folder", "source=([^/]*)/", 1).alias("source"),
                                             F.regexp_extract("folder", "([^/]*)$", 1).alias("name"), "content")
    return W.set_digest(found, COVERED, "source")


def table_previews(spark, sf_dir):
    """First rows of several CSV tables."""
    paths = {}
    for name in PREVIEWED:
        paths[name] = scratch_path(spark, f"preview_{name}")
        T.table(spark, sf_dir, name).write.option("header", True).csv(paths[name])
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
             for name, df in L.preview(spark, paths, PREVIEW).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def progress_documents(spark, sf_dir):
    """Progress documents, one a file, each of consecutive events by day, read and flattened."""
    ev = T.table(spark, sf_dir, "events").withColumn("doc", F.expr(f"event_id DIV {IN_DOCUMENT}"))
    cand = F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("primary"), F.col("event_type").alias("status"))
    days = ev.groupBy("doc", F.dayofmonth("ts").alias("iter")).agg(F.sort_array(F.collect_list(cand)).alias("candidates"))
    docs = days.groupBy("doc").agg(F.collect_list(F.struct("iter", "candidates")).alias("iterations"), F.count(F.lit(1)).cast("int").alias("iters_completed"))
    path = scratch_path(spark, "progress")
    docs.repartition("doc").write.partitionBy("doc").json(path)
    flat = J.flatten_progress(J.read_progress(spark, path), ["doc", "iters_completed"])
    return flat.groupBy("doc", "iters_completed", "status").agg(F.count(F.lit(1)).alias("candidates"), F.max("primary").alias("best"))


def topic_keys(spark, sf_dir):
    """Turns whose texts are one topic up to case and spacing."""
    turns = T.table(spark, sf_dir, "conversations").withColumn("raw", F.concat(F.lit("  "), F.upper("role"), F.lit(" \n "), "text"))
    return turns.groupBy(F.md5(topic_key("raw")).alias("topic")).agg(F.count(F.lit(1)).alias("turns"))


def map_means(spark, sf_dir):
    """Mean over the seeds of each line that have a value."""
    lines = T.table(spark, sf_dir, "lineitem")
    seeds = F.create_map(F.lit("0"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")), F.lit("1"), F.when(F.col("l_linenumber") % 2 > 0, F.col("l_tax")),
                         F.lit("2"), F.lit(None).cast("double"))
    return lines.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("lines"), F.count(map_mean(seeds)).alias("known"), F.round(F.avg(map_mean(seeds)), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (file_set_digests, table_previews, progress_documents, topic_keys, map_means)}

_COLUMNS = {"part": 6, "customer": 5, "orders": 6, "events": 6}

SQL = {
    "file_set_digests": f"""WITH said AS (SELECT source, 'lang=' || lang AS name, count(*) || ' ' || sum(n_chars)::BIGINT || ' ' || min(doc_id) || ' ' || max(doc_id) || chr(10) AS body
        FROM documents GROUP BY source, lang)
      SELECT source, sha256(coalesce(string_agg(name || body, '' ORDER BY list_position({list(COVERED)}, name)) FILTER (name IN {COVERED}), '')) AS sha256,
        count(*) FILTER (name IN {COVERED}) AS files FROM said GROUP BY source""",
    "table_previews": " UNION ALL ".join(f"""SELECT '{t}' AS name, least(count(*), {PREVIEW}) AS "rows", {_COLUMNS[t]}::INTEGER AS "columns" FROM {t}""" for t in PREVIEWED),
    "progress_documents": f"""WITH e AS (SELECT event_id // {IN_DOCUMENT} AS doc, day(ts) AS iter, event_type, value FROM events),
      n AS (SELECT doc, count(DISTINCT iter)::INTEGER AS iters_completed FROM e GROUP BY 1)
      SELECT doc::INTEGER AS doc, iters_completed, event_type AS status, count(*) AS candidates, max(value) AS best FROM e JOIN n USING (doc) GROUP BY 1, 2, 3""",
    "topic_keys": r"""SELECT md5(regexp_replace(lower(trim('  ' || upper(role) || e' \n ' || text)), '\s+', ' ', 'g')) AS topic, count(*) AS turns FROM conversations GROUP BY 1""",
    "map_means": """WITH m AS (SELECT l_linenumber, list_avg(list_filter([CASE WHEN l_linenumber % 3 > 0 THEN l_discount END,
        CASE WHEN l_linenumber % 2 > 0 THEN l_tax END], lambda x: x IS NOT NULL)) AS v FROM lineitem)
      SELECT l_linenumber, count(*) AS lines, count(v) AS known, round(avg(v), 6) AS mean FROM m GROUP BY 1""",
}
