"""The driver tables read as the logical tables of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import spread

#: Columns that identify an impression and give its place in the log.
ROW_KEY = ("order_id", "line_no", "item_id", "author_id", "date")

#: Inclusive yyyymmdd ranges.
OFFICIAL = {"train": (19950101, 19981231), "valid": (19990101, 20000630), "test": (20000701, 20011231)}
SPLITS = {"train": (19950101, 19981231), "valid_search": (19990101, 19991231),
          "valid_confirm": (20000101, 20000630), "test": (20000701, 20011231)}
VALID_PARTS = {name: SPLITS[name] for name in ("valid_search", "valid_confirm")}


#: Stated schemas: the reader need not open a footer before the query runs.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


#: Tables with per-row work worth spreading, and the key to spread them by.
SPREAD = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def yyyymmdd(ts: str):
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impressions before they meet their orders.

    ``shown_at`` is the stored time, which range filters can push to the scan; ``date`` is derived from it.
    """
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("author_id"),
        F.col("l_extendedprice").alias("duration_ms"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_shipdate").alias("shown_at"),
        yyyymmdd("l_shipdate").alias("date"))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an impression log: who saw what, from whom, when, and the label."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("tab"))
    return order_lines(spark, sf_dir).join(orders, "order_id")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each impression was shown, without the other columns and without the orders."""
    lines = spark.read.schema(SCHEMAS["lineitem"]).parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return lines.select(F.col("l_shipdate").alias("shown_at"), yyyymmdd("l_shipdate").alias("date"))


def event_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a second impression log; the event type is the label, never a feature."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id",
        F.get_json_object("props", "$.k").alias("item_id"), F.col("value").alias("duration_ms"),
        (F.col("event_type") == "purchase").cast("int").alias("label"), yyyymmdd("ts").alias("date"))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")
