"""Registered split, lookup, feature and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import bucket_left, general_format, hash_uniform, smoothed_rate
from rankspark.operators import dense as D
from rankspark.operators import rates as R
from rankspark.operators import splits as P
from rankspark.operators import validate as V
from rankspark.operators.metrics import composition
from rankspark.operators.quantiles import exact_quantiles, interior
from rankspark.operators.skew import dense_index, number_within
from rankspark.operators.vocab import CategoricalIndexer, named_fields
from rankspark.plans import sqltext as S
from rankspark.plans.ranking import KEY, rounded, split_impressions, split_rows
from rankspark.session import pin, scratch_path
from rankspark.sources import logs as L
from rankspark.sources import tables as T

EDGE_DIGITS = 6


def train_rows(spark, sf_dir):
    return split_rows(spark, sf_dir, "train")


# ---- splits -----------------------------------------------------------------

def split_sizes(spark, sf_dir):
    return P.split_sizes(T.shown(spark, sf_dir), T.SPLITS, "shown_at", stored_as_time=True)


def valid_subsplits(spark, sf_dir):
    valid = P.pick_split(T.impressions(spark, sf_dir), T.OFFICIAL, "valid", "shown_at", stored_as_time=True)
    parts = P.assign_split(valid, T.VALID_PARTS, "shown_at", stored_as_time=True)
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
                                      F.max("date").alias("last_date"))


def split_composition(spark, sf_dir):
    out = composition(split_impressions(spark, sf_dir), ["split"], "user_id")
    return rounded(out, "all_negative", "all_positive", "discriminative")


def split_leak_rows(spark, sf_dir):
    """Leak check under sub-splits that overlap by design, so that the check has hits."""
    rows = T.impressions(spark, sf_dir)
    a = P.assign_split(rows, {"first": (19950101, 19990331)}, "shown_at", stored_as_time=True)
    b = P.assign_split(rows, {"second": (19990301, 20011231)}, "shown_at", stored_as_time=True)
    return P.leaked_rows(a.unionByName(b), ["order_id", "line_no", "item_id", "author_id", "date", "user_id"])


def split_coverage(spark, sf_dir):
    return P.coverage(T.shown(spark, sf_dir), T.OFFICIAL, T.SPLITS)


def split_round_trip(spark, sf_dir):
    """Rows that the four splits lose or repeat; empty when they partition the log.

    Both sides meet the same orders by the same key, so lines are compared first and those that differ meet their orders.
    """
    lines = T.order_lines(spark, sf_dir)
    split = P.assign_split(lines, T.SPLITS, "shown_at", stored_as_time=True)
    return with_orders(P.difference_rows(lines.select(*KEY), split.select(*KEY), 2 * T.shown(spark, sf_dir).count()),
                       T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id")))


def with_orders(differing, orders):
    """Differing lines as differing impressions: once for each order of their key."""
    return differing.join(orders, "order_id").groupBy(*KEY).agg(F.sum("surplus").alias("surplus"))


def duplicate_pairs(spark, sf_dir):
    out = P.repeated_pairs(split_impressions(spark, sf_dir), ["split"], ["user_id", "item_id"])
    return rounded(out, "repeated_share")


def pair_sparsity(spark, sf_dir):
    out = P.pair_sparsity(split_impressions(spark, sf_dir), ["split"], ["user_id", "author_id"])
    return rounded(out, "rows_per_pair")


def dense_row_ids(spark, sf_dir):
    return dense_index(T.impressions(spark, sf_dir).select(*KEY), KEY)


# ---- sources ----------------------------------------------------------------

def csv_log_round_trip(spark, sf_dir):
    """Write the log as two CSV files, read them back in file order and number the rows."""
    rows = split_impressions(spark, sf_dir)
    # written once: either file's sort reads its rows twice
    raw = pin(rows.select("date", F.col("user_id").cast("string"), F.col("item_id").cast("string").alias("video_id"),
                      "tab", "duration_ms", F.col("label").cast("string").alias("long_view"), "order_id", "line_no",
                      "author_id"), "log")
    paths = []
    for name, cond in (("early", F.col("date") <= T.SPLITS["train"][1]), ("late", F.col("date") > T.SPLITS["train"][1])):
        path = scratch_path(spark, f"log_{name}")
        raw.where(cond).orderBy("order_id", "line_no", "video_id", "author_id", "date").write.option("header", True).csv(path)
        paths.append(path)
    names = {**L.LOG_COLUMNS, "order_id": "order_id", "line_no": "line_no", "author_id": "author_id"}
    out = L.with_row_id(L.read_impressions(spark, paths, names))
    return out.select("row_id", "date", "user_id", "item_id", "tab", "duration_ms", "label", "order_id", "line_no")


def prediction_file_round_trip(spark, sf_dir):
    """Write a prediction file for the test rows, read it back and check it."""
    want = _expected(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    L.write_predictions(want.withColumn("score", hash_uniform(F.lit("p"), "row_id")), path)
    lines = L.read_prediction_lines(spark, path)
    bad_head = lines.where(~F.col("header_ok")).select("line", F.lit("header").alias("violation"))
    return V.prediction_verdict(V.prediction_violations(lines, want).unionByName(bad_head))


#: Every eleventh key is moved out of range, so lookups also meet keys that no table has.
_MOVED = "CASE WHEN {0} % 11 = 0 THEN -1 - {0} ELSE {0} END"


def _moved(df, key):
    return df.withColumn(key, F.expr(_MOVED.format(key)))


def item_attributes_lookup(spark, sf_dir):
    items = T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    out = L.join_attributes(_moved(T.impressions(spark, sf_dir), "item_id"), items, "item_id", ["brand", "kind"])
    return out.select("order_id", "line_no", "item_id", "author_id", "date", "brand", "kind")


def user_attributes_lookup(spark, sf_dir):
    users = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"))
    out = L.join_attributes(_moved(T.impressions(spark, sf_dir), "user_id"), users, "user_id", ["segment", "nation"])
    return out.groupBy("segment", "nation").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("pos"))


def last_row_wins(spark, sf_dir):
    """Attribute table with repeated keys: the last row of a key is kept."""
    log = T.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return L.last_per_key(log, ["user_id"], "event_id", ["event_id", "event_type", "value"])


def unseen_items(spark, sf_dir):
    rows = split_impressions(spark, sf_dir)
    out = R.unseen(_moved(rows.where("split = 'test'"), "item_id"), rows.where("split = 'train'"), "item_id")
    return out.select("order_id", "line_no", "item_id", "author_id", "date")


# ---- rates, buckets, vocabularies -------------------------------------------

def rate_table_item(spark, sf_dir):
    return R.rate_table(train_rows(spark, sf_dir), ["item_id"])


def rate_table_author(spark, sf_dir):
    return R.rate_table(train_rows(spark, sf_dir), ["author_id"])


def smoothed_rates(spark, sf_dir):
    train = train_rows(spark, sf_dir)
    out = R.rate_table(train, ["item_id"]).withColumn(
        "rate", smoothed_rate("pos", "imp", 20.0, R.global_rate(train)))
    return rounded(out, "rate")


def popularity_with_default(spark, sf_dir):
    """Items of a log the train split never saw score exactly the global rate."""
    rows = split_impressions(spark, sf_dir)
    out = R.popularity_scores(rows.where("split = 'train'"), _moved(rows.where("split = 'test'"), "item_id"))
    return rounded(out.select("order_id", "line_no", "item_id", "author_id", "date", "score"), "score")


def group_sizes(spark, sf_dir):
    return R.group_sizes(train_rows(spark, sf_dir), "user_id")


def group_offsets(spark, sf_dir):
    return R.group_offsets(train_rows(spark, sf_dir), "user_id", KEY)


def user_layout(spark, sf_dir):
    """Rows laid out in user blocks; the layout changes no row."""
    rows = train_rows(spark, sf_dir).select("user_id", *KEY)
    return D.user_layout(rows, "user_id", KEY)


def pair_eligibility(spark, sf_dir):
    return R.pair_eligibility(train_rows(spark, sf_dir), "user_id")


def _duration_edges(train):
    return [round(e, EDGE_DIGITS) for e in exact_quantiles(train, "duration_ms", interior(10))]


def quantile_edges(spark, sf_dir):
    train = train_rows(spark, sf_dir)
    edges = exact_quantiles(train, "duration_ms", interior(10))
    return train.agg(*[F.lit(round(e, 4)).alias(f"q{i}0") for i, e in enumerate(edges, 1)],
                     F.count(F.lit(1)).alias("rows"))


def duration_bucket(spark, sf_dir):
    rows = split_impressions(spark, sf_dir)
    edges = _duration_edges(rows.where("split = 'train'"))
    return (rows.withColumn("dur_bucket", bucket_left("duration_ms", edges))
            .groupBy("split", "dur_bucket").agg(F.count(F.lit(1)).alias("rows")))


def user_activity_bucket(spark, sf_dir):
    out, _ = D.activity_buckets(train_rows(spark, sf_dir), "user_id", 10)
    return out


def cross_rates(spark, sf_dir):
    train = train_rows(spark, sf_dir)
    users, _ = D.activity_buckets(train, "user_id", 10)
    return R.rate_table(train.join(users.select("user_id", "bucket"), "user_id"), ["item_id", "bucket"])


def _fields(edges):
    return {**named_fields("user_id", "item_id", "author_id", "tab"),
            "dur_bucket": bucket_left("duration_ms", edges)}


def base_indexer(rows):
    train = rows.where("split = 'train'")
    return CategoricalIndexer(_fields(_duration_edges(train))).fit(train, KEY)


def vocabulary(spark, sf_dir):
    return base_indexer(pin(split_impressions(spark, sf_dir), "rows")).vocabulary()


def encoded_rows(spark, sf_dir):
    rows = pin(split_impressions(spark, sf_dir), "rows")    # edges, vocabulary and encoding read the joined rows some six times
    return base_indexer(rows).transform(rows).select(
        *KEY, "f_user_id", "f_item_id", "f_author_id", "f_tab", "f_dur_bucket")


def wide_rows(spark, sf_dir):
    """Impressions with item and user attributes attached."""
    rows = split_impressions(spark, sf_dir)
    items = T.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    users = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"))
    rows = L.join_attributes(rows, items, "item_id", ["brand", "kind"])
    return L.join_attributes(rows, users, "user_id", ["segment", "nation"])


#: Field sets by name; each is a list of columns added to the base fields.
FIELD_SETS = {"base": [], "item": ["brand", "kind"], "full": ["brand", "kind", "segment", "nation"]}


def indexer_for(rows, mode: str):
    train = rows.where("split = 'train'")
    fields = {**_fields(_duration_edges(train)), **named_fields(*FIELD_SETS[mode])}
    return CategoricalIndexer(fields).fit(train, KEY)


def encoded_rows_wide(spark, sf_dir):
    rows = pin(wide_rows(spark, sf_dir), "rows")
    out = indexer_for(rows, "full").transform(rows)
    return out.select(*KEY, "f_brand", "f_kind", "f_segment", "f_nation", F.size("features").alias("n_fields"))


# ---- dense features ---------------------------------------------------------

def dense_features(spark, sf_dir):
    rows = pin(split_impressions(spark, sf_dir), "rows")
    model = D.DenseFeatures().fit(rows.where("split = 'train'"))
    return rounded(model.transform(rows).select(*KEY, *D.FEATURES), *D.FEATURES)


def _features_of(rows):
    return D.DenseFeatures().fit(rows.where("split = 'train'")).transform(rows).select(*KEY, "split", *D.FEATURES)


def label_flip_invariance(spark, sf_dir):
    """Flip every label outside train: no feature may change."""
    rows = pin(split_impressions(spark, sf_dir), "rows")
    flipped = rows.withColumn("label", F.when(F.col("split") == "train", F.col("label")).otherwise(1 - F.col("label")))
    return P.difference_rows(_features_of(rows), _features_of(flipped))


def append_invariance(spark, sf_dir):
    """Repeat the validation rows under new line numbers: no old row's features may change."""
    rows = pin(split_impressions(spark, sf_dir), "rows")
    extra = rows.where("split = 'valid_search'").withColumn("line_no", F.col("line_no") + 1000)
    grown = _features_of(rows.unionByName(extra)).where("line_no < 1000")
    return P.difference_rows(_features_of(rows), grown)


# ---- validation -------------------------------------------------------------

def _expected(spark, sf_dir):
    rows = split_rows(spark, sf_dir, "test").select(*KEY, "user_id")
    return dense_index(rows, KEY).select("row_id", "user_id", "item_id")


def _lines(want, faults: bool):
    score = general_format(F.col("row_id") / 7 - 1.5)
    item = F.col("item_id").cast("string")
    row_id, tail = F.col("row_id"), F.lit("")
    if faults:
        row_id = F.when(F.col("row_id") % 83 == 11, F.col("row_id") + 1).otherwise(F.col("row_id"))
        item = F.when(F.col("row_id") % 97 == 5, "999999").otherwise(item)
        score = (F.when(F.col("row_id") % 89 == 7, "NaN").when(F.col("row_id") % 89 == 8, "abc").otherwise(score))
        tail = F.when(F.col("row_id") % 79 == 3, ",9").otherwise("")
    text = F.concat(F.concat_ws(",", row_id.cast("string"), F.col("user_id").cast("string"), item, score), tail)
    return want.select(F.col("row_id").alias("line"), text.alias("text"))


def prediction_check_ok(spark, sf_dir):
    want = _expected(spark, sf_dir)
    return V.prediction_verdict(V.prediction_violations(_lines(want, False), want))


def prediction_check_violations(spark, sf_dir):
    want = _expected(spark, sf_dir)
    # some lines go missing; as many surplus lines follow the file
    lines = _lines(want, True).where("line % 71 != 70")
    surplus = want.where("row_id % 71 = 70").select(
        (F.col("row_id") + 10_000_000_000).alias("line"),
        F.concat_ws(",", (F.col("row_id") + 10_000_000_000).cast("string"), F.lit("1"), F.lit("1"), F.lit("0.5")).alias("text"))
    return V.prediction_violations(lines.unionByName(surplus), want)


def validity_violations(spark, sf_dir):
    ev = T.event_impressions(spark, sf_dir)
    broken = ev.select(
        "row_id", F.when(F.col("row_id") % 211 == 9, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("row_id") % 101 == 4, 2).otherwise(F.col("label")).alias("label"),
        F.when(F.col("row_id") % 97 == 3, F.lit(float("nan"))).when(F.col("row_id") % 97 == 4, F.lit(float("inf")))
        .otherwise(F.col("duration_ms")).alias("score"))
    return V.validity_violations(broken)


def validated_report(spark, sf_dir):
    ev = T.event_impressions(spark, sf_dir).withColumn("score", F.col("duration_ms"))
    sizes = {"all": T.table(spark, sf_dir, "events").count()}
    return rounded(V.validated_report(ev, "all", sizes), "gauc", "ndcg", "primary")


def provenance_violations(spark, sf_dir):
    """Words a source uses that the benchmark table reserves."""
    def words(df, *keys):
        return df.select(*keys, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("column_name")).where("column_name != ''")
    listing = words(T.table(spark, sf_dir, "documents").withColumnRenamed("source", "table_name"), "table_name")
    return V.provenance_violations(listing, words(T.table(spark, sf_dir, "benchmark")))


def negative_numbers(spark, sf_dir):
    """Position of each negative and positive inside its user's block."""
    train = train_rows(spark, sf_dir).select("user_id", "label", *KEY)
    return number_within(train, ["user_id", "label"], KEY, "k")


QUERIES = {f.__name__: f for f in (
    split_sizes, valid_subsplits, split_composition, split_leak_rows, split_coverage, split_round_trip,
    duplicate_pairs, pair_sparsity, dense_row_ids, csv_log_round_trip, prediction_file_round_trip,
    item_attributes_lookup, user_attributes_lookup, last_row_wins, unseen_items, rate_table_item,
    rate_table_author, smoothed_rates, popularity_with_default, group_sizes, group_offsets, user_layout, pair_eligibility,
    quantile_edges,
    duration_bucket, user_activity_bucket, cross_rates, vocabulary, encoded_rows, encoded_rows_wide,
    dense_features, label_flip_invariance, append_invariance, prediction_check_ok,
    prediction_check_violations, validity_violations, validated_report, provenance_violations, negative_numbers)}

_W = f"WITH {S.SPLIT_IMP}"
_EDGES = """edges AS (SELECT list_transform(quantile_cont(duration_ms::DOUBLE,
    [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]), lambda q: round(q, 6)) AS es FROM train)"""
_BUCKET = "len(list_filter((SELECT es FROM edges), lambda e: e < duration_ms))"
_UB = """ucnt AS (SELECT user_id, count(*) AS imp, sum(label)::BIGINT AS pos FROM train GROUP BY 1),
uedges AS (SELECT quantile_cont(imp::DOUBLE, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS es FROM ucnt),
ub AS (SELECT user_id, imp, pos, len(list_filter((SELECT es FROM uedges), lambda e: e < imp))::INTEGER AS bucket FROM ucnt)"""


def _vocab_sql(fields: dict[str, str], source: str = "train") -> str:
    arms = " UNION ALL ".join(
        f"SELECT {i} AS f, '{name}' AS field, CAST({expr} AS VARCHAR) AS value, rn FROM numbered"
        for i, (name, expr) in enumerate(fields.items()))
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {S.KEY}) AS rn FROM {source}),
cells AS ({arms}), firsts AS (SELECT f, field, value, min(rn) AS rn FROM cells GROUP BY ALL),
vocab AS (SELECT f, field, value, row_number() OVER (PARTITION BY f ORDER BY rn) - 1 AS local_id,
    row_number() OVER (ORDER BY f, rn) - 1 + f AS feature_id FROM firsts),
unk AS (SELECT f, field, max(feature_id) + 1 AS unk FROM vocab GROUP BY ALL)"""


_BASE = {"user_id": "user_id", "item_id": "item_id", "author_id": "author_id", "tab": "tab", "dur_bucket": _BUCKET}
_WIDE = {**_BASE, "brand": "brand", "kind": "kind", "segment": "segment", "nation": "nation"}


def _encode_sql(names, exprs, source: str) -> str:
    cols = ", ".join(f"coalesce(v_{n}.feature_id, (SELECT unk FROM unk WHERE field = '{n}'))::BIGINT AS f_{n}" for n in names)
    joins = " ".join(f"LEFT JOIN vocab v_{n} ON v_{n}.field = '{n}' AND v_{n}.value = CAST({exprs[n]} AS VARCHAR)"
                     for n in names)
    keys = ", ".join(f"s.{k}" for k in KEY)
    return f"SELECT {keys}, {cols} FROM {source} s {joins}"


def _qualified(exprs):
    return {k: (v if v == _BUCKET else f"s.{v}") for k, v in exprs.items()}


_EXPECT = _W + f""", want AS (SELECT row_number() OVER (ORDER BY {S.KEY}) - 1 AS row_id, user_id, item_id
    FROM simp WHERE split = 'test')"""

SQL = {
    "split_sizes": _W + ' SELECT split, count(*) AS "rows" FROM simp GROUP BY 1',
    "valid_subsplits": _W + """ SELECT split, count(*) AS "rows", min(date) AS first_date, max(date) AS last_date
        FROM simp WHERE split LIKE 'valid%' GROUP BY 1""",
    "split_composition": _W + """ SELECT split, count(*) AS users, round(avg((p = 0)::INT::DOUBLE), 6) AS all_negative,
        round(avg((p = n)::INT::DOUBLE), 6) AS all_positive, round(avg((p > 0 AND p < n)::INT::DOUBLE), 6) AS discriminative
        FROM (SELECT split, user_id, sum(label) AS p, count(*) AS n FROM simp GROUP BY 1, 2) GROUP BY 1""",
    "split_leak_rows": f"""WITH {S.IMP}, u AS (
        SELECT 'first' AS split, * FROM imp WHERE date BETWEEN 19950101 AND 19990331 UNION ALL
        SELECT 'second' AS split, * FROM imp WHERE date BETWEEN 19990301 AND 20011231)
        SELECT order_id, line_no, item_id, author_id, date, user_id, count(*) AS copies FROM u
        GROUP BY ALL HAVING count(DISTINCT split) > 1""",
    "split_coverage": f"""WITH {S.IMP} SELECT split, count(*) AS "rows", sum((part IS NULL)::INT)::BIGINT AS unclaimed,
        0::BIGINT AS claimed_twice FROM (SELECT {S.case_split(T.OFFICIAL)} AS split, {S.case_split()} AS part FROM imp)
        WHERE split IS NOT NULL GROUP BY 1""",
    "split_round_trip": f"""WITH {S.SPLIT_IMP} SELECT order_id, line_no, item_id, author_id, date, 0::BIGINT AS surplus
        FROM (SELECT order_id, line_no, item_id, author_id, date FROM imp EXCEPT ALL
              SELECT order_id, line_no, item_id, author_id, date FROM simp)""",
    "duplicate_pairs": _W + """ SELECT split, sum(n)::BIGINT AS "rows", sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS repeated_rows,
        round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS repeated_share, max(n) AS max_copies
        FROM (SELECT split, user_id, item_id, count(*) AS n FROM simp GROUP BY ALL) GROUP BY 1""",
    "pair_sparsity": _W + """ SELECT split, count(*) AS "rows", count(DISTINCT (user_id, author_id)) AS pairs,
        round(count(*) / count(DISTINCT (user_id, author_id))::DOUBLE, 6) AS rows_per_pair FROM simp GROUP BY 1""",
    "dense_row_ids": f"WITH {S.IMP} SELECT {S.KEY}, row_number() OVER (ORDER BY {S.KEY}) - 1 AS row_id FROM imp",
    "csv_log_round_trip": _W + f""" SELECT row_number() OVER (ORDER BY date > {T.SPLITS['train'][1]}, order_id, line_no,
          item_id::VARCHAR, author_id, date) - 1 AS row_id, date, user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id,
          tab, duration_ms, label, order_id::VARCHAR AS order_id, line_no::VARCHAR AS line_no FROM simp""",
    "prediction_file_round_trip": """SELECT true AS passed, 0::BIGINT AS violations, NULL::BIGINT AS first_line,
        NULL::VARCHAR AS first_violation""",
    "item_attributes_lookup": f"""WITH {S.IMP} SELECT order_id, line_no, item_id, author_id, date,
        coalesce(p_brand, 'UNK') AS brand, coalesce(p_type, 'UNK') AS kind
        FROM (SELECT * REPLACE ({_MOVED.format("item_id")} AS item_id) FROM imp) LEFT JOIN part ON item_id = p_partkey""",
    "user_attributes_lookup": f"""WITH {S.IMP} SELECT coalesce(c_mktsegment, 'UNK') AS segment,
        coalesce(c_nationkey::VARCHAR, 'UNK') AS nation, count(*) AS "rows", sum(label)::BIGINT AS pos
        FROM (SELECT * REPLACE ({_MOVED.format("user_id")} AS user_id) FROM imp) LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2""",
    "last_row_wins": """SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "unseen_items": _W + f""", moved AS (SELECT * REPLACE ({_MOVED.format("item_id")} AS item_id) FROM simp)
        SELECT order_id, line_no, item_id, author_id, date FROM moved WHERE split = 'test' AND item_id NOT IN (SELECT item_id FROM train)""",
    "rate_table_item": _W + " SELECT item_id, sum(label)::BIGINT AS pos, count(*) AS imp FROM train GROUP BY 1",
    "rate_table_author": _W + " SELECT author_id, sum(label)::BIGINT AS pos, count(*) AS imp FROM train GROUP BY 1",
    "smoothed_rates": _W + """ SELECT item_id, sum(label)::BIGINT AS pos, count(*) AS imp,
        round((sum(label) + 20.0::DOUBLE * (SELECT avg(label) FROM train)) / (count(*) + 20.0::DOUBLE), 6) AS rate
        FROM train GROUP BY 1""",
    "popularity_with_default": _W + f""", moved AS (SELECT * REPLACE ({_MOVED.format("item_id")} AS item_id) FROM simp),
        r AS (SELECT item_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1)
        SELECT order_id, line_no, item_id, author_id, date,
          round((coalesce(p, 0) + 20.0::DOUBLE * (SELECT avg(label) FROM train)) / (coalesce(n, 0) + 20.0::DOUBLE), 6) AS score
        FROM moved LEFT JOIN r USING (item_id) WHERE split = 'test'""",
    "group_sizes": _W + ' SELECT user_id, count(*) AS "rows" FROM train GROUP BY 1',
    "group_offsets": _W + """ SELECT user_id, (sum(n) OVER (ORDER BY user_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY user_id))::BIGINT AS "end"
        FROM (SELECT user_id, count(*) AS n FROM train GROUP BY 1)""",
    "user_layout": _W + f" SELECT user_id, {S.KEY} FROM train",
    "pair_eligibility": _W + """ SELECT user_id, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg,
        sum(label) > 0 AND sum(1 - label) > 0 AS eligible FROM train GROUP BY 1""",
    "quantile_edges": _W + " SELECT " + ", ".join(
        f"round(quantile_cont(duration_ms::DOUBLE, 0.{i}), 4) AS q{i}0" for i in range(1, 10)) + ', count(*) AS "rows" FROM train',
    "duration_bucket": _W + f""", {_EDGES} SELECT split, {_BUCKET}::INTEGER AS dur_bucket, count(*) AS "rows"
        FROM simp GROUP BY 1, 2""",
    "user_activity_bucket": _W + f", {_UB} SELECT user_id, imp, bucket FROM ub",
    "cross_rates": _W + f""", {_UB} SELECT item_id, bucket, sum(label)::BIGINT AS pos, count(*) AS imp
        FROM train JOIN ub USING (user_id) GROUP BY 1, 2""",
    "vocabulary": _W + f", {_EDGES}, {_vocab_sql(_BASE)} SELECT field, value, local_id, feature_id FROM vocab",
    "encoded_rows": _W + f", {_EDGES}, {_vocab_sql(_BASE)} " + _encode_sql(list(_BASE), _qualified(_BASE), "simp"),
    "encoded_rows_wide": _W + f""", {_EDGES}, wide AS (SELECT simp.*, coalesce(p_brand, 'UNK') AS brand,
        coalesce(p_type, 'UNK') AS kind, coalesce(c_mktsegment, 'UNK') AS segment, coalesce(c_nationkey::VARCHAR, 'UNK') AS nation
        FROM simp LEFT JOIN part ON item_id = p_partkey LEFT JOIN customer ON user_id = c_custkey),
        wtrain AS (SELECT * FROM wide WHERE split = 'train'), {_vocab_sql(_WIDE, "wtrain")}
        SELECT *, 9::INTEGER AS n_fields FROM (""" + _encode_sql(["brand", "kind", "segment", "nation"], _qualified(_WIDE), "wide") + ")",
    "dense_features": _W + f""", {_UB}, g AS (SELECT avg(label) AS m FROM train),
        i AS (SELECT item_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1),
        a AS (SELECT author_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1),
        c AS (SELECT item_id, bucket, sum(label) AS p, count(*) AS n FROM train JOIN ub USING (user_id) GROUP BY 1, 2),
        t AS (SELECT tab, row_number() OVER (ORDER BY tab) - 1 AS code FROM (SELECT DISTINCT tab FROM train)),
        j AS (SELECT s.*, m, i.p AS ip, i.n AS inn, a.p AS ap, a.n AS an, ub.pos AS up, ub.imp AS un, c.p AS cp, c.n AS cn, code,
          (coalesce(i.p, 0) + 20.0::DOUBLE * m) / (coalesce(i.n, 0) + 20.0::DOUBLE) AS ir
          FROM simp s LEFT JOIN i USING (item_id) LEFT JOIN a USING (author_id) LEFT JOIN ub ON ub.user_id = s.user_id
          LEFT JOIN c ON c.item_id = s.item_id AND c.bucket = coalesce(ub.bucket, -1) LEFT JOIN t USING (tab), g)
        SELECT {S.KEY}, round(ir, 6) AS item_rate, round(ln(1 + coalesce(inn, 0)), 6) AS item_imp_log,
          round((coalesce(ap, 0) + 20.0::DOUBLE * m) / (coalesce(an, 0) + 20.0::DOUBLE), 6) AS author_rate,
          round(ln(1 + coalesce(an, 0)), 6) AS author_imp_log,
          round((coalesce(up, 0) + 20.0::DOUBLE * m) / (coalesce(un, 0) + 20.0::DOUBLE), 6) AS user_rate,
          round(ln(1 + coalesce(un, 0)), 6) AS user_imp_log, round(ln(1 + duration_ms), 6) AS duration_log,
          coalesce(code, -1)::DOUBLE AS tab_code,
          round((coalesce(cp, 0) + 10.0::DOUBLE * ir) / (coalesce(cn, 0) + 10.0::DOUBLE), 6) AS item_rate_by_user_bucket,
          (inn IS NULL)::INT::DOUBLE AS item_is_new FROM j""",
    "label_flip_invariance": f"""WITH {S.IMP} SELECT {S.KEY}, '' AS split, """ + ", ".join(
        f"0.0::DOUBLE AS {c}" for c in D.FEATURES) + ", 0::BIGINT AS surplus FROM imp WHERE false",
    "append_invariance": f"""WITH {S.IMP} SELECT {S.KEY}, '' AS split, """ + ", ".join(
        f"0.0::DOUBLE AS {c}" for c in D.FEATURES) + ", 0::BIGINT AS surplus FROM imp WHERE false",
    "prediction_check_ok": """SELECT true AS passed, 0::BIGINT AS violations, NULL::BIGINT AS first_line,
        NULL::VARCHAR AS first_violation""",
    "prediction_check_violations": _EXPECT + """ SELECT * FROM (SELECT row_id AS line, CASE
          WHEN row_id % 71 = 70 THEN 'missing_row' WHEN row_id % 79 = 3 THEN 'field_count'
          WHEN row_id % 83 = 11 THEN 'row_id' WHEN row_id % 97 = 5 THEN 'alignment'
          WHEN row_id % 89 = 8 THEN 'score_not_number' WHEN row_id % 89 = 7 THEN 'score_not_finite' END AS violation FROM want
        UNION ALL SELECT row_id + 10000000000, 'surplus_row' FROM want WHERE row_id % 71 = 70) WHERE violation IS NOT NULL""",
    "validity_violations": """SELECT * FROM (
        SELECT 'score_not_finite' AS rule, count(*) AS violations, min(event_id) AS first_row FROM events WHERE event_id % 97 IN (3, 4)
        UNION ALL SELECT 'label_not_binary', count(*), min(event_id) FROM events WHERE event_id % 101 = 4
        UNION ALL SELECT 'user_missing', count(*), min(event_id) FROM events WHERE event_id % 211 = 9) WHERE violations > 0""",
    "validated_report": """WITH src AS (SELECT event_id, user_id, value AS score,
        CAST(event_type = 'purchase' AS INTEGER) AS label FROM events),"""
        + S.user_metrics("src", "user_id", "event_id") + S.report(),
    "provenance_violations": """SELECT DISTINCT table_name, w AS column_name FROM (
        SELECT source AS table_name, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents)
        WHERE w <> '' AND w IN (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM benchmark)""",
    "negative_numbers": _W + f""" SELECT user_id, label, {S.KEY}, row_number() OVER (
        PARTITION BY user_id, label ORDER BY {S.KEY}) - 1 AS k FROM train""",
}
