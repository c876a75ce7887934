"""SQL fragments shared by the comparison queries."""

from __future__ import annotations

from rankspark.sources.tables import ROW_KEY, SPLITS

KEY = ", ".join(ROW_KEY)

IMP = """imp AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS item_id, l_suppkey AS author_id,
         l_extendedprice AS duration_ms, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INTEGER) AS date,
         o_custkey AS user_id, o_orderpriority AS tab
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def case_split(ranges=SPLITS, date: str = "date") -> str:
    arms = " ".join(f"WHEN {date} BETWEEN {lo} AND {hi} THEN '{name}'" for name, (lo, hi) in ranges.items())
    return f"CASE {arms} END"


SPLIT_IMP = IMP + f""",
simp AS (SELECT * FROM (SELECT *, {case_split()} AS split FROM imp) WHERE split IS NOT NULL),
train AS (SELECT * FROM simp WHERE split = 'train')"""

#: Uniform number from a text key, see functions.hash_uniform.
def hash32(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def hash60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def uniform(text: str) -> str:
    return f"({hash32(text)} / 4294967296.0::DOUBLE)"


POPULARITY = SPLIT_IMP + """,
g AS (SELECT avg(label::DOUBLE) AS m FROM train),
rates AS (SELECT item_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1),
pop AS (SELECT s.*, (coalesce(p, 0) + 20.0::DOUBLE * m) / (coalesce(n, 0) + 20.0::DOUBLE) AS score
        FROM simp s LEFT JOIN rates USING (item_id), g)"""


def user_metrics(source: str, keys: str, tiebreak: str, k: int = 5, name: str = "um") -> str:
    """CTE with one row per group: n, pos, auc, ndcg by the textbook definitions."""
    return f"""
{name}_r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)
      + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS rk,
    row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {tiebreak}) AS place,
    row_number() OVER (PARTITION BY {keys} ORDER BY label DESC) AS best FROM {source}),
{name} AS (SELECT {keys}, count(*) AS n, sum(label)::BIGINT AS pos,
    CASE WHEN sum(label) BETWEEN 1 AND count(*) - 1
         THEN (sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
              / (sum(label) * (count(*) - sum(label))::DOUBLE) ELSE 0.5 END AS auc,
    CASE WHEN sum(label) = 0 THEN 0.0 ELSE
      sum(CASE WHEN place <= {k} THEN (pow(2, label) - 1) / log2(place + 1) ELSE 0 END)
      / sum(CASE WHEN best <= {k} THEN (pow(2, label) - 1) / log2(best + 1) ELSE 0 END) END AS ndcg
  FROM {name}_r GROUP BY {keys})"""


def report(source: str = "um", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}round(gauc, 6) AS gauc, round(ndcg, 6) AS ndcg,
  round((gauc + ndcg) / 2, 6) AS "primary", users, "rows" FROM (
  SELECT {lead}coalesce(sum(CASE WHEN pos > 0 AND pos < n THEN pos * auc END)
              / sum(CASE WHEN pos > 0 AND pos < n THEN pos END), 0.5) AS gauc,
    avg(ndcg) AS ndcg, count(*) AS users, sum(n)::BIGINT AS "rows" FROM {source}{tail})"""


def replicate_mix(base: str, b: str) -> tuple[str, str]:
    """functions.replicate_mix in SQL."""
    p, low = "2147483647", f"({base} & 1073741823)"
    x = f"(({low} + {b} * 1000003) % {p})"
    y = f"(({x} * {x} + ({base} >> 30)) % {p})"
    return y, f"(({y} * {y} + {low}) % {p})"
