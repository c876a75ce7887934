"""Column helpers.  All of them stay inside JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UINT32 = 4294967296


def as_col(value) -> Column:
    """A column, a column name, or a plain number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def binary_label(raw) -> Column:
    """1 unless the raw text is exactly '0'; an empty or missing field is 1."""
    return F.when(F.coalesce(as_col(raw), F.lit("")) == "0", 0).otherwise(1)


def smoothed_rate(pos, imp, prior, fallback) -> Column:
    """Shrink pos/imp toward ``fallback`` with ``prior`` pseudo-impressions."""
    prior, fallback = as_col(prior), as_col(fallback)
    seen = F.coalesce(as_col(imp), F.lit(0))
    hits = F.coalesce(as_col(pos), F.lit(0))
    return (hits + prior * fallback) / (seen + prior)


def bucket_left(x, edges) -> Column:
    """Number of edges strictly below ``x`` (a value on an edge stays below it)."""
    x = as_col(x)
    return reduce(lambda a, b: a + b, [(F.lit(float(e)) < x).cast("int") for e in edges], F.lit(0))


def sigmoid(z) -> Column:
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), as_col(z)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softplus(z) -> Column:
    """log(1 + exp(z)) without overflow."""
    z = as_col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def is_finite(x) -> Column:
    x = as_col(x).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def hash32(*parts) -> Column:
    """A portable 32-bit hash of the joined parts, the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(*parts) -> Column:
    """Like ``hash32`` with 60 bits: so many that rows do not share draws."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform in [0, 1); depends on the row's own key, never on partitioning."""
    return hash32(*parts) / F.lit(float(_UINT32))


def hash_draw(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return hash60(*parts) % as_col(n).cast("bigint")


#: Prime modulus of the replicate mixer; squares of residues fit a bigint.
MIX_PRIME = 2147483647


def replicate_mix(base, replicate) -> tuple[Column, Column]:
    """Two pseudo-random integers in [0, MIX_PRIME) per (60-bit row hash, replicate).

    Quadratic rounds in integer arithmetic: one text hash per row serves every replicate, and all its bits take part.
    """
    p = F.lit(MIX_PRIME).cast("bigint")
    base, b = as_col(base).cast("bigint"), as_col(replicate).cast("bigint")
    high, low = F.shiftright(base, 30), base.bitwiseAND(F.lit((1 << 30) - 1))
    x = (low + b * F.lit(1000003).cast("bigint")) % p
    y = (x * x + high) % p
    return y, (y * y + low) % p


def general_format(x, digits: int = 6) -> Column:
    """printf %.6g with trailing zeros removed."""
    text = F.format_string(f"%.{digits}g", as_col(x).cast("double"))
    has_point = text.contains(".")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"0+(e|$)", "$1"), r"\.(e|$)", "$1")
    return F.when(has_point, trimmed).otherwise(text)


def topic_key(text) -> Column:
    """Trimmed, lower-cased, single-spaced text used as a lookup key."""
    return F.regexp_replace(F.lower(F.trim(as_col(text))), r"\s+", " ")


def clip_text(text, width: int = 80) -> Column:
    text = as_col(text)
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def map_mean(m) -> Column:
    """Mean of the non-null map values; null when there are none."""
    vals = F.filter(F.map_values(as_col(m)), lambda v: v.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))
