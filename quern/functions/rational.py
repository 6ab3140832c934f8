"""Exact quantities: ``struct<num, den>`` of decimal(38,0) in lowest terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BIG = "decimal(38,0)"


def _gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 64 steps, enough for numbers below 10**13 and for all that recipes hold."""
    start = F.struct(a.cast(_BIG).alias("a"), b.cast(_BIG).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].cast(_BIG).alias("a"), (s["a"] % s["b"]).cast(_BIG).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["a"]


def rational(num: Column, den: Column) -> Column:
    """num / den in lowest terms; null for a zero denominator or a null."""
    g = _gcd(F.abs(num), F.abs(den))
    whole = lambda x: F.expr("x").cast(_BIG)  # noqa: E731, F841
    made = F.transform(F.array(F.struct(num.cast(_BIG).alias("n"), den.cast(_BIG).alias("d"), g.alias("g"))), lambda s: F.struct((s["n"] / s["g"]).cast(_BIG).alias("num"), (s["d"] / s["g"]).cast(_BIG).alias("den")))
    return F.when(den != 0, F.element_at(made, 1))


def from_token(c: Column) -> Column:
    """``1#1$2``, ``#1$2``, ``3``, ``0.25`` as a rational; null for anything else."""
    part = lambda i: F.regexp_extract(c, r"^(\d*)#(\d+)\$(\d+)$", i)
    whole = F.coalesce(part(1).try_cast(_BIG), F.lit(0))
    den = part(3).try_cast(_BIG)
    mixed = rational((whole * den + part(2).try_cast(_BIG)), den)
    digits = F.regexp_extract(c, r"^(\d*)\.?(\d*)$", 2)
    scale = F.rpad(F.lit("1"), F.length(digits) + 1, "0").try_cast(_BIG)
    plain = rational(F.replace(c, F.lit("."), F.lit("")).try_cast(_BIG), scale)
    return F.when(c.contains("#"), mixed).when(c.rlike(r"^\d+\.?\d*$|^\.\d+$"), plain)


def as_double(r: Column) -> Column:
    return r["num"].cast("double") / r["den"].cast("double")
