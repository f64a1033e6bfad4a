"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = 1000.0


def symbol_key(c: Column | str) -> Column:
    """A gene symbol: letters in upper case and digits, nothing else; blank gives NULL."""
    k = F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{Nd}]+", "")
    return F.when(k != "", k)


def name_key(c: Column | str) -> Column:
    """A free name compared without case and surrounding white space."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")))


def lo(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def hi(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def exact_mean(c: Column) -> Column:
    """Mean to six digits, halves up, from a sum of whole billionths: the same in any order of summation."""
    v = F.sum(F.round(c * 1e9).cast("decimal(28,0)")) * 2 + F.count(c) * 1000
    m = (F.count(c) * 2000).cast("decimal(28,0)")
    v = v.cast("decimal(38,0)")
    return ((v - (v % m + m) % m) / m).cast("double") / 1e6


def valid(c: str) -> Column:
    """Neither NULL nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def hash32(text: Column) -> Column:
    """First four bytes of SHA-256, big-endian, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


#: Means of hop counts are rationals; what differs by less is rounding, which depends on the order of summation.
DUST = 9


def zscore(observed: Column, mean: Column, std: Column) -> Column:
    """(observed - mean) / std to ``DUST`` digits, and 0 where there is no null value or no spread."""
    flat = mean.isNull() | (std < 10.0**-DUST)
    return F.when(flat, F.lit(0.0)).otherwise(F.round((observed - mean) / F.nullif(std, F.lit(0.0)), DUST) + F.lit(0.0))


AGGREGATES = {"median": F.median, "mean": F.avg, "max": F.max}


def aggregate(name: str, c: Column | str) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; one of {sorted(AGGREGATES)}")
    return AGGREGATES[name](c)
