"""Small column expressions that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c: Column | str) -> Column:
    """Null as 0."""
    return F.coalesce(col(c), F.lit(0.0))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def zero_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(col(b) == 0, 0.0).otherwise(safe_div(a, b))


def growth(now: Column, then: Column) -> Column:
    """Relative change, null where the earlier value is 0 or missing."""
    return safe_div(now - then, then)


def min_max_score(x: Column | str, low: Column | str, high: Column | str) -> Column:
    """0 to 100 between low and high; 50 where they are equal."""
    return F.when(col(high) == col(low), 50.0).otherwise(100 * (col(x) - col(low)) / F.nullif(col(high) - col(low), F.lit(0.0)))


#: Added before rounding, so that values with few binary digits do not lie on a rounding border.
SHIFT = 1.37e-9


#: Quotients by what may be nearly 0: from a size of 1000 on they are compared to one decimal.
QUOTIENTS = frozenset(("hype_reality_ratio",))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros, so that results compare across engines."""

    def one(c: str) -> Column:
        fine = F.round(F.col(c) + SHIFT, digits) + F.lit(0.0)
        return (F.when(F.abs(c) >= 1000, F.round(F.col(c) + SHIFT, 1)).otherwise(fine) if c in QUOTIENTS else fine).alias(c)

    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])
