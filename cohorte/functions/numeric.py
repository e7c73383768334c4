"""Numeric expressions: NaN handling, rounding, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN becomes NULL so aggregates and quantiles skip it."""
    c = _col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def round_to(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero on the scaled binary value:
    ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the *decimal text* of the double
    (``round(1.005, 2) = 1.01``) while most engines scale first
    (``1.005 * 100 = 100.4999…`` gives 1.0). Scaling first is what SQL
    engines and the reference's numeric path agree on, so use it everywhere.
    """
    c = _col(c)
    m = float(10**digits)
    return F.round(c * F.lit(m), 0) / F.lit(m)


def safe_avg_output(c: Column | str, digits: int = 2) -> Column:
    """NaN/NULL -> 0.0, then round."""
    return round_to(F.coalesce(nan_to_null(c), F.lit(0.0)), digits)


def above_threshold(p: Column | str, threshold: float = 0.5) -> Column:
    """P10: strict ``p > threshold`` as 0/1."""
    return (_col(p) > F.lit(threshold)).cast("int")


def clip(c: Column | str, lower: float, upper: float) -> Column:
    """Winsorise; NULL stays NULL (no ``greatest/least``, which drop NULL)."""
    c = _col(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("double"))
        .when(c < F.lit(lower), F.lit(float(lower)))
        .when(c > F.lit(upper), F.lit(float(upper)))
        .otherwise(c.cast("double"))
    )


def safe_ratio(num: Column, den: Column) -> Column:
    """Division that is 0 when the denominator is 0 (A16's zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))
