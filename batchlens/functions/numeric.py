"""Numeric column helpers.

NULL contract: NaN and +-Inf are turned into NULL when data enters an operator;
every helper here keeps NULL as NULL (unlike ``greatest``/``least`` which skip
NULLs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchlens.constants import ISCLOSE_ATOL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def to_double(x) -> Column:
    """Lenient numeric coercion: unparsable -> NULL, NaN/Inf -> NULL."""
    c = _c(x)
    return nan_to_null(c.try_cast("double"))


def clip_keep_null(x, lower=None, upper=None) -> Column:
    c = _c(x)
    out = c
    if lower is not None:
        out = F.greatest(out, _lit(lower))
    if upper is not None:
        out = F.least(out, _lit(upper))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out)


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def rint_dp(x, dp: int = 2) -> Column:
    """Round half-to-even at ``dp`` decimals the numpy way: rint(x * 10^dp) / 10^dp."""
    scale = float(10 ** dp)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def isclose0(x) -> Column:
    """|x| <= 1e-8 (numpy isclose against 0.0 with default tolerances)."""
    return F.abs(_c(x)) <= F.lit(ISCLOSE_ATOL)


def norm_expr(x, lo, hi, invert: bool = False, all_null_half: bool = True) -> Column:
    """Min-max normalisation given whole-table ``lo``/``hi`` (floats, or columns).

    Constant column -> 0.5 for every row (NULL cells included); all-NULL column
    (lo is None) -> 0.5 when ``all_null_half`` else NULL; otherwise
    (x - lo) / (hi - lo), optionally inverted, clipped to [0, 1]; NULL cells
    stay NULL.
    """
    c = _c(x)
    if isinstance(lo, Column) or isinstance(hi, Column):
        lo_c, hi_c = _c(lo), _c(hi)
        constant = isclose0(hi_c - lo_c)
        if all_null_half:
            constant = lo_c.isNull() | constant
        scaled = (c - lo_c) / (hi_c - lo_c)
        if invert:
            scaled = F.lit(1.0) - scaled
        return F.when(constant, F.lit(0.5)).otherwise(clip_keep_null(scaled, 0.0, 1.0))
    if lo is None or hi is None:
        return F.lit(0.5) if all_null_half else F.lit(None).cast("double")
    lo, hi = float(lo), float(hi)
    if abs(hi - lo) <= ISCLOSE_ATOL:
        return F.lit(0.5)
    scaled = (c - F.lit(lo)) / F.lit(hi - lo)
    if invert:
        scaled = F.lit(1.0) - scaled
    return clip_keep_null(scaled, 0.0, 1.0)


# Exact, order-independent accumulation: each double is converted once to a
# decimal with 12 fractional digits, summed exactly, and converted back once.
# Float sums depend on the order partitions are merged in (so on partition
# count and engine); these do not.
EXACT_DECIMAL = "decimal(38,12)"


def exact_sum(x) -> Column:
    return F.sum(_c(x).cast(EXACT_DECIMAL)).cast("double")


def exact_avg(x) -> Column:
    c = _c(x)
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))
