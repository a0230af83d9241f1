"""Numeric helpers that keep results engine-exact and NULL-safe under ANSI mode.

Money is summed as DECIMAL (exact) and converted to double only for the final division;
averages are ``CAST(SUM AS DOUBLE) / COUNT``; any division by zero gives NULL.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_SUM = "decimal(38,2)"
FIXED = "decimal(28,12)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def exact_avg(c: str | Column) -> Column:
    """Mean of the non-NULL values: exact sum, one double division (NULL on no rows)."""
    col = _col(c)
    return ratio(F.sum(col), F.count(col))


def fixed_avg(c: str | Column) -> Column:
    """Mean of doubles in a fixed-point sum, so that it does not depend on the order."""
    return exact_avg(_col(c).cast(FIXED))


def money_sum(c: str | Column) -> Column:
    return F.sum(_col(c)).cast(MONEY_SUM)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both sides are non-NULL.

    ``covar_pop / (stddev_pop(x) * stddev_pop(y))`` with a NULL result for a constant
    column or fewer than two rows (the built-in ``corr`` raises under ANSI mode then)."""
    xc, yc = _col(x).cast("double"), _col(y).cast("double")
    xs = F.when(yc.isNotNull(), xc)
    ys = F.when(xc.isNotNull(), yc)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long-form correlation matrix (var_x, var_y, corr) of ``columns``, computed in a
    single aggregation pass."""
    pairs = list(product(columns, columns))
    aggs = [pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    rows = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {rows}) AS (var_x, var_y, corr)")
