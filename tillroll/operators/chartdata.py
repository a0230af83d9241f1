"""Chart data: bounded, aggregated frames for bar, line, histogram and scatter charts.

The reduction runs on the executors; only the small result is meant for a plotting
client. Nothing here draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bar_frame(
    df: DataFrame, category: str | Column, value: str | Column, max_bars: int | None = None
) -> DataFrame:
    """(category, value). With ``max_bars`` only the largest values are kept (a top-k
    chart), ties by category."""
    out = df.select(_col(category).alias("category"), _col(value).alias("value"))
    if max_bars is None:
        return out.orderBy("category")
    return out.orderBy(F.col("value").desc_nulls_last(), F.col("category").asc_nulls_last()).limit(max_bars)


def line_frame(df: DataFrame, x: str | Column, y: str | Column) -> DataFrame:
    """(x, y) ordered by x."""
    return df.select(_col(x).alias("x"), _col(y).alias("y")).orderBy("x")


def _bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1 of ``value`` on [lo, hi]; the last bin is closed, and a
    zero-width range puts everything in bin 0."""
    width = (hi - lo) / bins
    raw = F.floor((value - lo) / width)
    return F.when(hi == lo, F.lit(0).cast("long")).otherwise(F.least(raw, F.lit(bins - 1).cast("long")))


def _with_range(data: DataFrame, cols: list[str]) -> DataFrame:
    """Attach min and max of each column as constant columns ``<c>_lo`` / ``<c>_hi``.

    The range is one aggregation over ``data``, planned as a single scalar subquery (its
    one-row result is the only thing that passes the driver; no join). Each value is
    referenced once and then carried as a column."""
    stats = data.agg(F.struct(*[x for c in cols for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]))
    r = stats.scalar()
    return data.withColumn("_range", r).select(
        *data.columns, *[F.col(f"_range.{c}_{e}").alias(f"{c}_{e}") for c in cols for e in ("lo", "hi")]
    )


def histogram(
    df: DataFrame,
    column: str | Column,
    bins: int = 10,
    value_range: tuple[float, float] | None = None,
    weight: str | Column | None = None,
    view: tuple[float | None, float | None] = (None, None),
    few: bool = False,
) -> DataFrame:
    """Equal-width histogram of a numeric column: (bin, lo, hi, n) for non-empty bins.

    The range is the column's min..max (one extra aggregation pass) unless
    ``value_range`` is given, in which case values outside it are not counted. A row counts
    ``weight`` times (once without). ``view`` cuts what is shown, not what is counted: the
    bins keep their edges, and those that begin outside it are left out. Counting is one
    aggregation on the bin index, combined map-side.

    With ``few``, for columns of few different values (whole days, results per month), rows
    are first added up by value, and the range is taken over that small frame in one task:
    the input is evaluated once. Without it, the range pass evaluates the input again."""
    x = _col(column).cast("double")
    w = F.lit(1).cast("long") if weight is None else _col(weight)
    data = df.select(x.alias("_x"), w.alias("_w")).filter(F.col("_x").isNotNull())
    if value_range is None and few:
        everything = Window.partitionBy()
        data = data.groupBy("_x").agg(F.sum("_w").alias("_w")).select(
            "_x", "_w", F.min("_x").over(everything).alias("_x_lo"), F.max("_x").over(everything).alias("_x_hi")
        )
    elif value_range is None:
        data = _with_range(data, ["_x"])
    else:
        data = data.select(
            "_x", "_w", F.lit(float(value_range[0])).alias("_x_lo"), F.lit(float(value_range[1])).alias("_x_hi")
        ).filter((F.col("_x") >= F.col("_x_lo")) & (F.col("_x") <= F.col("_x_hi")))
    lo, hi = F.col("_x_lo"), F.col("_x_hi")
    width = (hi - lo) / bins
    # the range is an aggregate too, not a key: a filter on it (the view) stays above, where
    # the bins are, and doesn't take a copy of the range's plan down to the rows
    counted = (
        data.select(_bin_index(F.col("_x"), lo, hi, bins).alias("bin"), "_x_lo", "_x_hi", "_w")
        .groupBy("bin")
        .agg(F.sum("_w").alias("n"), F.max("_x_lo").alias("_x_lo"), F.max("_x_hi").alias("_x_hi"))
    )
    shown = counted.select(
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("hi"),
        "n",
    )
    for limit, keep in ((view[0], lambda v: F.col("lo") >= v), (view[1], lambda v: F.col("lo") <= v)):
        if limit is not None:
            shown = shown.filter(keep(F.lit(float(limit))))
    return shown


def _digest(key: list[str | Column]) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(_col(k).cast("string"), F.lit("")) for k in key]))


def _smallest(points: DataFrame, n: int) -> DataFrame:
    """The (x, y) of the ``n`` rows with the smallest ``_h``.

    Rows are counted by the first four digits of ``_h`` (65,536 groups at most, combined
    map-side); the group that holds the n-th row ends the range that is read for the top n,
    so that what the last task sorts is about n rows and a 65,536th of the input, not n rows
    of every partition."""
    digits = F.substring("_h", 1, 4)
    counts = points.groupBy(digits.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b")).filter(F.col("_b") < n).agg(F.max("_g"))
    return points.filter(digits <= last.scalar()).orderBy("_h", "x", "y").limit(n).select("x", "y")


def scatter_frame(
    df: DataFrame,
    x: str | Column,
    y: str | Column,
    bins: tuple[int, int] | None = None,
    fraction: float | None = None,
    seed: int = 42,
    max_points: int | None = None,
    key: list[str | Column] | None = None,
) -> DataFrame:
    """Scatter data. Without ``bins``: the (x, y) points, for inputs known to be small,
    or a seeded Bernoulli sample of them with ``fraction`` (reproducible for a given input
    partitioning), or exactly ``max_points`` of them (all, if fewer): the rows whose ``key``
    columns have the smallest MD5 (of the values as text, joined by ``:``; null as nothing),
    ties by x and y. These are the same rows under any partitioning, and by the same rule in
    SQL. A key that names a row (the default is x and y) samples rows; rows that share their
    key come or stay away together, but for the last ones. With ``bins=(bx, by)``: a 2-D equal-width binned count
    (bin_x, bin_y, x, y, n), where x, y are bin centres; the output is bounded by
    bx * by whatever the input size."""
    xc, yc = _col(x).cast("double"), _col(y).cast("double")
    if max_points is not None:
        if bins is not None or fraction is not None:
            raise ValueError("max_points goes without bins and fraction")
        return _smallest(df.select(xc.alias("x"), yc.alias("y"), _digest(key or [xc, yc]).alias("_h")), max_points)
    pts = df.select(xc.alias("_x"), yc.alias("_y"))
    if bins is None:
        if fraction is not None:
            pts = pts.sample(withReplacement=False, fraction=fraction, seed=seed)
        return pts.select(F.col("_x").alias("x"), F.col("_y").alias("y"))
    pts = _with_range(pts.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()), ["_x", "_y"])
    bx, by = bins
    x_lo, x_hi, y_lo, y_hi = (F.col(c) for c in ("_x_lo", "_x_hi", "_y_lo", "_y_hi"))
    wx, wy = (x_hi - x_lo) / bx, (y_hi - y_lo) / by
    ranges = ["_x_lo", "_x_hi", "_y_lo", "_y_hi"]
    counted = (
        pts.select(
            _bin_index(F.col("_x"), x_lo, x_hi, bx).alias("bin_x"),
            _bin_index(F.col("_y"), y_lo, y_hi, by).alias("bin_y"),
            *ranges,
        )
        .groupBy("bin_x", "bin_y", *ranges)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "bin_x",
        "bin_y",
        F.when(x_hi == x_lo, x_lo).otherwise(x_lo + (F.col("bin_x") + 0.5) * wx).alias("x"),
        F.when(y_hi == y_lo, y_lo).otherwise(y_lo + (F.col("bin_y") + 0.5) * wy).alias("y"),
        "n",
    )
