"""Global sequence numbers without a single-task sort.

``ROW_NUMBER() OVER (ORDER BY ...)`` with no partition sends the whole table to one task.
It is built here from fixed splitters instead, in one lazy plan:

1. a sample of the order keys, drawn by their hash, gives n - 1 splitters: one sub-query,
   whose result is a constant of the plan. What is sampled depends on the rows alone, so
   every evaluation of the sub-query (a retry, or a second reader) gives the same splitters;
2. a row's slice is found by binary search among the splitters;
3. rows per slice (counted map-side, n rows) -> running offsets (a window over n rows);
4. rows are dealt by slice and numbered within it; id = offset of the slice + place.

Counts and numbering see the same slices because the splitters are the same, so nothing has
to be written in between, and building the query runs no job. The price is that the input is
evaluated four times, reading the order columns only in all but the last. The order columns must form
a total order (end with a unique key); the order is total, so even a single hot key is split
across slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE, _N, _OFF, _BOUNDS = "_seq_slice", "_seq_n", "_seq_offset", "_seq_bounds"
PER_SLICE = 64  # sampled keys per slice
_HASHES = 1 << 40  # what hashes are cut to, so that a share of them is an exact number


def _slices(df: DataFrame, num_slices: int | None) -> int:
    if num_slices:
        return num_slices
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _key(order: list[str | Column]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])


def splitters(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """One row (bounds): n - 1 order keys (fewer on few rows) that cut ``df`` into about
    equal slices, from about ``PER_SLICE * n`` sampled keys. At most a few thousand keys per
    thousand slices are gathered in one task."""
    keys = df.select(_key(order).alias("key"))
    count = keys.agg(F.count(F.lit(1))).scalar()
    share = F.lit(float(PER_SLICE * n)) / F.greatest(count, F.lit(1)) * _HASHES
    sample = keys.filter(F.pmod(F.xxhash64("key"), F.lit(_HASHES)) < share)
    taken = sample.agg(F.array_sort(F.collect_list("key")).alias("s"))
    size = F.size("s")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(max(n - 1, 1))), lambda i: F.get("s", F.floor(i * size / n).cast("int")))
    return taken.select(F.when((size > 0) & F.lit(n > 1), F.array_compact(cuts)).otherwise(F.slice("s", 1, 0)).alias("bounds"))


def slice_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``: its slice, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(bounds, mid) <= key
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), step)["lo"]


def sequence_number(
    df: DataFrame,
    order: list[str | Column],
    id_col: str = "id",
    num_slices: int | None = None,
) -> DataFrame:
    """Add ``id_col`` = 1..n in the (ascending, nulls first) order of ``order``."""
    n = _slices(df, num_slices)
    bounded = df.withColumn(_BOUNDS, splitters(df, order, n).scalar())
    tagged = bounded.withColumn(_SLICE, slice_of(_key(order), F.col(_BOUNDS), n)).drop(_BOUNDS)
    sizes = tagged.groupBy(_SLICE).agg(F.count(F.lit(1)).alias(_N))
    # one row per slice: bounded by n, so the window and the broadcast are small
    before = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_SLICE, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    place = F.row_number().over(Window.partitionBy(_SLICE).orderBy(*order))
    return (
        tagged.repartitionById(n, F.col(_SLICE))
        .withColumn(_N, place)
        .join(F.broadcast(offsets), _SLICE)
        .withColumn(id_col, (F.col(_OFF) + F.col(_N)).cast("long"))
        .drop(_SLICE, _N, _OFF)
    )
