"""Loyalty: households active every month, their spend split by retailer, and households
loyal to one retailer or to a pair of retailers, described by income and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import month_of
from tillroll.functions.stats import exact_avg, money_sum, ratio
from tillroll.operators.profile import trips_in_year
from tillroll.sources.layout import without_year
from tillroll.sources.schema import ACTIVE_MONTHS, PAIR_LOYAL_SHARE, SINGLE_LOYAL_SHARE, SPEND_MONTHS

SPENT = "tc_total_spent"
STATE_MONEY = "decimal(28,2)"  # of sums that are summed again
RETAILER = "tc_retailer_code"


def _month_bit(date_col: str = "tc_date"):
    """Bit month-1 set for a dated trip (NULL for an undated one)."""
    return F.when(F.col(date_col).isNotNull(), F.call_function("shiftleft", F.lit(1), month_of(date_col) - 1))


def monthly_active_households(trips: DataFrame, min_months: int = ACTIVE_MONTHS) -> DataFrame:
    """Households seen in at least ``min_months`` distinct calendar months (months of
    different years collapse). Output (hh_id, months).

    One aggregation: each trip sets bit month-1 of a 12-bit mask, masks are OR-ed per
    household (combined map-side, so a household with very many trips costs one small row
    per task) and the set bits are counted."""
    return (
        trips.filter(F.col("hh_id").isNotNull() & F.col("tc_date").isNotNull())
        .groupBy("hh_id")
        .agg(F.bit_count(F.bit_or(_month_bit())).cast("long").alias("months"))
        .filter(F.col("months") >= min_months)
    )


def monthly_active_trips(trips: DataFrame, active: DataFrame) -> DataFrame:
    """All trips of the given households (left-semi join: trips are never duplicated)."""
    return without_year(trips).join(active.select("hh_id"), "hh_id", "left_semi")


def _shares(per: DataFrame, months: int) -> DataFrame:
    """(hh_id, retailer, _spent[, _hh_spent]) -> the share columns."""
    household = Window.partitionBy("hh_id")
    hh_spent = F.col("_hh_spent") if "_hh_spent" in per.columns else F.sum("_spent").over(household)
    return per.select(
        "hh_id",
        RETAILER,
        ratio(F.col("_spent"), F.lit(months)).alias("avg_spent_per_retailer"),
        ratio(hh_spent, F.lit(months)).alias("avg_spent"),
    ).withColumn(
        "percentage_of_spent",
        F.try_divide(F.col("avg_spent_per_retailer"), F.col("avg_spent")) * 100,
    )


def retailer_share(active_trips: DataFrame, months: int = SPEND_MONTHS) -> DataFrame:
    """Share of each retailer in a household's spend, in percent.

    Output (hh_id, tc_retailer_code, avg_spent_per_retailer, avg_spent, percentage_of_spent).
    Trips are first reduced to one exact (DECIMAL) sum per household and retailer; the
    household total is a window sum over those few rows (one per retailer used), which
    equals the household's exact total."""
    per = active_trips.groupBy("hh_id", RETAILER).agg(F.sum(SPENT).alias("_spent"))
    return _shares(per, months)


def retailer_state(trips: DataFrame) -> DataFrame:
    """What the loyalty chain needs of the trips, per household and retailer: (hh_id,
    tc_retailer_code, spent, month_mask). ``spent`` is the exact sum; bit month-1 of
    ``month_mask`` says that there was a dated trip in that calendar month. Both add up over
    any split of the trips, so states of separate loads merge (``merge_state``)."""
    return (
        trips.filter(F.col("hh_id").isNotNull())
        .groupBy("hh_id", RETAILER)
        .agg(F.sum(SPENT).cast(STATE_MONEY).alias("spent"), F.bit_or(_month_bit()).alias("month_mask"))
    )


def merge_state(*states: DataFrame) -> DataFrame:
    """The state of all the trips whose states these are."""
    rows = states[0]
    for other in states[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("hh_id", RETAILER).agg(F.sum("spent").cast(STATE_MONEY).alias("spent"), F.bit_or("month_mask").alias("month_mask"))


def share_of_state(state: DataFrame, min_months: int = ACTIVE_MONTHS, months: int = SPEND_MONTHS) -> DataFrame:
    """``active_retailer_share`` from a state: one window per household over its few rows (one
    per retailer) gives both the household's active months and its total."""
    household = Window.partitionBy("hh_id")
    active = state.select(
        "hh_id",
        RETAILER,
        F.col("spent").alias("_spent"),
        F.sum("spent").over(household).alias("_hh_spent"),
        F.bit_count(F.bit_or("month_mask").over(household)).alias("_months"),
    ).filter(F.col("_months") >= min_months)
    return _shares(active, months)


def active_retailer_share(
    trips: DataFrame, min_months: int = ACTIVE_MONTHS, months: int = SPEND_MONTHS
) -> DataFrame:
    """``retailer_share`` of the households active in at least ``min_months`` calendar
    months, straight from all trips: equal to
    ``retailer_share(monthly_active_trips(trips, monthly_active_households(trips)))``.

    One scan and one aggregation per household and retailer (``retailer_state``, combined
    map-side), then one window per household over those few rows (``share_of_state``): no
    second scan of the trips and no semi-join of the trips against the active households."""
    return share_of_state(retailer_state(trips), min_months, months)


def active_household_avg_spend(
    trips: DataFrame, min_months: int = ACTIVE_MONTHS, months: int = SPEND_MONTHS
) -> DataFrame:
    """Total spend / ``months`` of each active household: (hh_id, avg_spent). One aggregation
    per household (spend sum and month bits together)."""
    per = (
        trips.filter(F.col("hh_id").isNotNull())
        .groupBy("hh_id")
        .agg(F.sum(SPENT).alias("_spent"), F.bit_count(F.bit_or(_month_bit())).alias("_months"))
    )
    return per.filter(F.col("_months") >= min_months).select(
        "hh_id", ratio(F.col("_spent"), F.lit(months)).alias("avg_spent")
    )


def active_household_retailer_avg_spend(
    trips: DataFrame, min_months: int = ACTIVE_MONTHS, months: int = SPEND_MONTHS
) -> DataFrame:
    """Spend / ``months`` per active household and retailer (see ``active_retailer_share``)."""
    return active_retailer_share(trips, min_months, months).select("hh_id", RETAILER, "avg_spent_per_retailer")


def loyal_single(share: DataFrame, threshold: float = SINGLE_LOYAL_SHARE) -> DataFrame:
    """Household-retailer rows with a share of at least ``threshold`` percent."""
    return share.filter(F.col("percentage_of_spent") >= threshold)


def loyal_pair(share: DataFrame, threshold: float = PAIR_LOYAL_SHARE, both_orders: bool = False) -> DataFrame:
    """Pairs of different retailers of one household whose shares together exceed
    ``threshold`` percent. Output (hh_id, retailer_1, retailer_2, avg_spent_1, avg_spent_2,
    avg_spent_both, percentage_of_spent) with retailer_1 < retailer_2; with
    ``both_orders`` each pair is also listed the other way round (the literal reading of
    a self-join on "different retailer").

    Output-sensitive, without listing all pairs of a household. Rank the household's
    retailers by share (descending). For retailer i the qualifying partners are those with
    share > threshold - share_i: a prefix of the ranking, whose length k_i comes from one
    sorted pass over the retailers and the thresholds together (a running count). Each
    unordered pair is produced once, at its lower-ranked member, by expanding ranks
    1..min(k_i, rank_i - 1); only qualifying pairs (plus those within a rounding margin of
    the threshold) are produced, and the exact test below decides them. The windows hold a
    household's retailers (one row each). A threshold near or below 0 qualifies every pair.
    """
    s = share.filter(F.col("percentage_of_spent").isNotNull()).select(
        "hh_id",
        F.col(RETAILER).alias("_r"),
        F.col("avg_spent_per_retailer").alias("_a"),
        F.col("avg_spent").alias("_total"),
        F.col("percentage_of_spent").alias("_p"),
    )
    by_share = Window.partitionBy("hh_id").orderBy(F.col("_p").desc(), F.col("_r").asc_nulls_last())
    ranked = s.withColumn("_rank", F.row_number().over(by_share))

    margin = 1e-9 * (1 + F.abs(F.col("_p")) + abs(threshold))
    # one pass over the ranking emits, per retailer, its share (kind 1) and its threshold
    # (kind 0); threshold rows carry retailer i's attributes, so no join back for i
    point = F.struct(
        F.col("_p").alias("_v"), F.lit(1).alias("_kind"),
        F.lit(None).cast("string").alias("_r"), F.lit(None).cast("double").alias("_a"),
        F.lit(None).cast("double").alias("_total"),
    )
    query = F.struct(
        (F.lit(threshold) - F.col("_p") - margin).alias("_v"), F.lit(0).alias("_kind"),
        F.col("_r").alias("_r"), F.col("_a").alias("_a"), F.col("_total").alias("_total"),
    )
    rows = ranked.select("hh_id", "_rank", F.explode(F.array(point, query)).alias("_e")).select(
        "hh_id", "_rank", "_e.*"
    )
    # Sorted by value descending; at equal values a threshold sorts before the shares
    # (the test is strict), so the running count of shares is the prefix length k_i.
    running = (
        Window.partitionBy("hh_id")
        .orderBy(F.col("_v").desc(), F.col("_kind").asc(), F.col("_rank").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    prefix = (
        rows.withColumn("_k", F.sum("_kind").over(running))
        .filter(F.col("_kind") == 0)
        .withColumn("_m", F.least(F.col("_k"), F.col("_rank") - 1))
        .filter(F.col("_m") >= 1)
    )
    pairs = prefix.select(
        "hh_id",
        F.col("_r").alias("_ri"),
        F.col("_a").alias("_ai"),
        "_total",
        F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_rank_j"),
    ).join(
        ranked.select("hh_id", F.col("_rank").alias("_rank_j"), F.col("_r").alias("_rj"), F.col("_a").alias("_aj")),
        ["hh_id", "_rank_j"],
    )
    first = F.col("_ri") < F.col("_rj")
    a1 = F.when(first, F.col("_ai")).otherwise(F.col("_aj"))
    a2 = F.when(first, F.col("_aj")).otherwise(F.col("_ai"))
    both = a1 + a2
    pct = F.try_divide(both, F.col("_total")) * 100
    out = pairs.filter(F.col("_ri") != F.col("_rj")).select(
        "hh_id",
        F.least("_ri", "_rj").alias("retailer_1"),
        F.greatest("_ri", "_rj").alias("retailer_2"),
        a1.alias("avg_spent_1"),
        a2.alias("avg_spent_2"),
        both.alias("avg_spent_both"),
        pct.alias("percentage_of_spent"),
    ).filter(F.col("percentage_of_spent") > threshold)
    if not both_orders:
        return out
    cols = ["retailer_1", "retailer_2", "avg_spent_1", "avg_spent_2"]
    as_is = F.struct(*[F.col(c).alias(c) for c in cols])
    swapped = F.struct(*[F.col(c).alias(t) for c, t in zip(["retailer_2", "retailer_1", "avg_spent_2", "avg_spent_1"], cols)])
    return out.select(
        "hh_id", F.explode(F.array(as_is, swapped)).alias("_o"), "avg_spent_both", "percentage_of_spent"
    ).select("hh_id", *[f"_o.{c}" for c in cols], "avg_spent_both", "percentage_of_spent")


def loyal_households(
    share: DataFrame, single_threshold: float = SINGLE_LOYAL_SHARE, pair_threshold: float = PAIR_LOYAL_SHARE
) -> DataFrame:
    """Distinct loyal households by kind: (kind, hh_id), kind in {single, pair}.

    A household is loyal to a single retailer when its largest share reaches
    ``single_threshold``, and to a pair when the two largest shares of different known
    retailers together exceed ``pair_threshold``: one aggregation of its few share rows (one
    per retailer it uses, already together from the share itself), no pairs."""
    p, a = F.col("percentage_of_spent"), F.col("avg_spent_per_retailer")
    known = F.when(F.col(RETAILER).isNotNull() & p.isNotNull(), F.struct(p.alias("p"), a.alias("a")))
    top = F.slice(F.sort_array(F.collect_list(known), asc=False), 1, 2)
    per = share.groupBy("hh_id").agg(F.max(p).alias("_best"), F.max("avg_spent").alias("_total"), top.alias("_top"))
    both = F.try_divide(F.col("_top")[0]["a"] + F.col("_top")[1]["a"], F.col("_total")) * 100
    kinds = F.array(
        F.when(F.col("_best") >= single_threshold, F.lit("single")),
        F.when((F.size("_top") == 2) & (both > pair_threshold), F.lit("pair")),
    )
    return per.select(F.explode(F.array_compact(kinds)).alias("kind"), "hh_id")


def loyal_household_income(loyal: DataFrame, households: DataFrame) -> DataFrame:
    return loyal.join(households.select("hh_id", "hh_income"), "hh_id", "left").select(
        "kind", "hh_id", "hh_income"
    )


def loyal_household_state(loyal: DataFrame, households: DataFrame) -> DataFrame:
    return loyal.join(households.select("hh_id", "hh_state"), "hh_id", "left").select(
        "kind", "hh_id", "hh_state"
    )


def loyal_income_comparison(loyal: DataFrame, households: DataFrame, kind: str = "pair") -> DataFrame:
    """Are loyal households richer or poorer? Household count and mean income code of
    the loyal households of ``kind`` against all other households: (segment, n, avg_income)."""
    flags = loyal.filter(F.col("kind") == kind).select("hh_id", F.lit(True).alias("_loyal"))
    labelled = households.join(flags, "hh_id", "left").select(
        F.when(F.col("_loyal"), F.lit("loyal")).otherwise(F.lit("other")).alias("segment"),
        "hh_income",
    )
    return labelled.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), exact_avg("hh_income").alias("avg_income")
    )


def top_retailer_by_spend(trips: DataFrame, year: int | None = None, k: int = 1) -> DataFrame:
    """The ``k`` retailers with the largest total spend (ties by retailer code)."""
    return (
        trips_in_year(trips, year)
        .groupBy(RETAILER)
        .agg(money_sum(SPENT).alias("total_spent"))
        .orderBy(F.col("total_spent").desc_nulls_last(), F.col(RETAILER).asc_nulls_last())
        .limit(k)
    )


def loyalists_by_retailer(single: DataFrame) -> DataFrame:
    """Single-retailer loyal households per retailer: (tc_retailer_code, households)."""
    return single.groupBy(RETAILER).agg(F.countDistinct("hh_id").alias("households"))


def top_loyalist_retailer(loyalists: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` retailers with the most single-retailer loyal households (ties by code)."""
    return loyalists.orderBy(F.col("households").desc(), F.col(RETAILER).asc_nulls_last()).limit(k)


def loyal_state_distribution(loyal_states: DataFrame) -> DataFrame:
    """Loyal households per state and kind: (kind, hh_state, n)."""
    return loyal_states.groupBy("kind", "hh_state").agg(F.count(F.lit(1)).alias("n"))
