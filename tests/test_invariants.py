"""Invariants and brute-force checks of the operators that replace naive plans."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, d, m, make_panel
from oracle_harness import duck_connection
from tillroll.operators import gaps, loyalty, private_label
from tillroll.operators.sequence import sequence_number, slice_of, splitters
from tillroll.plans.catalog import P
from tillroll.plans.inspect import plan_text, single_partition_children
from tillroll.sources.panel import panel_from_tpch


def _skewed(spark, n=3000, seed=7):
    """Rows (k, t, u): key 0 holds a third of all rows; t has many ties; u is unique."""
    rnd = random.Random(seed)
    data = []
    for u in range(n):
        k = 0 if u % 3 == 0 else rnd.randint(1, 200)
        data.append((k, rnd.randint(0, 50), u))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k long, t int, u long").repartition(5)


@pytest.mark.parametrize("slices", [1, 3, 8, 17])
def test_sequence_number_equals_row_number(spark, slices):
    df = _skewed(spark)
    got = sequence_number(df, ["k", "t", "u"], "id", num_slices=slices)
    want = df.withColumn("id", F.row_number().over(Window.orderBy("k", "t", "u")).cast("long"))
    assert sorted(map(tuple, got.select("k", "t", "u", "id").collect())) == sorted(
        map(tuple, want.select("k", "t", "u", "id").collect())
    )
    ids = [r["id"] for r in got.select("id").collect()]
    assert sorted(ids) == list(range(1, df.count() + 1))


def test_pairs_and_gaps_equal_lead(spark):
    """A hot household, many trips on a day, and rows without a household, date or id."""
    rnd = random.Random(11)
    trips = [
        (i, None if i % 97 == 0 else (0 if i % 3 == 0 else rnd.randint(1, 60)),
         None if i % 89 == 0 else d(f"2004-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"), "R", m(1))
        for i in range(2500)
    ] + [(None, 1, d("2004-01-01"), "R", m(1))]
    t = make_panel(spark, trips=trips).trips
    got = sorted((r["tc_id_0"], r["tc_id_1"], r["time_window"]) for r in gaps.next_trip_pairs(t, 2004).collect())
    placed = sorted((r[1], r[2], r[0]) for r in trips if None not in r[:3])
    want = sorted((a[2], b[2], (b[1] - a[1]).days) for a, b in zip(placed, placed[1:]) if a[0] == b[0])
    assert got == want
    by_hh: dict = {}
    for a, b in zip(placed, placed[1:]):
        if a[0] == b[0]:
            by_hh.setdefault(a[0], []).append((b[1] - a[1]).days)
    counted: dict = {}
    for r in gaps.household_gaps(t, 2004).collect():
        counted.setdefault(r["hh_id"], []).extend([r["time_window"]] * r["n"])
    assert {h: sorted(g) for h, g in counted.items()} == {h: sorted(g) for h, g in by_hh.items()}
    avg = {r["household"]: r["days"] for r in gaps.avg_gap_per_household(t, 2004).collect()}
    assert avg == {h: sum(g) / len(g) for h, g in by_hh.items()}


@pytest.mark.parametrize("single,pair", [(80, 80), (50, 60), (100, 99), (0, -10), (33, 66.5)])
def test_loyal_households_equal_all_pairs(spark, single, pair):
    """Ties, NULL retailers, refunds (negative and zero totals)."""
    rnd = random.Random(5)
    trips = []
    for i in range(1500):
        spend = rnd.choice([10, 10, 20, 35, -5, 0, rnd.randint(1, 90)])
        trips.append((i, rnd.randint(1, 150), d("2004-01-01"), rnd.choice(["A", "B", "C", "D", None]), m(spend)))
    share = loyalty.retailer_share(make_panel(spark, trips=trips).trips, 12).cache()
    got = sorted(map(tuple, loyalty.loyal_households(share, single, pair).collect()))
    one = loyalty.loyal_single(share, single).select(F.lit("single"), "hh_id")
    two = loyalty.loyal_pair(share, pair).select(F.lit("pair"), "hh_id")
    assert got == sorted(map(tuple, one.union(two).distinct().collect()))
    share.unpersist()


def test_sequence_plan_has_no_single_partition_on_rows(spark):
    df = _skewed(spark)
    numbered = sequence_number(df, ["k", "t", "u"], "id", num_slices=4)
    # counts and numbering cut the rows at the same splitters: sub-queries of one plan
    assert "rangepartitioning" not in plan_text(numbered).lower()
    children = single_partition_children(numbered)
    # the only single-task step is the running offset over the per-slice counts
    assert children and all("Aggregate" in c for c in children)


def _random_share_trips(seed: int, households: int = 60):
    rnd = random.Random(seed)
    trips, tc = [], 0
    for hh in range(households):
        retailers = rnd.sample(["A", "B", "C", "D", "E", "F", "G"], rnd.randint(1, 7))
        for r in retailers:
            for _ in range(rnd.randint(1, 3)):
                tc += 1
                amount = rnd.choice([rnd.randint(0, 500), rnd.randint(0, 20), 250])
                trips.append((tc, hh, d("2004-03-01"), r, m(amount)))
    return trips


@pytest.mark.parametrize("seed,threshold", [(1, 80), (2, 60), (3, 50), (4, 95), (5, 30)])
def test_loyal_pair_equals_all_pairs(spark, seed, threshold):
    p = make_panel(spark, trips=_random_share_trips(seed))
    share = loyalty.retailer_share(p.trips, 12)
    got = loyalty.loyal_pair(share, threshold)
    a, b = share.alias("a"), share.alias("b")
    both = F.col("a.avg_spent_per_retailer") + F.col("b.avg_spent_per_retailer")
    brute = (
        a.join(b, (F.col("a.hh_id") == F.col("b.hh_id")) & (F.col("a.tc_retailer_code") < F.col("b.tc_retailer_code")))
        .select(
            F.col("a.hh_id").alias("hh_id"),
            F.col("a.tc_retailer_code").alias("retailer_1"),
            F.col("b.tc_retailer_code").alias("retailer_2"),
            (F.try_divide(both, F.col("a.avg_spent")) * 100).alias("pct"),
        )
        .filter(F.col("pct") > threshold)
    )
    key = ["hh_id", "retailer_1", "retailer_2"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, brute.select(*key).collect()))


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_gap_invariants_on_driver_tables(spark):
    panel = panel_from_tpch(spark, SF_SMALL)
    pairs = gaps.next_trip_pairs(panel.trips, P.year)
    trips_y = panel.trips.filter(F.year("tc_date") == P.year)
    # every trip except each household's last one starts exactly one pair
    n_trips = trips_y.count()
    n_households = trips_y.select("hh_id").distinct().count()
    assert pairs.count() == n_trips - n_households
    assert pairs.filter(F.col("time_window") < 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_income_study_equals_literal_per_band_sql(spark):
    """The one-pass study equals a literal per-band transcription (a total query and a
    private-label query per band, joined on the year-month, then averaged)."""
    panel = panel_from_tpch(spark, SF_SMALL)
    bm = private_label.private_label_share_by_income_month(
        panel.households, panel.trips, panel.purchases, panel.products, P.brand, "regex"
    )
    got = {r["band"]: r for r in private_label.private_label_by_income(bm).collect()}
    con = duck_connection(SF_SMALL)
    for band, cond in (("low", "BETWEEN 3 AND 15"), ("mid", "BETWEEN 16 AND 21"), ("high", "> 21")):
        sql = f"""
        WITH band_trips AS (
            SELECT o.o_orderkey AS tc_id, strftime(CAST(o.o_orderdate AS DATE), '%Y-%m') AS ym
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            WHERE CAST(FLOOR((c.c_acctbal + 1000) / 440) + 3 AS INTEGER) {cond}),
        line_paid AS (
            SELECT l_orderkey AS tc_id, l_partkey AS prod_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS paid
            FROM lineitem),
        all_spend AS (
            SELECT bt.ym, SUM(lp.paid) AS spend FROM band_trips bt JOIN line_paid lp ON bt.tc_id = lp.tc_id
            GROUP BY bt.ym),
        own_brand_spend AS (
            SELECT bt.ym, SUM(lp.paid) AS spend
            FROM band_trips bt JOIN line_paid lp ON bt.tc_id = lp.tc_id
            JOIN part p ON p.p_partkey = lp.prod_id AND regexp_matches(p.p_brand, '{P.brand}')
            GROUP BY bt.ym)
        SELECT AVG(t.spend), AVG(o.spend), SUM(o.spend) / SUM(t.spend), COUNT(*)
        FROM all_spend t JOIN own_brand_spend o ON t.ym = o.ym"""
        avg_total, avg_private, ratio, months = con.execute(sql).fetchall()[0]
        r = got[band]
        assert r["months"] == months
        assert r["avg_total"] == pytest.approx(float(avg_total), rel=1e-12)
        assert r["avg_private"] == pytest.approx(float(avg_private), rel=1e-12)
        assert r["percentage"] == pytest.approx(float(ratio), rel=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_histogram_counts_cover_input(spark):
    from tillroll.operators.chartdata import histogram

    pairs = gaps.next_trip_pairs(panel_from_tpch(spark, SF_SMALL).trips, P.year)
    h = histogram(pairs, "time_window", 500).collect()
    assert sum(r["n"] for r in h) == pairs.count()
    assert all(0 <= r["bin"] < 500 and r["lo"] <= r["hi"] for r in h)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_private_never_exceeds_total(spark):
    panel = panel_from_tpch(spark, SF_SMALL)
    bm = private_label.private_label_share_by_income_month(
        panel.households, panel.trips, panel.purchases, panel.products, P.brand, "regex"
    )
    assert bm.filter((F.col("private") > F.col("total")) | (F.col("percentage") > 1)).count() == 0
    mon = private_label.monthly_private_label_spend(panel.trips, panel.purchases, panel.products, P.year, P.brand)
    assert mon.filter(F.col("pl_prods") > F.col("all_prods")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_ordered_pairs_are_twice_the_unordered(spark):
    panel = panel_from_tpch(spark, SF_SMALL)
    active = loyalty.monthly_active_households(panel.trips, P.min_months)
    share = loyalty.retailer_share(loyalty.monthly_active_trips(panel.trips, active), P.months)
    unordered = loyalty.loyal_pair(share, P.pair_threshold)
    ordered = loyalty.loyal_pair(share, P.pair_threshold, both_orders=True)
    n = unordered.count()
    assert n > 0 and ordered.count() == 2 * n
    assert ordered.filter(F.col("retailer_1") > F.col("retailer_2")).count() == n


def test_one_pass_share_equals_step_by_step(spark):
    extra = [
        (900, 7, None, "R1", m(5)),  # undated trip of an active household: spend counts
        (901, None, d("2004-05-01"), "R1", m(5)),  # no household
        (902, 8, None, "R2", m(5)),  # household with undated trips only: never active
    ]
    trips = [(i, 7, d(f"2004-{mm:02d}-03"), "R1" if mm % 2 else "R2", m(10 + mm)) for i, mm in enumerate(range(1, 13))]
    for panel in (make_panel(spark, trips=trips + extra), panel_from_tpch(spark, SF_SMALL)):
        for min_months in (1, 8, 12):
            active = loyalty.monthly_active_households(panel.trips, min_months)
            want = loyalty.retailer_share(loyalty.monthly_active_trips(panel.trips, active), 12)
            got = loyalty.active_retailer_share(panel.trips, min_months, 12)
            at = loyalty.monthly_active_trips(panel.trips, active)
            for g, w in (
                (got, want),
                (loyalty.active_household_avg_spend(panel.trips, min_months, 12), at.groupBy("hh_id").agg((F.sum("tc_total_spent").cast("double") / 12).alias("avg_spent"))),
                (
                    loyalty.active_household_retailer_avg_spend(panel.trips, min_months, 12),
                    at.groupBy("hh_id", "tc_retailer_code").agg(
                        (F.sum("tc_total_spent").cast("double") / 12).alias("avg_spent_per_retailer")
                    ),
                ),
            ):
                cols = w.columns
                assert sorted(map(tuple, g.select(*cols).collect()), key=str) == sorted(
                    map(tuple, w.select(*cols).collect()), key=str
                )


def test_one_pass_items_and_trips_equals_join(spark):
    from tillroll.operators import monthly

    households = [(1, 5, "CA"), (2, 5, "NY")]
    trips = [
        (1, 1, d("2004-01-03"), "R", m(1)), (2, 1, d("2004-01-20"), "R", m(1)),  # trip 2: no purchases
        (3, 2, d("2004-02-05"), "R", m(1)),  # February: trips but no purchases at all
        (4, 3, d("2004-01-05"), "R", m(1)), (5, 1, d("2004-03-01"), "R", m(1)),
    ]
    purchases = [(1, 1, 2, m(1), 0), (1, 2, 5, m(1), 0), (4, 1, 9, m(1), 0), (5, 1, None, m(1), 0)]
    for panel, year in ((make_panel(spark, households, [], trips, purchases), 2004),
                        (panel_from_tpch(spark, SF_SMALL), P.year)):
        want = monthly.avg_trips_by_month(panel.trips, panel.households, year).join(
            monthly.avg_items_by_month(panel.trips, panel.households, panel.purchases, year), "month"
        )
        got = monthly.monthly_items_and_trips(panel.trips, panel.households, panel.purchases, year)
        cols = ["month", "num_items", "num_trips"]
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(
            map(tuple, want.select(*cols).collect()), key=str
        )


def test_private_label_answers_do_not_depend_on_broadcasts(spark):
    from test_fixtures import PL_HOUSEHOLDS, PL_PRODUCTS, PL_PURCHASES, PL_TRIPS

    cases = [
        (make_panel(spark, PL_HOUSEHOLDS, PL_PRODUCTS, PL_TRIPS, PL_PURCHASES), 2004, "CTL BR"),
        (panel_from_tpch(spark, SF_SMALL), P.year, P.brand),
    ]
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for panel, year, brand in cases:
        answers = []
        for limit in ("10MB", "-1"):
            for k in keys:
                spark.conf.set(k, limit)
            try:
                mon = private_label.monthly_private_label_spend(panel.trips, panel.purchases, panel.products, year, brand)
                bm = private_label.private_label_share_by_income_month(
                    panel.households, panel.trips, panel.purchases, panel.products, brand
                )
                answers.append((sorted(map(tuple, mon.collect()), key=str), sorted(map(tuple, bm.collect()), key=str)))
            finally:
                for k in keys:
                    spark.conf.unset(k)
        assert answers[0] == answers[1]


def test_building_a_query_runs_no_job(spark):
    """The numbered trip sequences too: their splitters are a sub-query of the plan."""
    from tillroll.plans.catalog import analyses

    panel = panel_from_tpch(spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        for name, fn in analyses(P).items():
            fn(panel)
        assert not tracker.getJobIdsForGroup("build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_splitters_depend_on_the_rows_alone(spark):
    """Partitioning, and a second evaluation, change nothing; nulls come first."""
    df = _skewed(spark).unionByName(spark.createDataFrame([(None, None, 10**6 + i) for i in range(50)], "k long, t int, u long"))
    order = ["k", "t", "u"]
    first = splitters(df.repartition(1), order, 9).first()["bounds"]
    assert len(first) == 8 and first == sorted(first, key=lambda b: tuple((v is not None, v or 0) for v in b))
    for parts in (3, 11):
        assert splitters(df.repartition(parts), order, 9).first()["bounds"] == first
    got = sequence_number(df, order, "id", num_slices=9).orderBy("id").select(*order).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.orderBy(*order).collect()]
    none = sequence_number(df.where("u < 0"), order, "id", num_slices=9)
    assert none.columns == [*order, "id"] and none.collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_slice_of_is_a_search_in_the_splitters(spark, n):
    from bisect import bisect_right

    bounds = sorted({(i * 7919) % 5000 for i in range(n - 1)})
    lit = F.array(*[F.struct(F.lit(b).alias("k0")) for b in bounds]) if bounds else F.array().cast("array<struct<k0:int>>")
    df = spark.range(0, 5100, 37).select(F.col("id").cast("int").alias("v"))
    got = df.select("v", slice_of(F.struct(F.col("v").alias("k0")), lit, n).alias("s")).collect()
    assert all(r["s"] == bisect_right(bounds, r["v"]) for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables not present")
def test_sequence_numbers_are_exact_on_many_rows(spark):
    """Enough rows that a range exchange's bounds come from a genuine sample: the slice
    counts and the numbering must still agree (ids exactly 1..n in order)."""
    trips = panel_from_tpch(spark, "/root/testdata/sf0.1").trips
    for by, order in (("date", ["tc_date", "tc_id"]), ("household", ["hh_id", "tc_date", "tc_id"])):
        rows = gaps.trip_sequence(trips, P.year, by=by).collect()
        ranked = sorted(rows, key=lambda r: tuple(r[c] for c in order))
        assert [r["id"] for r in ranked] == list(range(1, len(rows) + 1)), by


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables not present")
def test_pairs_exact_on_many_rows_without_exchange_reuse(spark):
    """Pairs equal lead() per household on sf0.1, also with exchange reuse switched off
    (the numbering must not depend on two readers sharing one exchange)."""
    trips = panel_from_tpch(spark, "/root/testdata/sf0.1").trips
    w = Window.partitionBy("hh_id").orderBy("tc_date", "tc_id")
    want = sorted(
        (r["tc_id"], r["nxt"])
        for r in trips.filter(F.year("tc_date") == P.year)
        .select("tc_id", F.lead("tc_id").over(w).alias("nxt"))
        .filter(F.col("nxt").isNotNull())
        .collect()
    )
    old = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            got = sorted((r["tc_id_0"], r["tc_id_1"]) for r in gaps.next_trip_pairs(trips, P.year).collect())
            assert got == want, reuse
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
