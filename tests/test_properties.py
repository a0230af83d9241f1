"""Property tests against independent single-machine references (numpy / Python)."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.functions.stats import pearson
from tillroll.operators.chartdata import histogram
from tillroll.operators.sequence import sequence_number

SETTINGS = settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(
    values=st.lists(st.integers(min_value=0, max_value=100), min_size=1, max_size=150),
    bins=st.sampled_from([1, 2, 4, 5, 10, 20, 25, 50]),
)
def test_histogram_matches_numpy(spark, values, bins):
    values = [0, 100] + values  # range 0..100: every bin edge is exact
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in histogram(df, "v", bins).collect()}
    counts, _ = np.histogram(np.array(values, dtype=float), bins=bins)
    want = {i: int(c) for i, c in enumerate(counts) if c}
    assert got == want


@SETTINGS
@given(
    xs=st.lists(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False), min_size=3, max_size=60),
    noise=st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False), min_size=60, max_size=60),
)
def test_pearson_matches_numpy(spark, xs, noise):
    ys = [2 * x + n for x, n in zip(xs, noise)]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    got = df.agg(pearson("x", "y").alias("c")).first()["c"]
    if np.std(xs) == 0 or np.std(ys) == 0:
        assert got is None
    else:
        assert got == pytest.approx(float(np.corrcoef(xs, ys)[0, 1]), rel=1e-6, abs=1e-9)


@SETTINGS
@given(
    keys=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6)), min_size=0, max_size=120),
    slices=st.integers(1, 9),
)
def test_sequence_matches_python(spark, keys, slices):
    rows = [(k, t, i) for i, (k, t) in enumerate(keys)]  # i makes the order total
    df = spark.createDataFrame(rows, "k long, t long, u long")
    ordered = sorted(rows)
    got = sorted((r["id"], r["u"]) for r in sequence_number(df, ["k", "t", "u"], "id", slices).collect())
    assert got == [(i + 1, row[2]) for i, row in enumerate(ordered)]


@SETTINGS
@given(values=st.lists(st.integers(0, 100), min_size=1, max_size=80), weights=st.lists(st.integers(1, 5), min_size=80, max_size=80))
def test_weighted_and_cut_histograms_keep_their_bins(spark, values, weights):
    values = [0, 100] + values
    rows = [(float(v), w) for v, w in zip(values, [1, 1, *weights])]
    df = spark.createDataFrame(rows, "v double, w long")
    whole = {r["bin"]: (r["lo"], r["hi"], r["n"]) for r in histogram(df, "v", 20, weight="w").collect()}
    counts, edges = np.histogram([v for v, _ in rows], bins=20, weights=[w for _, w in rows])
    assert {b: n for b, (_, _, n) in whole.items()} == {i: int(c) for i, c in enumerate(counts) if c}
    cut = {r["bin"]: (r["lo"], r["hi"], r["n"]) for r in histogram(df, "v", 20, weight="w", view=(10, 40)).collect()}
    assert cut == {b: x for b, x in whole.items() if 10 <= edges[b] <= 40}
