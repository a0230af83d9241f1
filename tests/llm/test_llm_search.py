"""Exact top-k search by cover trees, and the SQL that some queries have."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_harness import compare, duck_connection, duck_result, spark_result
from tillroll.llm import cover_tree, queries

SF = "/root/testdata/sf0.01"


def check_tree(x: np.ndarray, node: cover_tree.Node) -> None:
    far = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1)).max()
    assert far <= node.radius + 1e-9
    if node.children:
        assert sorted(r for c in node.children for r in c.rows) == sorted(node.rows)  # every row once
        assert any((c.centre == node.centre).all() for c in node.children)  # nesting
        centres = np.array([c.centre for c in node.children])
        gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
        reach = [node.radius * 0.5 ** (0.5**i) for i in range(cover_tree.STEPS)]  # covering and separation, by one radius
        assert any(max(c.radius for c in node.children) <= r + 1e-9 and gaps.min() > r - 1e-9 for r in reach)
    else:
        assert len(node.rows) <= 4 or node.radius == 0
    for c in node.children:
        check_tree(x, c)


@pytest.mark.parametrize("dims,n", [(2, 500), (16, 400), (1, 300), (256, 700)])
def test_cover_tree_invariants(dims, n):
    rnd = np.random.default_rng(dims)
    x = np.floor(rnd.normal(size=(n, dims)) * 40)
    x[: n // 4] = x[0]  # many equal rows
    tree = cover_tree.cover_tree(x, leaf=4)
    assert tree.children
    check_tree(x, tree)


def test_rows_all_equally_far_are_divided_too():
    x = np.eye(100) * 8  # no factor tells them apart into a few groups
    tree = cover_tree.cover_tree(x, leaf=4)
    assert len(tree.children) == 100
    check_tree(x, tree)


def test_clustered_vectors_are_pruned():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16)) * 400
    x = np.floor(centres[rnd.integers(0, 40, 6000)] + rnd.normal(size=(6000, 16)) * 4)
    ids = np.arange(6000)
    ask = np.flatnonzero(ids % 50 == 0)
    found, compared = cover_tree.dual_search(x[ask], ids[ask], np.full(len(ask), -np.inf), x, ids, 5)
    assert compared < len(ask) * len(x) / 4
    best = {}
    for q, i, s in found:
        best.setdefault(q, []).append((-s, i))
    for q in ask.tolist():
        scores = sorted((-int(s), j) for j, s in enumerate(x @ x[q]) if j != q)[:5]
        assert best[q] == scores


def test_query_parts_hold_all_queries():
    rnd = np.random.default_rng(4)
    pivots = rnd.normal(size=(50, 3))
    asking = {i: int(rnd.integers(0, 30)) for i in range(50)} | {7: 500}
    parts = cover_tree.query_parts(pivots, asking, 100)
    assert set(parts) == set(asking) and parts[7][1] == 5
    held: dict = {}
    for pivot, (first, several) in parts.items():
        for at in range(first, first + several):
            held.setdefault(at, []).append(pivot)
    assert sorted(held) == list(range(len(held)))
    assert all(sum(asking[v] for v in own) <= 100 for own in held.values() if own != [7])
    assert cover_tree.query_parts(None, {0: 3}, 100) == {0: (0, 1)}


def brute(ids: list[int], x: np.ndarray, asks, k: int) -> set:
    out = set()
    for i, a in enumerate(ids):
        if asks(a):
            got = sorted((-int(x[i] @ x[j]), b) for j, b in enumerate(ids) if b != a)[:k]
            out |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(got)}
    return out


@pytest.mark.parametrize("leaf", [1, 8, 256])
@pytest.mark.parametrize("dims,n,k", [(2, 300, 5), (32, 400, 3), (1, 50, 60)])
def test_dual_search_equals_brute_force(dims, n, k, leaf):
    rnd = np.random.default_rng(n)
    x = np.floor(rnd.normal(size=(n, dims)) * 6)  # many ties
    x[::5] = x[0]
    ids = rnd.permutation(n * 2)[:n]
    ask = np.flatnonzero(ids % 3 == 0)
    found, _ = cover_tree.dual_search(x[ask], ids[ask], np.full(len(ask), -np.inf), x, ids, k, leaf)
    rank: dict = {}
    got = set()
    for q, i, s in found:
        rank[q] = rank.get(q, 0) + 1
        got.add((q, rank[q], i, s))
    assert got == brute(ids.tolist(), x, lambda a: a % 3 == 0, k)


@pytest.mark.parametrize("block", [(8192, 4096, 2048), (40, 16, 30)])
def test_top_k_on_spark(spark, block):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 6)).round(2)
    x[:90] = x[0]
    rows = [(i, [float(v) for v in x[i]], "s") for i in range(300)]
    odd = [(1000, None, "s"), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], "s"), (1100, [float("nan")] * 6, "s"), (1150, [float("inf")] * 6, "s"), (None, [1.0] * 6, "s"), rows[7]]
    other = [(2000, [1.0, 2.0], "s"), (2001, [2.0, 1.0], "s"), (2050, [], "s")]
    df = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<double>, score string")
    got = cover_tree.top_k(df, F.col("id") % 50 == 0, 5, block_rows=block[0], query_rows=block[1], sample_rows=block[2]).collect()
    want = brute(list(range(300)), np.floor(256 * x), lambda a: a % 50 == 0, 5) | {(2000, 1, 2001, 4 * 256 * 256)}
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in got} == want
    assert len(got) == len(want)
    assert cover_tree.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_scores_beyond_doubles():
    q, p = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 1.0], [2.0**29, 5.0], [2.0**62, 0.0]])
    assert cover_tree._products(q, p).tolist() == [[2**70 + 3 if 2**70 + 3 < 2**63 else 2**63 - 1, 2**63 - 1, 2**63 - 1]]
    assert cover_tree._products(np.array([[2.0**31, 3.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**61 + 3]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duck_connection(SF)
    res = compare(spark_result(queries.queries()[name](spark, SF)), duck_result(con, queries.oracle_sql()[name]))
    assert res["ok"], res


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
