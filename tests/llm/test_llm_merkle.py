"""Merkle manifest against a plain recomputation, for trees of one and of several rounds."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_rows import EDGE, prose
from tillroll.llm import merkle, queries

COLUMNS = "doc_id long, source string, lang string, n_chars int, text string, tree string, node double"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and (before, behind) on the way up from each node."""
    ways = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, p in zip(ways, places, strict=True):
            way.append(("".join(nodes[p - p % 3 : p]), "".join(nodes[p + 1 : p - p % 3 + 3])))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        places = [p // 3 for p in places]
    return nodes[0], ways


def expected(rows: list[tuple], received) -> list[tuple]:
    by_source: dict = {}
    for doc_id, source, lang, n, text, *_ in rows:
        other = leaf_of(doc_id, source, lang, n, received(doc_id, text))
        by_source.setdefault(source, []).append((doc_id, leaf_of(doc_id, source, lang, n, text), other))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([r[1] for r in by_source[s]]))
    root, outer = tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), above in zip(order, trees, outer, strict=True):
        for (doc_id, leaf, other), way in zip(by_source[s], ways, strict=True):
            at = other
            for a, b in way + above:
                at = h(a + at + b)
            out.append((doc_id, s, leaf, subroot, root, h("".join(a + b for a, b in way + above)), at, at == root))
    return out


def same(spark, rows, received_col=None, received=lambda i, t: t, depth=merkle.DEPTH) -> None:
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = merkle.manifest(docs, received_col and received_col(docs), depth=depth)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows, received), key=str)


def rows_of(sources: list, n: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    return [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, i]), prose(rnd, 8) + "\n" * (i % 3), "t", 0.5) for i in range(n)]


def test_one_superblock_a_source(spark):
    same(spark, rows_of([None, "", "a", "é", "z", "Z", "😀", "￿"], 60, 1))


def test_hot_source_and_several_rounds(spark):
    same(spark, rows_of(["hot"] * 6 + ["b", "c", None], 200, 2), depth=1)


def test_many_sources(spark):
    same(spark, rows_of([f"s{i}" for i in range(120)], 150, 3), depth=2)


def test_lone_leaf_and_empty_table(spark):
    same(spark, [(7, "s", None, None, None, "t", 0.5)])
    same(spark, [(i, "s", None, 1, "x", "t", 0.5) for i in range(4)])
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).collect() == []


def test_edge_rows(spark):
    rows = [(i, s, None, None, t, "t", 0.5) for s in (None, "s") for i, t in EDGE]
    same(spark, rows, depth=2)


def test_damage_is_found(spark):
    rows = [(i, s, lang, n, t if i % 5 else None, x, y) for i, s, lang, n, t, x, y in rows_of(["a", "b"], 80, 4)] + [(None, "a", None, 1, "x\ny", "t", 0.5)]

    def damaged(i) -> bool:
        return i is not None and zlib.crc32(str(i).encode()) % 2 == 0

    def cut(docs):
        odd = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
        return F.when(odd, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])

    same(spark, rows, cut, lambda i, t: t.replace("\n", "") if t is not None and damaged(i) else t, depth=2)
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS), F.lit(None).cast("string")).collect()
    assert {r["verified"] for r in got if r["doc_id"] is not None and r["doc_id"] % 5} == {False}


@pytest.mark.parametrize("name", ["op11_merkle_manifest"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
