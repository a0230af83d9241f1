"""Operator 8: exact top-k inner products by dual-tree search of cover trees.

Vectors are dealt to blocks around pivots (bounded number, from a bounded sample); blocks
beyond ``block_rows`` rows are split by id, so that a block stays small whatever the data.
Each query goes to the blocks that may hold one of its k best: its k-th best score within
the sample is a floor, and pivot and radius bound what a block can offer. For each pair of
a data block and a query block one task builds a cover tree of either and walks them
together, pruning pairs of nodes by their covering radii against the worst k-th score of
the query node. The best of all blocks are then merged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import checkpointed, use_package

LEAF = 256  # rows of a node that is not divided further
FEW_CHILDREN = 64  # a level that needs more of them shrinks by less
STEPS = 7  # so often the root of a level's factor is taken
CHUNK = 2048  # rows compared at once
EXACT = 2.0**53  # sums of this size are exact in doubles


# ---- cover tree ----


class Node:
    """A node: its centre, covering radius, rows (positions) and children."""

    __slots__ = ("centre", "radius", "rows", "children")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def _cover(x: np.ndarray, rows: np.ndarray, centre: int, d: np.ndarray, reach: float, most: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Groups (centre, rows, distances) of rows within ``reach`` of centres that lie further
    apart; none if it takes more than ``most``."""
    out = []
    while len(rows):
        if len(out) == most:
            return []
        inside = d <= reach
        out.append((centre, rows[inside], d[inside]))
        rows = rows[~inside]
        if len(rows):
            centre = rows[0]
            d = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
    return out


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None, leaf: int = LEAF) -> Node:
    """The cover tree of the rows of ``x``, down to leaves of ``leaf`` rows or equal rows.

    A level shrinks the covering radius by a factor: the children of a node have centres
    further apart than the shrunken radius (separation), one of them the node's own centre
    (nesting), and each row lies within it of its child's centre (covering). The factor is a
    half; where that needs more than a few children, as in many dimensions, its root, the
    root's root and so on; where none of these will do, the node has as many children as
    a half needs."""
    rows = np.arange(len(x)) if rows is None else rows
    top = rows[0] if centre is None else centre
    d = np.sqrt(((x[rows] - x[top]) ** 2).sum(axis=1))
    root = Node(x[top], float(d.max(initial=0.0)), rows, [])
    stack = [(root, top, d)]
    while stack:
        node, own, d = stack.pop()
        if len(node.rows) <= leaf or node.radius == 0.0:
            continue
        factors = [0.5 ** (0.5**i) for i in range(STEPS)]
        groups = next(filter(None, (_cover(x, node.rows, own, d, node.radius * f, FEW_CHILDREN) for f in factors)), None)
        for c, held, near in groups or _cover(x, node.rows, own, d, node.radius / 2, len(node.rows)):
            node.children.append(Node(x[c], float(near.max(initial=0.0)), held, []))
            stack.append((node.children[-1], c, near))
    return root


# ---- dual-tree search ----


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond 64 bits are held at the limits."""
    big = np.abs(q).max(initial=0.0) * np.abs(p).max(initial=0.0) * max(1, q.shape[1])
    if big < EXACT:
        return (q @ p.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    out = whole(q) @ whole(p).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def dual_search(
    q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, leaf: int = LEAF
) -> tuple[list[tuple[int, int, int]], int]:
    """The (query id, id, score) of the up to k best rows of ``p`` for each row of ``q``, the
    row of the query's own id left out, ties to the smaller id; and the number of pairs
    that were compared. ``floors``: scores that the k best are known to reach (-inf:
    unknown); worse rows need not be found."""
    if not len(q) or not len(p):
        return [], 0
    best = np.full((len(q), k), -(2**63), np.int64)
    ids = np.full((len(q), k), 2**63 - 1, np.int64)
    found = np.zeros(len(q), np.int64)
    worst = floors.astype(float).copy()
    size = np.sqrt((q**2).sum(axis=1))
    compared = 0

    def compare(a: Node, b: Node) -> None:
        rows = b.rows
        if b.radius == 0.0 and len(rows) > k + 1:  # equal rows: the smallest ids win
            rows = rows[np.argsort(p_ids[rows], kind="stable")[: k + 1]]
        far = np.sqrt(b.centre @ b.centre) + b.radius
        for at in range(0, len(rows), CHUNK):
            # of the queries, those whose own worst score the node may still beat
            top = q[a.rows] @ b.centre + size[a.rows] * b.radius + 1e-9 * size[a.rows] * far + 1e-9
            asking = a.rows[top >= worst[a.rows]]
            if len(asking):
                take(asking, rows[at : at + CHUNK])

    def take(asking: np.ndarray, rows: np.ndarray) -> None:
        nonlocal compared
        compared += len(asking) * len(rows)
        scores = _products(q[asking], p[rows])
        good = (scores >= worst[asking][:, None]) & (p_ids[rows][None, :] != q_ids[asking][:, None])
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            r, ok = asking[i], good[i]
            s_all, i_all = np.r_[best[r, : found[r]], scores[i][ok]], np.r_[ids[r, : found[r]], p_ids[rows[ok]]]
            pick = np.lexsort((i_all, -s_all.astype(object) if s_all.min() == -(2**63) else -s_all))[:k]
            n = len(pick)
            best[r, :n], ids[r, :n], found[r] = s_all[pick], i_all[pick], n
            if n == k:
                worst[r] = max(worst[r], float(best[r, -1]))

    def bounds(a: Node, below: list[Node]) -> np.ndarray:
        """For each of the nodes: no row of it and row of ``a`` have a larger product."""
        c, r = np.array([b.centre for b in below]), np.array([b.radius for b in below])
        ca, cb = np.sqrt(a.centre @ a.centre), np.sqrt((c**2).sum(axis=1))
        return c @ a.centre + a.radius * cb + r * ca + a.radius * r + 1e-9 * (ca + a.radius) * (cb + r) + 1e-9  # rounding

    def joined(node: Node, leaves: list[Node]) -> list[Node]:
        """The leaves of a query node as one, within the node's own ball: walked at once, since
        each query has its own bound where rows are compared."""
        if len(leaves) < 2:
            return leaves
        return [Node(node.centre, node.radius, np.concatenate([c.rows for c in leaves]), [])]

    qt, pt = cover_tree(q, leaf=leaf), cover_tree(p, leaf=leaf)
    stack = [(qt, pt, float(bounds(qt, [pt])[0]))]
    while stack:
        a, b, top = stack.pop()
        floor = worst[a.rows].min()
        if top < floor:
            continue
        if not a.children and not b.children:
            compare(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            pairs = zip(b.children, bounds(a, b.children).tolist(), strict=True)
            stack += sorted(((a, c, t) for c, t in pairs if t >= floor), key=lambda x: x[2])  # the most promising is walked first
        else:
            below = [c for c in a.children if c.children] + joined(a, [c for c in a.children if not c.children])
            stack += [(c, b, t) for c, t in zip(below, bounds(b, below).tolist(), strict=True)]
    return [(int(q_ids[r]), int(ids[r, j]), int(best[r, j])) for r in range(len(q)) for j in range(found[r])], compared


# ---- on Spark ----


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, dims, vec): floor(scale * x) of each vector as little-endian doubles; rows whose
    id or vector is null, or that hold a null or non-finite component, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs = [], [], []
            for key, v in zip(batch.column("id").to_pylist(), batch.column("vec"), strict=True):
                if key is None or not v.is_valid:
                    continue
                a = v.values.cast(pa.float64())
                if a.null_count:
                    continue
                a = a.to_numpy(zero_copy_only=False)
                if np.isfinite(a).all():
                    ids.append(key)
                    dims.append(len(a))
                    vecs.append(np.floor(a * scale).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["id", "dims", "vec"])

    return rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].alias("vec")).mapInArrow(run, "id long, dims int, vec binary")


def _matrix(vecs: pd.Series | list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f8").reshape(len(vecs), dims)


def top_k(
    rows: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = 8192, query_rows: int = 4096, sample_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k highest inner products with
    every other row, ties to the smaller id; fewer where there are fewer rows.

    ``is_query`` is a condition on a column named ``id``. Components are floor(scale * x) in
    doubles. Rows whose id or vector is null or holds a null or non-finite component take no
    part; only vectors of equal length are compared. Rows with the id of the query are left
    out; identical rows that repeat an id count once. Scores beyond 64 bits are held at the
    limits. An empty table gives an empty result. Block and sample sizes steer the work and
    its memory, not the result."""
    spark = rows.sparkSession
    use_package(spark)
    vectors = checkpointed(whole_vectors(rows, id_col, vector_col, scale))
    counts = {r["dims"]: r["n"] for r in vectors.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = min(1.0, sample_rows / max(1, total))
    taken = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))
    # the sample is bounded by sample_rows (but for the chance of a hash)
    sample: dict[int, list[tuple[int, bytes]]] = {}
    for r in vectors.where(taken).dropDuplicates(["id", "vec"]).limit(2 * sample_rows).collect():
        sample.setdefault(r["dims"], []).append((r["id"], bytes(r["vec"])))
    pivots: dict[int, np.ndarray] = {}
    for d, got in sample.items():
        distinct = sorted({v for _, v in got}, key=lambda v: hash_bytes(v))
        pivots[d] = _matrix(distinct[: max(1, min(len(distinct), counts[d] // block_rows))], d)
    sent = spark.sparkContext.broadcast((pivots, {d: (np.array([i for i, _ in got]), _matrix([v for _, v in got], d)) for d, got in sample.items()}))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, dist = [], []
            for d, v in zip(batch.column("dims").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                c = sent.value[0].get(d)
                if c is None:
                    near.append(0)
                    dist.append(float("inf"))
                    continue
                gap = ((c - np.frombuffer(v, "<f8")) ** 2).sum(axis=1)
                near.append(int(np.argmin(gap)))
                dist.append(float(np.sqrt(gap[near[-1]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(dist, pa.float64())], names=["id", "dims", "vec", "pivot", "dist"])

    placed = vectors.mapInArrow(assign, "id long, dims int, vec binary, pivot int, dist double")
    # a row for each pivot, of which there are sample_rows at most
    areas: dict[int, list[tuple[int, float, int]]] = {}
    asking: dict[int, dict[int, int]] = {}
    counted = (F.max("dist").alias("radius"), F.count("*").alias("n"), F.count_if(is_query).alias("asking"))
    for r in placed.groupBy("dims", "pivot").agg(*counted).collect():
        areas.setdefault(r["dims"], []).append((r["pivot"], r["radius"], -(-r["n"] // block_rows)))
        asking.setdefault(r["dims"], {})[r["pivot"]] = r["asking"]
    areas_sent = spark.sparkContext.broadcast(areas)
    salts = spark.createDataFrame([(d, p, s) for d, own in areas.items() for p, _, s in own], "dims int, pivot int, salts int")
    parts = {d: query_parts(pivots.get(d), n, query_rows) for d, n in asking.items()}
    parts_sent = spark.sparkContext.broadcast(parts)
    queries = placed.where(is_query).dropDuplicates(["id", "vec"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that a query needs, its part of the queries, and its floor."""
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, d, v, home in zip(*(batch.column(c).to_pylist() for c in ("id", "dims", "vec", "pivot")), strict=True):
                q = np.frombuffer(v, "<f8")
                first, n_parts = parts_sent.value[d][home]
                part = first + zlib.crc32(str(key).encode()) % n_parts
                floor = -np.inf
                if d in sent.value[1]:
                    ids, vecs = sent.value[1][d]
                    own = np.sort((vecs @ q)[ids != key])[::-1]
                    if len(own) >= k:
                        floor = own[k - 1] - 1e-9 * abs(own[k - 1]) - 1
                size = np.sqrt(q @ q)
                for pivot, radius, n in areas_sent.value.get(d, ()):
                    c = sent.value[0].get(d)
                    top = np.inf if c is None else c[pivot] @ q + radius * size
                    if top + 1e-9 * abs(top) + 1 >= floor:
                        for salt in range(n):
                            for col, x in zip(out, (key, d, v, pivot, salt, part, floor), strict=True):
                                col.append(x)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "dims", "vec", "pivot", "salt", "part", "floor"])

    block = ["dims", "pivot", "salt", "part"]
    asked = queries.mapInArrow(reach, "id long, dims int, vec binary, pivot int, salt int, part int, floor double")
    # a vector travels once for each part of the queries that needs its block
    dealt = (
        placed.drop("dist")
        .join(F.broadcast(salts), ["dims", "pivot"])
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        .drop("salts")
        .join(asked.select(*block[:3], F.col("part").alias("part")).distinct(), block[:3])
    )

    def search(key: tuple, data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        data, asking = data.drop_duplicates(["id", "vec"]), asking.drop_duplicates(["id", "vec"])
        found, _ = dual_search(
            _matrix(asking["vec"], d), asking["id"].to_numpy(), asking["floor"].to_numpy(), _matrix(data["vec"], d), data["id"].to_numpy(), k
        )
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype("int64")

    best = dealt.groupBy(*block).cogroup(asked.groupBy(*block)).applyInPandas(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def query_parts(pivots: np.ndarray | None, asking: dict[int, int], query_rows: int) -> dict[int, tuple[int, int]]:
    """For each pivot the first part of its queries and their number of parts: about
    ``query_rows`` queries a part, pivots that lie together in the cover tree of the pivots in
    one, a pivot with more queries in several."""
    order = sorted(asking)
    if pivots is not None:
        order, stack = [], [cover_tree(pivots, leaf=1)]
        while stack:
            node = stack.pop()
            stack += node.children
            order += [] if node.children else [int(r) for r in node.rows if int(r) in asking]
    out, at, held = {}, 0, 0
    for pivot in order:
        n = asking[pivot]
        if held and held + n > query_rows:
            at, held = at + 1, 0
        several = max(1, -(-n // query_rows))
        out[pivot] = (at, several)
        at, held = (at + several, 0) if several > 1 else (at, held + n)
    return out


def hash_bytes(v: bytes) -> int:
    """A fixed order of vectors that does not follow their values."""

    return zlib.crc32(v)
