"""Operator 11: Merkle manifest of a dataset by cogrouped subtree exchange.

The leaves of each source are numbered in order (a range exchange, written once; a hot source
spreads over many slices) and cut into superblocks of ``arity ** depth`` consecutive leaves.
Going up, every superblock is reduced to its one top node, and the tops are the nodes of the
next round, until each source has its subroot; the subroots, in order of their sources, are
reduced in the same way to the root. Going down, each superblock's nodes are cogrouped with
the outer nodes that its proofs need, and one function finishes the local reduction, joins the
proofs and folds them. What a task holds at once is one superblock (or as many small sources
as make up about one), whatever the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import checkpointed, shuffle_partitions, use_package

ARITY = 3
DEPTH = 7  # levels of the tree in a superblock: 2187 leaves
UNIT = ["unit", "unit_block", "unit_slice"]  # what one call reduces: a superblock, or several small sources


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int, arity: int, depth: int) -> list[list[str]]:
    """The levels above ``nodes``, themselves first: up to one node where they are all the
    ``total`` nodes of their tree, else ``depth`` of them."""
    levels = [nodes]
    whole = total <= arity**depth
    while len(levels[-1]) > 1 if whole else len(levels) <= depth:
        at = levels[-1]
        levels.append([_hash("".join(at[i : i + arity])) for i in range(0, len(at), arity)])
    return levels


def _siblings(levels: list[list[str]], place: int, arity: int) -> list[tuple[str, str]]:
    """(nodes before, nodes behind) in the run of the node at ``place``, level by level."""
    out = []
    for at in levels[:-1]:
        first = place - place % arity
        out.append(("".join(at[first:place]), "".join(at[place + 1 : first + arity])))
        place //= arity
    return out


def _encode(path: list[tuple[str, str]]) -> str:
    return ";".join([f"{a}|{b}" for a, b in path])


def _decode(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split("|")) for step in path.split(";")] if path else []


def _parts(nodes: pd.DataFrame, size: int) -> Iterator[tuple[str, int, int, pd.DataFrame]]:
    """(tree, superblock, nodes of the tree, rows in order) of each superblock in a unit."""
    nodes = nodes.sort_values(["tree", "pos"], kind="stable")
    for tree, rows in nodes.groupby("tree", sort=False):
        yield tree, int(rows["pos"].iat[0]) // size, int(rows["total"].iat[0]), rows


def _numbered(rows: DataFrame, order: list[str], arity: int, depth: int) -> DataFrame:
    """``rows`` with ``pos`` (their place in their ``tree``, by ``order``), ``total`` (rows of
    the tree) and the columns of UNIT."""
    parts = shuffle_partitions(rows.sparkSession)
    sorted_rows = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # written once: places and counts must come from the same split into slices
    placed = checkpointed(sorted_rows.withColumn("slice", F.spark_partition_id()).withColumn("place", place))
    own = Window.partitionBy("tree")
    before = own.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy("slice", "tree")
        .agg(F.min("place").alias("begin"), F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(own))
        .withColumn("slices", F.count("*").over(own))
    )
    size = arity**depth
    spread = (F.col("total") > size) | (F.col("slices") > 1)
    pos = F.col("offset") + F.col("place") - F.col("begin")
    return (
        placed.join(runs, ["slice", "tree"])
        .withColumn("pos", pos)
        .withColumn("unit", F.when(spread, F.col("tree")).otherwise(""))
        .withColumn("unit_block", F.floor(F.when(spread, F.col("pos")).otherwise(F.col("begin")) / size))
        .withColumn("unit_slice", F.when(spread, -1).otherwise(F.col("slice")))
        .drop("slice", "place", "begin", "n", "offset", "slices")
    )


def _climb(nodes: DataFrame, arity: int, depth: int) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, tops of their superblocks) of each round; ``total`` of a top is the number of
    tops of its tree, so 1 marks the tree's root."""
    size = arity**depth

    def reduce(unit: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, block, total, rows in _parts(unit, size):
            top = _levels(rows["node"].tolist(), total, arity, depth)[-1][0]
            first = rows.iloc[0]
            out.append((*(first[u] for u in UNIT), tree, block, -(-total // size), top))
        return pd.DataFrame(out, columns=[*UNIT, "tree", "pos", "total", "node"])

    schema = "unit string, unit_block long, unit_slice int, tree string, pos long, total long, node string"
    rounds = []
    largest = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        tops = checkpointed(nodes.groupBy(*UNIT).applyInPandas(reduce, schema))
        rounds.append((nodes, tops))
        if largest <= size:
            return rounds
        largest = -(-largest // size)
        nodes = tops.where("total > 1").select(
            F.col("tree").alias("unit"), F.floor(F.col("pos") / size).alias("unit_block"), F.lit(-1).alias("unit_slice"), "tree", "pos", "total", "node"
        )


def _roots(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(tree, node): the root of each tree."""
    out = None
    for _, tops in rounds:
        done = tops.where("total = 1").select("tree", "node")
        out = done if out is None else out.unionByName(done)
    return out


def _descend(rounds: list[tuple[DataFrame, DataFrame]], outer: DataFrame, arity: int, depth: int, emit, schema: str) -> DataFrame:
    """The nodes of the first round through ``emit(rows, paths, known)``: ``paths`` are the
    siblings on the way up from each row, ``known`` the row of ``outer`` (tree, path, and what
    else holds for a whole tree) with its path."""
    size = arity**depth
    facts = [c for c in outer.columns if c not in ("tree", "path")]

    def finishing(make):
        def finish(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            known = {(r["tree"], r["pos"]): r for r in above.to_dict("records")}
            out = []
            for tree, block, total, rows in _parts(nodes, size):
                levels = _levels(rows["node"].tolist(), total, arity, depth)
                mine = known[(tree, block)]
                outside = _decode(mine["path"])
                paths = [_siblings(levels, i, arity) + outside for i in range(len(rows))]
                out.append(make(rows, paths, mine))
            return pd.concat(out)

        return finish

    def inner(rows, paths, known) -> pd.DataFrame:
        same = {c: known[c] for c in facts}
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": [_encode(p) for p in paths], **same})

    inner_schema = ", ".join(["tree string, pos long, path string", *(f"{c} string" for c in facts)])
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        nodes, tops = rounds[k]
        above = tops.where("total = 1").join(outer, "tree").select(*UNIT, "tree", "pos", "path", *facts)
        if paths is not None:
            rest = tops.where("total > 1").join(paths, ["tree", "pos"]).select(*above.columns)
            above = above.unionByName(rest)
        make, shape = (emit, schema) if k == 0 else (inner, inner_schema)
        paths = nodes.groupBy(*UNIT).cogroup(above.groupBy(*UNIT)).applyInPandas(finishing(make), shape)
    return paths


def _field(col: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(id_col: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (id_col, source, lang, n_chars, text)]), 256)


def manifest(docs: DataFrame, received: Column | None = None, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A leaf is the hash of a row's doc_id, source, lang, n_chars and text. The leaves of a
    source, by doc_id, and then the subroots of the sources (null first, then by bytes) are
    hashed in runs of ``arity`` until one node is left; a tree of one node is that node.
    ``proof_sha256`` is the hash of the siblings on the way from the leaf to the root.
    ``received`` (an expression over ``docs``) is the text to verify, null for none: the leaf
    with that text is folded with the siblings of the manifest, and ``verified`` says whether
    this gives the root. By default the texts themselves are verified.

    Rows of one source that share a doc_id, or have none (these come first), stand in order of
    their leaves; rows that repeat each other entirely have equal leaves and equal columns
    but for their place. Null and empty values have different leaves. Other columns are not
    read; an empty table has no rows, and so no root."""
    use_package(docs.sparkSession)
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    seen = docs["text"] if received is None else received
    changed = ~seen.eqNullSafe(docs["text"])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("tree"),
        docs["doc_id"].cast("long").alias("doc_id"),
        leaf_hash(*fields, docs["text"]).alias("node"),
        F.when(changed, leaf_hash(*fields, seen)).alias("seen"),
    )
    # the narrow rows are written first, so that the range sample does not hash the texts again
    placed = _numbered(checkpointed(rows), ["doc_id", "node", "seen"], arity, depth)
    # ids as text, since pandas has no null among integers
    leaves = _climb(checkpointed(placed.withColumn("doc_id", F.col("doc_id").cast("string"))), arity, depth)

    subroots = _roots(leaves).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    sources = _climb(checkpointed(_numbered(subroots, ["source"], arity, depth)), arity, depth)
    root = _roots(sources).select("tree", F.lit("").alias("path"), F.col("node").alias("root"))

    def of_source(rows, paths, known) -> pd.DataFrame:
        return pd.DataFrame({"tree": rows["source"], "path": [_encode(p) for p in paths], "subroot": rows["node"], "root": known["root"]})

    outer = _descend(sources, root, arity, depth, of_source, "tree string, path string, subroot string, root string")

    def of_leaf(rows, paths, known) -> pd.DataFrame:
        proofs, folded = [], []
        for node, seen, path in zip(rows["node"], rows["seen"], paths, strict=True):
            proofs.append(_hash("".join([a + b for a, b in path])))
            at = seen if isinstance(seen, str) else node
            for a, b in path:
                at = _hash(a + at + b)
            folded.append(at)
        out = rows[["doc_id", "tree", "node"]].rename(columns={"tree": "source", "node": "leaf"})
        return out.assign(subroot=known["subroot"], root=known["root"], proof_sha256=proofs, folded_root=folded)

    schema = "doc_id string, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _descend(leaves, checkpointed(outer), arity, depth, of_leaf, schema)
    named = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", named).withColumn("verified", F.col("folded_root") == F.col("root"))
