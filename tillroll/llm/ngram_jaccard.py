"""Operator 6: exact Jaccard join of word n-gram sets by set-relation skipping.

Sets are collapsed to classes of equal sets first. A set of a size class is cut into parts
by position, i.e. by intervals of its tokens' hash order, so that sets similar enough must
share whole parts; the first index has one list per part value.

* Skipping in the index: a list with a single set, and every set that has no part in common
  with another one, is skipped whole. The sets that remain are indexed by their tokens,
  rarest first, in lists ordered by position: only a short head of each set is indexed, a
  set with too many tokens of its own is skipped, and a pair is skipped when the tokens
  behind the positions at which it meets can no longer suffice.
* Answers from similar sets: every set is first compared with one leader of its lists only.
  Sets that are similar to the same set have the same component: their mutual answers
  follow from the leader's and are skipped. Only pairs of sets whose components differ
  after that are compared.

The lists prune; every link is decided by the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import checkpointed, id_and_text, keyed, release_caches, small_batches, use_package, written
from tillroll.llm.components import components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (all bits depend on all bits)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of ``text``; words are runs of
    bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased. With fewer words than
    n the whole sequence counts as one n-gram; without words the set is empty."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


class Scheme:
    """Size classes and parts for the threshold ``num / den``."""

    def __init__(self, num: int, den: int, ratio: float = 1.3) -> None:
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den, self.ratio = num, den, ratio
        self.bounds = [1]

    def of(self, size: int) -> list[tuple[int, int]]:
        """(scheme, most tokens that differ) under which a set of ``size`` is indexed: that
        of its size class, and those of smaller classes that hold similar sets."""
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
        k = int(np.searchsorted(self.bounds, size, "right")) - 1
        least = -(-size * self.num // self.den)  # the smallest similar set
        out = []
        while k >= 0 and self.bounds[k + 1] > least:
            x = self.bounds[k + 1] - 1  # the largest smaller set of a pair of this scheme
            y = x * self.den // self.num
            differ = (x + y) * (self.den - self.num) // (self.den + self.num)
            if differ:
                out.append((k, differ))
            k -= 1
        return out

    def parts(self, k: int, differ: int) -> int:
        """How many parts scheme k has: one more than tokens may differ, and as many more as
        may well be empty in its smallest sets."""
        m = differ + 1
        empty = m * math.exp(-self.bounds[k] / m)
        return m + math.ceil(empty + 3 * math.sqrt(empty))

    def keys(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The hashes of the parts of a set, for each scheme that it is indexed under.

        Of similar sets m - differ parts at least are equal. With fewer empty parts than that
        in one of them, a part with tokens is among the equal ones; so empty parts, which
        very many sets share, count only in sets with more."""
        out: list[np.ndarray] = []
        if not len(tokens):
            return out
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens), dtype=np.uint64)])
        for k, differ in self.of(len(tokens)):
            m = self.parts(k, differ)
            cuts = ((np.arange(1, m, dtype=np.float64) / m) * 2.0**64).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(tokens, cuts), [len(tokens)]])
            part = sums[at[1:]] - sums[at[:-1]]
            salt = np.uint64(k + 1) << np.uint64(32)
            keys = mixed(mixed(part) + salt + np.arange(m, dtype=np.uint64))
            empty = at[1:] == at[:-1]
            out.append(keys if empty.sum() >= m - differ else keys[~empty])
        return out


def _class_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _found(texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of ``texts`` (doc_id, text, k1, k2) the rows (doc_id, k1, k2, n, cls) and the classes of
    equal sets (cls, root, component_id, compared_links)."""
    spark = texts.sparkSession
    use_package(spark)
    scheme = Scheme(num, den)

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, cls, keys = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = shingle_set(text, words)
            n.append(len(tokens))
            cls.append(_class_of(tokens))
            parts = scheme.keys(tokens)
            keys.append(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # half of cls as a number: cheaper to aggregate
        h = np.frombuffer(b"".join(cls), np.int64)[::2]
        return pa.RecordBatch.from_arrays(
            [*map(batch.column, ("doc_id", "k1", "k2")), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(h), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "k1", "k2", "n", "cls", "h", "keys"],
        )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        yield from map(sets_of, batches)
        release_caches()  # the JVM's joins come next

    with small_batches(spark), written(texts.mapInArrow(sets, "doc_id long, k1 long, k2 long, n long, cls binary, h long, keys array<long>")) as listed_parts:
        made = checkpointed(listed_parts.drop("keys"))
        # coarse parts: which sets share a part with another row at all
        coarse = listed_parts.select(F.explode("keys").alias("key"), "h")
        several = coarse.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
        near = checkpointed(coarse.join(several, "key", "left_semi").select("h").distinct())
    classes = checkpointed(made.where("n > 0").groupBy("cls", "h").agg(F.min("doc_id").alias("rep")))
    wanted = classes.join(near, "h", "left_semi").select(F.col("rep").alias("doc_id"), "cls")

    def tokens_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = shingle_set(text, words)
            if _class_of(tokens) == cls:
                rows.append((cls, len(tokens), tokens.view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["cls", "n", "tokens"],
        )

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        yield from map(tokens_of, batches)
        release_caches()

    by_null = F.coalesce("doc_id", F.lit(-(2**63)))
    with small_batches(spark):
        full = checkpointed(
            texts.withColumn("id", by_null)
            .join(wanted.select(by_null.alias("id"), "cls"), "id")
            .select("cls", "text")
            .mapInArrow(full_sets, "cls binary, n long, tokens array<long>")
        )

    # token lists: of each set the shared tokens, rarest first, and of these only the head
    # in which a similar set must meet it
    tokens = full.select("cls", "n", F.explode("tokens").alias("key"))
    shared = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * num / F.lit(den))
    listed = checkpointed(
        tokens.join(shared, "key")
        .groupBy("cls", "n")
        .agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("parts"))
        .withColumn("left", F.size("parts"))
        .where(F.col("left") >= least)
        .select("cls", "n", "left", F.posexplode(F.slice("parts", F.lit(1), (F.col("left") - least + 1).cast("int"))).alias("pos", "part"))
        .select("cls", "n", "left", "pos", F.col("part.key").alias("key"))
    )

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar."""
        one = pairs.join(full.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
        two = one.join(full.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
        both = F.size(F.array_intersect("ta", "tb"))
        return two.where(both * den >= (F.col("na") + F.col("nb") - both) * num).select("a", "b").distinct()

    # every set against one leader: of the leaders of its lists, the one that shares most
    # (a table of its own, so that Spark can split the partition of a long list in the join)
    leader = checkpointed(listed.groupBy("key").agg(F.max(F.struct("left", "cls")).alias("l")))
    star = checkpointed(
        listed.join(leader, "key")
        .where("cls <> l.cls")
        .groupBy("cls")
        .agg(F.max("l").alias("l"))
        .select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b"))
        .distinct()
    )
    first = checkpointed(links(star))
    roots = components(first)

    # pairs whose components still differ, in lists that hold several components
    known = checkpointed(
        listed.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    )
    mixed_lists = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = known.join(mixed_lists, "key", "left_semi")
    x, y = left.alias("x"), left.alias("y")
    ahead = F.least(F.col("x.left") - F.col("x.pos"), F.col("y.left") - F.col("y.pos"))
    rest = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.cls") < F.col("y.cls"))
            & (F.col("x.root") != F.col("y.root"))
            & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
            & (ahead * (num + den) >= (F.col("x.n") + F.col("y.n")) * num),
        )
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        .distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    second = checkpointed(links(rest))
    all_links = first.union(second)
    roots = components(all_links)

    degree = all_links.select("a").union(all_links.select("b")).groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("compared_links"))
    root_of = classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = root_of.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = root_of.join(smallest, "root").join(degree, "cls", "left").select("cls", "root", "component_id", "compared_links")
    return made.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls")), per_class


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, compared_links) for each row of ``docs``.

    Two documents link when den * |intersection| >= num * |union| of their n-gram sets;
    component_id is the smallest doc_id that links reach, itself included. ``compared_links``
    counts the other sets (not copies) whose comparison found a link; pairs inside a component
    that is already known are neither compared nor counted. A null text counts as empty; documents without words have an empty
    set, link with nothing and are their own component. Each row is a document: repeated
    rows have equal sets and link. A null id never is a component_id unless all ids of a
    component are null. Other columns are not read; an empty table gives an empty result.
    """
    none = F.lit(None).cast("long")
    texts = id_and_text(docs, id_col, text_col).withColumns({"k1": none, "k2": none})
    rows, classes = _found(texts, words, num, den)
    return rows.join(classes, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("compared_links", F.lit(0)).alias("compared_links"),
    )


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component of ``jaccard_components``, all columns as
    they are: the one with the smallest id (null last), of several with that id the first by a
    hash of the text, of rows equal in both any one. Rows without words all stay. Decided by
    row, so texts that only share an id, or have none, do not go with one another."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    by_key = keyed(docs.toDF(*names), at[id_col], at[text_col])
    texts = by_key.select(F.col(at[id_col]).cast("long").alias("doc_id"), F.coalesce(at[text_col], F.lit("")).alias("text"), "k1", "k2")
    rows, classes = _found(texts, words, num, den)
    # one row per key, with how many rows have it
    keys = rows.where("n > 0").groupBy("cls", "k1", "k2", "doc_id").agg(F.count("*").alias("rows")).join(classes.select("cls", "root"), "cls")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    first = keys.groupBy("root").agg(F.min(order).alias("first"))
    marked = keys.join(first, "root").withColumn("stays", (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")))
    marked = checkpointed(marked.where("NOT stays OR rows > 1").select("k1", "k2", "stays"))
    plain = by_key.join(marked.select("k1", "k2"), ["k1", "k2"], "left_anti")
    # rows that repeat id and text of the row that stays: one of them
    repeated = by_key.join(marked.where("stays").select("k1", "k2"), ["k1", "k2"])
    one = repeated.withColumn("place", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))).where("place = 1")
    return plain.select(*names).unionByName(one.select(*names)).toDF(*docs.columns)
