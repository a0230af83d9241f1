"""Operator 1: exact dedup by content sort, in DataFrame operations only.

The rows are range-partitioned by their normalised content: Spark samples splitters of the
content's head, length, middle and tail (short strings, so that the sample stays small),
sorts each range on the whole normalised text (spilling to disk where it must) and so puts
equal texts next to each other, where the window compares neighbours in full and takes the
id that stays. Texts with very many copies are counted first, from partial counts of their
hashes; they are at most four times as many as there are partitions, their list is
broadcast, and their rows are spread over several ranges by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, shuffle_partitions

HEAD = 64  # characters of the content's head among the range keys


def _decided(docs: DataFrame, id_col: str, text_col: str, payload: Column) -> DataFrame:
    """(doc_id, row, text, digest, keep_id, group_size, kept) for each row; ``row`` is ``payload``."""
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), payload.alias("row"))
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("norm", norm).withColumn("digest", F.sha2("norm", 256))
    n = docs.count()
    hot = (
        rows.groupBy("digest")
        .agg(F.max("doc_id").alias("hot_id"), F.count("*").alias("hot_size"))
        .where(F.col("hot_size") * (4 * parts) > F.lit(n))
        .where("hot_size > 1")
    )
    size = F.char_length("norm")
    dealt = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("head", F.substring("norm", 1, HEAD))
        .withColumn("size", size)
        .withColumn("inner", F.concat(F.col("norm").substr((size / 2).cast("int") + 1, F.lit(32)), F.substring("norm", -32, 32)))
        .withColumn("salt", F.when(F.col("hot_size").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).otherwise(0))
        .drop("norm")
        .repartitionByRange("head", "size", "inner", "salt")
        .withColumn("norm", norm)  # again, so that a text travels once
    )
    # partitioning and sort of the range exchange serve the windows: no further exchange
    same = Window.partitionBy("head", "size", "inner", "salt", "norm")
    return (
        dealt.withColumn("place", F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())))
        .withColumn("run_id", F.max("doc_id").over(same))
        .withColumn("run_size", F.count("*").over(same))
        .select(
            "doc_id",
            "row",
            "text",
            "digest",
            F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).otherwise(F.col("run_id")).alias("keep_id"),
            F.coalesce("hot_size", "run_size").alias("group_size"),
            ((F.col("place") == 1) & (F.col("hot_size").isNull() | F.col("run_id").eqNullSafe(F.col("hot_id")))).alias("kept"),
        )
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty.
    ``keep_id`` is the largest id of a group. A null id is smaller than any other; a group
    without ids has a null keep_id. Exactly one row of a group is kept, also where rows
    repeat an id. Other columns are not read; an empty table gives an empty result."""
    out = _decided(docs, id_col, text_col, F.lit(None).cast("boolean"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, all columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered = docs.toDF(*names)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    others = [n for n in names if n != at[text_col]]
    out = _decided(numbered, at[id_col], at[text_col], F.struct(*others))
    return out.where("kept").select(*(F.col("text" if c == text_col else f"row.{at[c]}").alias(c) for c in docs.columns))
