"""The corpus pipeline: its stages in order, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last:
the packed pieces); its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import exact_dedup, ngram_jaccard, packing, span_dedup, toxicity
from tillroll.llm.common import checkpoint_folder, delete_folder
from tillroll.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from ``labels``. Each row is
    scored by its text alone, so rows without an id, and rows that share one, stand for
    themselves; only labelled ids are learnt from. A null text counts as empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays: exactly one, also
    where rows share that id. Null ids are smaller than any other; null texts count as empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles the row
    with the smallest id stays, null ids last: exactly one, also where rows share an id or have
    none. Texts that only share an id, and texts without words, all stay."""
    return ngram_jaccard.drop_near_copies(docs, words=5, num=80, den=100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that a repeated span covers go, but for its first occurrence: in the smallest
    id, rows without an id last and in order of a hash of their text. Rows that share an id
    count as one document among themselves. Null and empty texts stay."""
    return span_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into windows of 1024 tokens: each row a document of its own, null
    and repeated ids as they are; a null or empty text is its end token alone."""
    return packing.digests(packing.pack(docs, BYTE_BPE, window=1024))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("packing", pack),
]

# The stages have a trained model and packing in them, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, with what each keeps written to the shared folder. What a
    stage has read is deleted when its own rows are written; the last folder, which the
    returned frame reads, stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                delete_folder(spark, f"{folder}/{i - 1}")
    return docs
