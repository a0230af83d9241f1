"""Operator 2: BPE encoding and decoding of whole texts (see bpe.py for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import codec, slices
from tillroll.llm.common import id_and_text, use_package


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row of ``docs``.

    ``ids`` are the text's token ids without added special tokens (special strings inside
    a text count as the special token); ``decoded`` is the text of those ids. A null or
    empty text has no ids and decodes to the empty text; null ids stay null; repeated rows
    and ties each give a row; an empty table gives an empty result; other columns are not
    read. One pass over the rows, no shuffle: each batch of texts is coded in pieces of
    about a million characters.
    """
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids, counts = c.encode(texts[a:b])
                raw, ends = c.decode_bytes(ids, counts)
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                decoded, at = [], 0
                for end in ends.tolist():
                    decoded.append(raw[at:end].decode("utf-8", "replace"))
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids, SHA-256 of the ids joined by commas and of the decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
