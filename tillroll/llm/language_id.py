"""Operator 5: language identification by multinomial naive Bayes over hashed character
n-grams; the log-probability matrix goes to every task, which scores its batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import slices
from tillroll.llm.common import fold, id_and_text, use_package

FIT_ROWS = 20_000  # labelled rows that the model is fitted on, about
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)

_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> np.ndarray:
    """The bucket of each character n-gram of the lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = [_hashed(c, n) for n in ORDERS if len(c) >= n]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


PRODUCTS = 1 << 20  # entries of the sparse product made at once


def batch_ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the n-grams of all texts, one text behind the other, and
    the text of each: the non-zero entries, repeated ones apart, of the texts x buckets matrix."""
    raw = [t.lower().encode("utf-32-le") for t in texts]
    c = np.frombuffer(b"".join(raw), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(r) // 4 for r in raw])
    for n in ORDERS:
        if len(c) < n:
            continue
        last = len(c) - n + 1
        whole = row[:last] == row[n - 1 :]  # n-grams don't cross texts
        yield _hashed(c, n)[whole], row[:last][whole]


def _hashed(c: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(c) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Languages in order, and the log-probability of each bucket (and the prior) in each."""

    langs: list[str]
    log_p: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, their posterior probabilities); ``und`` and 0 without a letter or model."""
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.langs and t is not None and _LETTER.search(t)]
        if not known:
            return langs, score
        s = self.log_sums([texts[i] for i in known]) + self.prior
        best = s.argmax(axis=1)
        score[known] = 1 / np.exp(s - s[np.arange(len(s)), best][:, None]).sum(axis=1)
        for i, at in zip(known, best.tolist(), strict=True):
            langs[i] = self.langs[at]
        return langs, score

    def log_sums(self, texts: list[str]) -> np.ndarray:
        """texts x languages: the sparse matrix of n-gram counts times that of log-probabilities."""
        per_bucket = np.ascontiguousarray(self.log_p.T)
        step = max(1, PRODUCTS // len(self.langs))
        out = np.zeros((len(texts), len(self.langs)))
        for bucket, row in batch_ngrams(texts):
            for a in range(0, len(bucket), step):
                own = row[a : a + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(per_bucket[bucket[a : a + step]], first, axis=0)
        return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", alpha: float = 0.1) -> Model:
    """The model from text and language of rows whose crc32(id as text) mod 5 is not 0.

    Rows with a null language, id or text are not learnt from; of the others about
    ``fit_rows``, chosen by a hash of the id. Without any, the model knows no language."""
    use_package(docs.sparkSession)
    marked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    marked = marked.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(fold() != 0)
    share = min(1.0, fit_rows / max(1, marked.select("doc_id").count()))
    rows = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).where("text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] += np.bincount(ngrams(text), minlength=BUCKETS)
                n[lang] = n.get(lang, 0) + 1
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(c[at], n[lang])})

    # one row per language and bucket: bounded by the languages, whatever the corpus' size
    sums = rows.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in sums})
    at = {lang: i for i, lang in enumerate(langs)}
    counts, docs_of = np.full((len(langs), BUCKETS), alpha), np.zeros(len(langs))
    for r in sums:
        if r["bucket"] < 0:
            docs_of[at[r["lang"]]] = r["n"]
        else:
            counts[at[r["lang"]], r["bucket"]] += r["n"]
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(docs_of / docs_of.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row's whole text.

    A null text and a text without a letter are ``und`` with score 0; null ids stay null;
    repeated rows each give a row; of equal scores the language first in the alphabet is
    taken; other columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    use_package(spark)
    sent = spark.sparkContext.broadcast(model)  # languages x BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                langs, score = m.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
