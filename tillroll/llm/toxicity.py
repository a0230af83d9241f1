"""Operator 10: toxicity by weak supervision.

1. Terms (words, and beginnings of words of 4 to 6 characters) that labelled toxic rows
   hold far more often than clean ones are mined from a bounded sample of the training
   fold, and dealt to lexicon voters; pattern voters look at shouting, exclamation, links
   and code, digits and repetition.
2. A generative label model estimates each voter's accuracy in both classes and the
   correlations between voters: expectation maximisation of a tree-augmented model, whose
   tree links each voter to the one it depends on most, given the class. The annotator is
   one more voter, who may err. The model's posteriors replace the labels.
3. A linear classifier is trained on these posteriors, over the terms and patterns, and
   scores every whole text.

The sample is bounded by ``fit_rows``; everything else covers all rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fold, id_and_text, release_caches, use_package

FIT_ROWS = 20_000  # labelled rows that the models are fitted on, about
VOTERS = 24  # lexicon voters
ANNOTATOR = 0.99  # the label model takes the annotator's accuracy to be this at least
PRECISION = 0.8  # least share of toxic rows among the labelled rows that hold a term
BEGINNINGS = (4, 5, 6)
PATTERNS = ("shouting", "exclamation", "code", "digits", "repetition")

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}']*")


def terms_of(words: set[str]) -> set[str]:
    """The words and their beginnings, the latter marked by a star."""
    out = set(words)
    for k in BEGINNINGS:
        out.update(w[:k] + "*" for w in words if len(w) >= k)
    return out


def patterns_of(text: str, words: list[str]) -> list[bool]:
    n = max(1, len(text))
    letters = sum(map(len, words))
    upper = sum(w.isupper() for w in words)
    return [
        upper * 2 > max(1, len(words)),
        text.count("!") * 50 > n,
        (text.count("{") + text.count(";") + text.count("=") + text.count("http")) * 50 > n,
        letters * 2 < n and len(text) > 0,
        len(set(words)) * 3 < len(words),
    ]


@dataclass
class Model:
    """The fitted classifier: a weight for each term and pattern, and a bias."""

    bias: float = -30.0
    terms: dict[str, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))

    def score(self, text: str | None) -> float:
        """0 to 1, higher: toxic likelier."""
        text = text or ""
        words = _WORD.findall(text)
        low = {w.lower() for w in words}
        z = self.bias + sum(self.terms[t] for t in self._whole & low)
        for k, known in self._beginnings.items():
            for b in known & {w[:k] for w in low if len(w) >= k}:
                z += self.terms[b + "*"]
        if any(self.patterns):
            z += sum(w for w, hit in zip(self.patterns, patterns_of(text, words), strict=True) if hit)
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))

    def __post_init__(self) -> None:
        self._whole = frozenset(t for t in self.terms if not t.endswith("*"))
        self._beginnings = {k: frozenset(t[:-1] for t in self.terms if t.endswith("*") and len(t) == k + 1) for k in BEGINNINGS}


# ---- the generative label model ----


def label_model(votes: np.ndarray, weight: np.ndarray, lead: int, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1 for each vote pattern, accuracies, tree).

    ``votes`` holds a row of 0/1 votes for each distinct pattern, ``weight`` how often it
    occurs. Starts from the votes of voter ``lead``; then alternates posteriors and, under
    them, P(vote | class, vote of the tree parent). The tree is a maximum spanning tree of
    the voters by conditional mutual information. accuracies[j, y] = P(vote j = y | y)."""
    n, k = votes.shape
    post = np.where(votes[:, lead] == 1, 0.95, 0.02)
    parent = np.full(k, -1)
    acc = np.full((k, 2), 0.5)
    for step in range(rounds):
        by_class = np.stack([(1 - post) * weight, post * weight])
        total = by_class.sum(axis=1) + 2
        one = (by_class @ votes + 1) / total[:, None]  # P(vote = 1 | class)
        one[0, lead], one[1, lead] = min(one[0, lead], 1 - ANNOTATOR), max(one[1, lead], ANNOTATOR)
        acc = np.stack([1 - one[0], one[1]], axis=1)
        if step % 10 == 0:
            parent = _tree(votes, by_class, lead)
        log = np.log(np.array([1 - prior, prior]))[:, None] + np.zeros((2, n))
        for j in range(k):
            v = votes[:, j]
            for y in (0, 1):
                if parent[j] < 0:
                    p = np.where(v == 1, one[y, j], 1 - one[y, j])
                else:
                    up = votes[:, parent[j]]
                    p = np.empty(n)
                    for u in (0, 1):
                        of = up == u
                        # one pseudo-row that votes as the class does without the parent
                        p1 = ((by_class[y] * v)[of].sum() + one[y, j]) / (by_class[y][of].sum() + 1)
                        p[of] = np.where(v[of] == 1, p1, 1 - p1)
                # a voter that finds nothing abstains; only the annotator's 0 is a vote
                log[y] += np.where((v == 1) | (j == lead), np.log(np.clip(p, 1e-6, 1 - 1e-6)), 0.0)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
        prior = float(np.clip((post * weight).sum() / weight.sum(), 0.005, 0.6))
    return post, acc, parent


def _tree(votes: np.ndarray, by_class: np.ndarray, alone: int) -> np.ndarray:
    """The parent of each voter in the maximum spanning tree (-1: a root); voter ``alone``
    stays out of it, or its errors would be explained by the others' votes."""
    k = votes.shape[1]
    info = np.zeros((k, k))
    whole = by_class.sum()
    for y in (0, 1):
        w = by_class[y]
        t = w.sum() + 1e-9
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = ((votes == a).T @ w) / t, ((votes == b).T @ w) / t
                both = ((votes == a) * w[:, None]).T @ (votes == b) / t
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = both * np.log(both / np.outer(pa_, pb))
                info += t / whole * np.nan_to_num(part, nan=0.0, posinf=0.0, neginf=0.0)
    info[alone], info[:, alone] = 0, 0
    parent = np.full(k, -1)
    inside = {alone}
    while len(inside) < k:
        gain, j, u = max((info[j, u], j, u) for j in range(k) if j not in inside for u in inside)
        parent[j] = u if gain > 0.01 else -1
        inside.add(j)
    return parent


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, bias last, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty * w
        curve = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ---- fitting ----


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of about ``fit_rows`` labelled rows outside the held-out fold."""
    marks = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold() != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about fit_rows short rows: small enough to broadcast at any size of the corpus
    return id_and_text(docs, id_col, text_col).join(F.broadcast(marks), "doc_id").select("text", F.least("toxic", F.lit(1)).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model for ``docs``, from ``labels`` (doc_id, toxic).

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learnt from. Null labels count
    for nothing; a row with several labels is toxic if one says so. Without toxic or
    without clean rows every score is 0."""
    use_package(docs.sparkSession)
    rows = training_rows(docs, labels, fit_rows, id_col, text_col)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_caches()
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[toxic].update(terms_of({w.lower() for w in _WORD.findall(text)}))
                seen[toxic][""] += 1  # the number of rows
        for toxic, terms in seen.items():
            if terms:
                yield pd.DataFrame({"term": list(terms), "toxic": toxic, "n": list(terms.values())})

    counts = (
        rows.mapInPandas(count, "term string, toxic int, n long")
        .groupBy("term")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    )
    sums = counts.agg(F.max(F.when(F.col("term") == "", F.col("bad"))), F.max(F.when(F.col("term") == "", F.col("good"))), F.count("*")).first()
    bad, good, distinct = (int(x or 0) for x in sums)
    if not bad or not good:
        return Model()
    a, b = F.col("bad"), F.col("good")
    expected = (a + b) * bad / (bad + good)
    surprise = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0.0))
    found = (
        counts.where("term <> '' AND bad >= 3")
        .withColumn("surprise", surprise)
        .where(a > PRECISION * (a + b))
        .where(F.col("surprise") > 2 * np.log(distinct + 1) - 9)
        .orderBy(F.col("surprise").desc(), "term")
        .collect()
    )
    lexicon = [r["term"] for r in found]
    if not lexicon:
        return Model(bias=float(np.log(bad / good)))
    at = {t: i for i, t in enumerate(lexicon)}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = _WORD.findall(text)
                hits = sorted(at[t] for t in terms_of({w.lower() for w in words}) & at.keys())
                out.append(hits + [len(lexicon) + i for i, p in enumerate(patterns_of(text, words)) if p])
            yield pd.DataFrame({"hits": out, "toxic": batch["toxic"]})

    seen = rows.mapInPandas(look, "hits array<int>, toxic int").groupBy("hits", "toxic").agg(F.count("*").alias("n")).collect()
    x = np.zeros((len(seen), len(lexicon) + len(PATTERNS)))
    for i, r in enumerate(seen):
        x[i, r["hits"]] = 1
    weight = np.array([r["n"] for r in seen], float)
    # related terms (a word and its beginnings) vote together; the groups are dealt by rank
    voter = np.empty(len(lexicon), int)
    stems: dict[str, int] = {}
    for i, t in enumerate(lexicon):
        voter[i] = stems.setdefault(t.rstrip("*")[: BEGINNINGS[0]], len(stems) % VOTERS)
    said = np.array([r["toxic"] for r in seen])
    lexical = [x[:, : len(lexicon)][:, voter == v].any(axis=1) for v in range(VOTERS)]
    votes = np.stack([said == 1, *lexical, *(x[:, len(lexicon) :] > 0).T], axis=1).astype(int)
    used = votes.any(axis=0) & ~votes.all(axis=0)
    post, _, _ = label_model(votes[:, used], weight, 0, bad / (bad + good))
    w = _logistic(x, post, weight)
    return Model(float(w[-1]), dict(zip(lexicon, w[: len(lexicon)].tolist(), strict=True)), w[len(lexicon) : -1].tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row: the whole text's score, and 1 from 0.5 on.

    A null text counts as empty and gets the bias' score; null ids stay null; repeated rows
    each give a row; other columns are not read; an empty table gives an empty result."""
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    use_package(docs.sparkSession)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_caches()
        for texts in batches:
            yield texts.map(model.score, na_action=None)

    return docs.where(of(docs[text_col]) < 0.5)
