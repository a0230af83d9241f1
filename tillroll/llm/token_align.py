"""Operator 13: cross-tokenizer alignment by merge-path partitioning.

The tokens of a byte-level BPE (A) and of a piece vocabulary (B) end at byte offsets of the
same text. Merging the two ascending lists of ends gives all overlaps: each distinct end
closes one stretch that lies in one A and one B token. Diagonals of the merge path, found by
binary search, divide this merging into independent pieces of equal work, whatever the
lengths of the texts; each piece emits its overlaps and its cuts (ends of both), and the
groups that reach over pieces are stitched by the pieces' running numbers of cuts.

On Spark: one pass encodes and aligns; per slice of documents (a bounded number of links) it
keeps the distinct id pairs with the number of documents that hold them. Pairs are counted
over the corpus from these dictionaries, and each slice is cogrouped with the counts of its
own pairs. No links of single documents are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.bpe import ByteBPE, Codec, slices
from tillroll.llm.common import stored, use_package, worker_cache

WORK = 1 << 14  # ends merged by one piece
SLICE_LINKS = 1 << 20  # a slice of documents is closed at so many links
REMEMBER_WORDS, REMEMBER_IDS = 400_000, 4_000_000  # bounds of a worker's memory of words, of each vocabulary


class PieceBPE:
    """Words, ids and bytes of a sentencepiece file with byte fallback.

    Where no piece has a space behind another character, merges never cross the begin of a
    run of spaces, and words (spaces and what follows) are encoded one by one and remembered;
    else a text is one word. Texts begin with the space that the vocabulary adds."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.space = self.model.piece_to_id("▁")
        self.token_bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self._words = re.compile(r".*" if any("▁" in p.lstrip("▁") for p in pieces) else r" +[^ ]*", re.S)

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return piece.replace("▁", " ").encode()

    def words(self, text: str) -> list[str]:
        return [w for w in self._words.findall(text) if w]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([w[1:] for w in words], num_threads=1)
        ids = [own or [self.space] for own in ids]  # a space with nothing behind it
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.int32, int(sizes.sum())), sizes

    byte_table = ByteBPE.byte_table


class _Side(Codec):
    """A vocabulary's codec with a bounded memory of words; special strings are plain text."""

    def __init__(self, bpe: ByteBPE | PieceBPE) -> None:
        bpe.specials = {}
        self.bpe, self.remember = bpe, REMEMBER_WORDS
        self.bytes_flat, self.bytes_start, self.bytes_size = bpe.byte_table()
        self._forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.used > REMEMBER_IDS:
            self._forget()
        return super().encode(texts)


_SIDES: dict[tuple[str, str], tuple[_Side, _Side]] = worker_cache("sides")


def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side]:
    """The two codecs of this Python worker."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = _Side(ByteBPE(path_a)), _Side(PieceBPE(path_b))
    return _SIDES[path_a, path_b]


# ---- merge path ----


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> np.ndarray:
    """How many of ``a`` are among the first 0, work, 2 * work, ... of ``a`` and ``b`` merged
    (of equal ones, a's first): one binary search on each diagonal, all at once."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        # too few of a, as long as the next of a belongs before the last of b taken
        few = np.zeros(len(d), bool)
        few[open_] = a[mid[open_]] <= b[(d - mid - 1)[open_]]
        low, high = np.where(few, mid + 1, low), np.where(few | ~open_, high, mid)
    return low


def align_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token of each overlap; group of each A token; group of each B token) of two
    ascending lists of ends that close with the same one."""
    at = merge_path(a, b, work)
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    links_a, links_b, groups_a, groups_b = [], [], [], []
    cuts = 0  # of the pieces before: the groups that are closed
    for k in range(len(at) - 1):
        i0, i1, j0, j1 = at[k], at[k + 1], d[k] - at[k], d[k + 1] - at[k + 1]
        own_a, own_b = a[i0:i1], b[j0:j1]
        # ends of A close a stretch of their own token and of the first B that ends there or later
        over = j0 + np.searchsorted(own_b, own_a)
        both = b[np.minimum(over, len(b) - 1)] == own_a
        links_a.append(np.arange(i0, i1))
        links_b.append(over)
        # ends of B likewise, unless an A ends there too; that A may be the last of the piece before
        under = i0 + np.searchsorted(own_a, own_b)
        tie = (under < i1) & (a[np.minimum(under, len(a) - 1)] == own_b)
        carried = bool(len(own_b) and i0 and a[i0 - 1] == own_b[0])
        if carried:
            tie[0] = True
        links_a.append(under[~tie])
        links_b.append(np.arange(j0, j1)[~tie])
        closed = np.cumsum(both)
        groups_a.append(cuts + closed - both)
        group_b = cuts + np.searchsorted(own_a[both], own_b)
        if carried:
            group_b[0] -= 1
        groups_b.append(group_b)
        cuts += int(closed[-1]) if len(closed) else 0
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b, groups_a, groups_b))


# ---- a slice of documents ----


class _Strings:
    """Decimal ids with what may stand behind them."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.size = max(size_a, size_b)
        ids = [str(i) for i in range(self.size)]
        self.table = [f"{i}{mark}" for mark in ",|;" for i in ids]

    def groups(self, ids_a, ids_b, groups_a, groups_b, upto) -> list[str]:
        """The groups' text of each document; ``upto`` are the ends of its tokens of A and B
        together."""
        per_a, per_b = (np.bincount(g, minlength=int(groups_a[-1]) + 1 if len(groups_a) else 0) for g in (groups_a, groups_b))
        flat = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a = np.diff(groups_a, append=-1) != 0
        last_b = np.diff(groups_b, append=-1) != 0
        flat[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[groups_a]] = ids_a + self.size * last_a
        flat[np.arange(len(ids_b)) + np.cumsum(per_a)[groups_b]] = ids_b + 2 * self.size * last_b
        marked = [self.table[c] for c in flat.tolist()]
        return ["".join(marked[i:j])[:-1] for i, j in zip([0, *upto[:-1]], upto)]


def _checked(texts: list[str], side: _Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each text, whether the tokens' bytes are the text's)."""
    ids, counts = side.encode(texts)
    raw, ends = side.decode_bytes(ids, counts)
    starts = [0, *ends.tolist()]
    same = np.array([raw[i:j] == t.encode() for i, j, t in zip(starts, starts[1:], texts)], bool)
    return ids, counts, same


class _Slices:
    """Rows of documents and of dictionaries, slice by slice."""

    FIELDS = [("slice", pa.int64()), ("doc_id", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    FIELDS += [("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))]
    SCHEMA = "slice long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, codes array<long>, holders array<long>"

    def __init__(self, path_a: str, path_b: str, keep_groups: bool, first: int, links: int) -> None:
        self.a, self.b = _sides(path_a, path_b)
        size_a, size_b = len(self.a.bytes_size), len(self.b.bytes_size)
        self.strings, self.base, self.keep_groups, self.number, self.most = _Strings(size_a, size_b), size_b, keep_groups, first, links
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple] = []  # as FIELDS, up to groups
        self.keys: list[np.ndarray] = []  # distinct pairs of each document, one after another
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []  # how many these are
        self.links = 0

    def add(self, doc_ids: list, texts: list[str]) -> None:
        spaced = [f" {t}" if t else "" for t in texts]
        (ids_a, n_a, same_a), (ids_b, n_b, same_b) = _checked(spaced, self.a), _checked(spaced, self.b)
        ok = same_a & same_b
        ids_a, ids_b = ids_a[np.repeat(ok, n_a)].astype(np.int64), ids_b[np.repeat(ok, n_b)].astype(np.int64)
        n_a, n_b = n_a * ok, n_b * ok
        links_a, links_b, groups_a, groups_b = align_ends(np.cumsum(self.a.bytes_size[ids_a]), np.cumsum(self.b.bytes_size[ids_b]))
        docs = np.repeat(np.arange(len(texts)), n_a)
        place = docs[links_a]
        n_links = np.bincount(place, minlength=len(texts))
        space = len(self.a.bytes_size) * self.base
        keys, times = np.unique(place * space + ids_a[links_a] * self.base + ids_b[links_b], return_counts=True)
        self.keys.append(keys % space)
        self.times.append(times.astype(np.int32))
        self.sizes.append(np.bincount(keys // space, minlength=len(texts)))
        text = self.strings.groups(ids_a, ids_b, groups_a, groups_b, np.cumsum(n_a + n_b).tolist())
        ends = np.cumsum(n_a)
        closed = np.append(0, groups_a + 1)[ends]  # groups closed at each document's end
        n_groups = np.diff(closed, prepend=0)
        if not self.keep_groups:
            text = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
        self.rows += zip(doc_ids, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), text, strict=True)
        self.links += int(n_links.sum())

    def full(self) -> bool:
        return self.links >= self.most or len(self.rows) >= 1 << 16

    def take(self) -> pa.RecordBatch:
        """The slice's documents, and its dictionary in a row without a document."""
        keys = np.concatenate(self.keys)
        times, sizes = np.concatenate(self.times), np.concatenate(self.sizes)
        codes, which, holders = np.unique(keys, return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes).tolist()
        spans = list(zip([0, *ends[:-1]], ends))
        which = which.astype(np.int32)
        n = len(self.rows)
        columns = [[self.number] * (n + 1), *([*c, None] for c in zip(*self.rows, strict=True))]
        columns += [[*(x[i:j].tobytes() for i, j in spans), None] for x in (which, times)]
        columns += [[None] * n + [x] for x in (codes, holders)]
        self.number += 1
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, self.FIELDS, strict=True)], names=[n for n, _ in self.FIELDS])


def align(
    docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = True, slice_links: int = SLICE_LINKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each row of ``docs``.

    A space and the text, by the byte-level BPE file ``path_a`` and by the sentencepiece file
    ``path_b`` (which adds that space itself), are cut into groups wherever a token of each
    ends; special strings are plain text. ``groups`` is ``a1,a2|b1;a3|b2,b3`` in decimal ids
    (with ``keep_groups=False`` its SHA-256 in lowercase hex; '' without tokens either way).
    Links are the pairs of A and B tokens whose bytes overlap. The count of an id pair is the
    number of rows that hold it linked; ``n_best`` is how many links have the highest count of
    their A id, ``count_sum`` the sum of the links' counts.

    A null or empty text, or one that the bytes of its tokens do not give back, has no tokens,
    zeros and no groups. Rows that repeat an id or a text are documents of their own; null
    ids stay null. Other columns are not read; an empty table gives an empty result."""
    use_package(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Slices(path_a, path_b, keep_groups, TaskContext.get().partitionId() << 33, slice_links)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in slices(texts, 1 << 19):
                held.add(keys[i:j], texts[i:j])
                if held.full():
                    yield held.take()
        if held.rows:
            yield held.take()

    # numbers of slices hold for one run of a task, so its rows are written before use
    table = stored(rows.mapInArrow(run, _Slices.SCHEMA), "aligned")

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    listed = table.where("codes IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("codes", "holders")).alias("place", "pair"))
    listed = listed.select("slice", "place", F.col("pair.codes").alias("code"), F.col("pair.holders").alias("holders"))
    counts = listed.groupBy("code").agg(F.sum("holders").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("code") / size_b))  # at most one row per B id
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_a))
    known = listed.join(counts, "code").select(F.col("slice").alias("at_slice"), "place", "n", "best")

    def score(own: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        own = own[own["pairs"].notna()]
        n, best = np.zeros(len(counted), np.int64), np.zeros(len(counted), bool)
        n[counted["place"]], best[counted["place"]] = counted["n"], counted["best"]
        n_best, total = [], []
        for pairs, times in zip(own["pairs"], own["times"], strict=True):
            at, t = np.frombuffer(pairs, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
            n_best.append(int(t[best[at]].sum()))
            total.append(int((t * n[at]).sum()))
        return own[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]].assign(n_best=n_best, count_sum=total)

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    own = table.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times").where("pairs IS NOT NULL")
    out = own.groupBy("slice").cogroup(known.groupBy("at_slice")).applyInPandas(score, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
