"""Operator 9: substring dedup by sliding sentence spans.

Every run of ``run`` consecutive sentences is hashed; the hashes are joined globally, and a
sentence goes when a non-first occurrence of a repeated span covers it. Very short
sentences are taken together with the ones behind them, so that a span says something, and
long ones are cut into parts at places that the words around them choose.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import keyed, release_caches, stored, use_package, written

RUN = 3  # sentences in a span
LEAST_WORDS = 4  # words of a sentence; shorter ones are joined with what follows

#: Marks that end a clause without white space behind them: CJK, Indic, Arabic, Ethiopic,
#: Myanmar, Khmer, Tibetan, Armenian, Mongolian.
_MARKS = "。．｡！？；：，、､…‥‼⁇⁈⁉।॥؟۔؛،።፣፤፥፦፧፨။၊។៕៖།༎։᠂᠃"
_ASCII_END = re.compile(r"(?<=[.!?,;:])\s+|\n\s*")
_END = re.compile(rf"(?<=[.!?,;:])\s+|\n\s*|(?<=[{_MARKS}])[”’»」』）】》〉]*\s*")

# A word is what stands between white space, and counts _SIZE. In scripts without white space
# each character counts (about two to a word in Han and Kana, four in Thai and its like), and
# so it does in a run of more than _LONG characters without white space.
_SIZE, _LONG = 4, 64
_HAN = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_THAI = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\ua9e0-\ua9ff\uaa60-\uaa7f"
_JOINED = "".join(chr(c) for c in range(0x300, 0x3100) if unicodedata.category(chr(c))[0] == "M") + "\u200d\ufe0e\ufe0f"
_WORD = re.compile(r"\s*\S+\s*")
_WIDE = re.compile(rf"[{_HAN}{_THAI}]")
_PIECE = re.compile(rf"\s*(?:([{_HAN}][{_JOINED}]*)|([{_THAI}][{_JOINED}]*)|([^\s{_HAN}{_THAI}]+))\s*")
_CHARACTER = re.compile(rf"\s*\S[{_JOINED}]*\s*")


def _characters_count(text: str) -> bool:
    """Whether there is a character in the text that counts as a word or a part of one."""
    return max(map(len, text.split()), default=0) > _LONG or not text.isascii() and _WIDE.search(text) is not None


def _pieces(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, or its characters where these count, each with the white space
    around it; the size of each."""
    out, sizes = [], []
    for m in _PIECE.finditer(text):
        if m.lastindex == 3 and len(m[3]) > _LONG:
            characters = _CHARACTER.findall(m[0])
            out += characters
            sizes += [1] * len(characters)
        else:
            out.append(m[0])
            sizes.append((_SIZE // 2, _SIZE // 4, _SIZE)[m.lastindex - 1])
    return out, sizes


def _chosen(around: Iterable[Sequence[str]], at: Sequence[int], gap: int) -> list[int]:
    """Of places with the words ``around`` them, at the sizes ``at``, the indices of those that
    are taken: in order of the words' hash, each ``gap`` or more from all taken before. What
    is taken depends on the words close by, not on where the text begins."""
    blocked = bytearray(len(at))
    out = []
    hashes = list(map(xxhash.xxh3_64_intdigest, map(" ".join, around)))
    for i in sorted(range(len(at)), key=hashes.__getitem__):
        if not blocked[i]:
            low, high = bisect_right(at, at[i] - gap), bisect_left(at, at[i] + gap)
            blocked[low:high] = b"\1" * (high - low)
            out.append(i)
    return sorted(out)


def _clause_ends(words: list[str], counts: list[int], at: list[int], gap: int) -> list[int]:
    """The clauses 1, 2, ... (but the last) that end a sentence: all that are ``gap`` or more
    from the text's begin and from other ends, and of ends that are closer those chosen."""
    out = []
    last = len(at) - 2
    k = bisect_left(at, gap, 1)
    while k <= last:
        first = k
        while k < last and at[k + 1] - at[k] < gap:
            k += 1
        k += 1
        if k - first == 1:
            out.append(first)
        else:
            around = [words[max(0, n - 2) : n + 2] for n in counts[first:k]]
            out += [first + i for i in _chosen(around, at[first:k], gap)]
    return out


def _parts(text: str, words: list[str], wide: bool, gap: int) -> list[tuple[int, str]]:
    """(length, normalised text) of the parts of a long sentence, each of ``gap`` or more."""
    if wide:
        pieces, sizes = _pieces(text)
        words = [p.strip().lower() for p in pieces]
        at = list(accumulate(sizes))
    else:
        pieces = _WORD.findall(text)
        at = range(_SIZE, _SIZE * len(pieces) + 1, _SIZE)
    low, high = bisect_left(at, gap), bisect_right(at, at[-1] - gap)
    padded = ["", *words, "", ""]  # two words before and behind each place
    around = zip(padded[low:], padded[low + 1 :], padded[low + 2 :], padded[low + 3 : high + 3])
    ends = [0, *(low + i + 1 for i in _chosen(around, at[low:high], gap)), len(pieces)]
    parts = [("".join(pieces[i:j]), words[i:j]) for i, j in zip(ends, ends[1:])]
    return [(len(x), " ".join(x.lower().split() if wide else own)) for x, own in parts]


def sentences(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of each sentence, in order and without gaps. A sentence
    ends behind one of . ! ? , ; : and white space, behind a mark of another script, or at a
    line break: clauses count as sentences, so that a passage put into the middle of a
    sentence is found but for its edges. Normalised: lower case, single spaces. One with
    fewer than ``least_words`` words is joined with those beside it, and the words around each
    end, not what stands further before, decide which ends stay; one of four times as many
    or more is cut into parts of ``least_words`` or more, at places that the words around
    choose, so that equal passages are cut alike wherever they stand."""
    wide = _characters_count(text)
    gap = least_words * _SIZE
    ends = [0, *[m.end() for m in (_ASCII_END if text.isascii() else _END).finditer(text)], len(text)]
    clauses = [text[a:b] for a, b in zip(ends, ends[1:])]
    if wide:
        cut = [_pieces(x) for x in clauses]
        split = [[p.strip().lower() for p in pieces] for pieces, _ in cut]
        at = [0, *accumulate([sum(sizes) for _, sizes in cut])]
    else:
        split = [x.lower().split() for x in clauses]
        at = [0, *accumulate([_SIZE * len(x) for x in split])]
    words = list(chain.from_iterable(split))
    counts = [0, *accumulate(map(len, split))]
    out: list[tuple[int, int, str]] = []
    taken = [k for k in _clause_ends(words, counts, at, gap) if ends[k] < len(text)]
    for j, k in zip([0, *taken], [*taken, len(ends) - 1]):
        a, b = ends[j], ends[k]
        own = words[counts[j] : counts[k]]
        if at[k] - at[j] >= 4 * gap:
            for n, part in _parts(text[a:b], own, wide, gap):
                out.append((a, a + n, part))
                a += n
        elif a < b:
            out.append((a, b, " ".join(text[a:b].lower().split()) if wide else " ".join(own)))
    return out


def span_hashes(units: list[tuple[int, int, str]], run: int = RUN) -> list[bytes]:
    """The 128-bit hash of each run of ``run`` sentences."""
    return [xxhash.xxh3_128_digest("\n".join([u[2] for u in units[i : i + run]])) for i in range(len(units) - run + 1)]


def removed_sentences(repeated: np.ndarray, n: int, run: int = RUN) -> np.ndarray:
    """Which of ``n`` sentences the ``repeated`` spans (their first sentences) cover."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, repeated, 1)
    np.add.at(gone, np.minimum(repeated + run, n), -1)
    return np.cumsum(gone[:n]) > 0


def _later_copies(hashes: list[bytes]) -> list[int]:
    """The spans that the same text holds before."""
    first: dict[bytes, int] = {}
    return [i for i, h in enumerate(hashes) if first.setdefault(h, i) < i]


_UNITS = "row long, k1 long, k2 long, id long, ends binary, own array<int>, h1 array<long>, h2 array<long>"
_CUTS = "k1 long, k2 long, n_sentences long, n_removed long, spans array<struct<start:long,end:long>>"


def _units(docs: DataFrame, run: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """Of each text the ends of its sentences, its spans' hashes, and which of these it holds
    before; ``row`` numbers the rows. This is the only pass that looks for sentences."""
    base = keyed(docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")), "id", "text")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ends, own, hs, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                units = sentences(text, least_words)
                hashes = span_hashes(units, run)
                ends.append(np.array([u[1] for u in units], np.int32).tobytes())
                own.append(_later_copies(hashes))
                hs += hashes
                sizes.append(len(hashes))
            both = np.frombuffer(b"".join(hs), np.int64)
            at = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(both[i::2])) for i in (0, 1)]
            keys = [batch.column(c) for c in ("k1", "k2", "id")]
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *keys, pa.array(ends, pa.binary()), pa.array(own, pa.list_(pa.int32())), *lists], names=["row", "k1", "k2", "id", "ends", "own", "h1", "h2"])

    return base.select("k1", "k2", "id", "text").mapInArrow(segment, _UNITS)


def _cuts(docs: DataFrame, run: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, n_sentences, n_removed, spans) of each key."""
    use_package(docs.sparkSession)
    with written(_units(docs, run, least_words, id_col, text_col)) as units:
        # rows without an id come last, in order of their keys
        late = F.when(F.col("id").isNull(), F.col("k1")).alias("late")
        spans = units.select("row", "id", late, F.posexplode(F.arrays_zip("h1", "h2")).alias("pos", "h")).select("row", "id", "late", "pos", "h.h1", "h.h2")
        # min and max combine before the shuffle: a span that everyone has is one row per task.
        # A table of its own, so that Spark can split the partition of such a span in the join.
        several = stored(
            spans.groupBy("h1", "h2")
            .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("late").alias("first_late"), F.max("late").alias("last_late"))
            .where("first < last OR first_late < last_late OR (first IS NOT NULL AND first_late IS NOT NULL)")
            .select("h1", "h2", "first", "first_late"),
            "several",
        )
        later = (
            spans.join(several, ["h1", "h2"])
            .where("id > first OR late > first_late OR (id IS NULL AND first IS NOT NULL)")
            .groupBy("row")
            .agg(F.collect_list("pos").alias("repeated"))
        )

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, removed, cuts = [], [], []
                for raw, own, other in zip(*(batch.column(c).to_pylist() for c in ("ends", "own", "repeated")), strict=True):
                    ends = np.frombuffer(raw, np.int32)
                    gone = removed_sentences(np.array([*(own or ()), *(other or ())], np.int64), len(ends), run)
                    n.append(len(ends))
                    removed.append(int(gone.sum()))
                    steps = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))  # begin, end, begin, end, ...
                    at = np.append(0, ends)[steps].tolist()
                    cuts.append([{"start": i, "end": j} for i, j in zip(at[::2], at[1::2])])
                pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, pair)],
                    names=["k1", "k2", "n_sentences", "n_removed", "spans"],
                )

        narrow = units.select("row", "k1", "k2", "ends", "own").join(later, "row", "left").select("k1", "k2", "ends", "own", "repeated")
        return stored(narrow.mapInArrow(cut, _CUTS).dropDuplicates(["k1", "k2"]), "cuts")


def _cut(docs: DataFrame, run: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with n_sentences, n_removed, spans and kept; of no removed sentence
    ``kept`` is null."""
    own = docs.columns
    joined = keyed(docs, id_col, text_col).join(_cuts(docs, run, least_words, id_col, text_col), ["k1", "k2"])

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if text is None or not len(cuts):
                out.append(None)
                continue
            at, kept = 0, []
            for c in cuts:
                kept.append(text[at : c["start"]])
                at = c["end"]
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype=object)

    kept = without(F.when(F.col("n_removed") > 0, F.col(text_col)), F.col("spans"))
    return joined.select(*own, "n_sentences", "n_removed", "spans", kept.alias("kept"))


def dedup_spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, spans, kept) for each row of ``docs``.

    ``kept`` is the text without the sentences that a repeated span covers, unless it is the
    span's first occurrence: the one in the document with the smallest id, first in its
    text. ``spans`` lists the removed stretches (characters, end exclusive). A null text
    counts as empty; a text of fewer than ``run`` sentences has no span and stays. Rows that
    repeat an id count as one document among themselves. Rows without an id come last, in
    order of a hash of their text; those with equal texts count as one document. Other
    columns are not read; an empty table gives an empty result."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    out = _cut(rows, run, least_words, "doc_id", "text")
    return out.select("doc_id", "n_sentences", "n_removed", "spans", F.coalesce("kept", "text").alias("kept"))


def drop_repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the kept text in ``text_col`` and its length in ``length_col`` (where
    there is such a column); rows of which nothing is left go."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    out = _cut(docs.toDF(*names), run, least_words, at[id_col], at[text_col])
    changed = F.col("n_removed") > 0
    cols = []
    for c, n in at.items():
        col = F.col(n)
        if c == text_col:
            col = F.when(changed, F.col("kept")).otherwise(col)
        elif c == length_col:
            col = F.when(changed, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return out.where(~changed | (F.trim("kept") != "")).select(*cols)
