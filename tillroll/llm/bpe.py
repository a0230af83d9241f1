"""Byte-level BPE in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round looks up every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each
word (segmented minimum) and merges all its occurrences; finished words leave the array.
Texts are split into words by the vocabulary's public pattern, special strings first, as
the tokenizer's own default does.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import regex

from tillroll.llm.common import worker_cache

# The split pattern that belongs to this family of vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_RANK = np.iinfo(np.int64).max
ROUND_SYMBOLS = 1 << 20  # symbols handled in one flat array
LONG_WORD = 1024  # bytes; longer words are merged with a heap, in n log n


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next free character from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_split() -> tuple[re.Pattern, re.Pattern]:
    """(PATTERN for texts of characters below U+0250, what finds other characters). The
    standard library's expressions have no classes of letters and numbers, so that theirs
    are spelt out for these characters; they run more than twice as fast."""
    chars = [chr(c) for c in range(0x250)]
    letters, numbers, blanks = ("".join(re.escape(c) for c in chars if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s"))
    split = f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
    return re.compile(split), re.compile(f"[^{chars[0]}-{chars[-1]}]")


class ByteBPE:
    """Merges, tokens and special strings of a byte-level BPE file (tokenizers' JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for text, i in self.specials.items():
            self.token_bytes[i] = text.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = size
        keys = left * size + right
        keys, first = np.unique(keys, return_index=True)  # the first of equal pairs has the lowest rank
        self.pair_keys, self.pair_ranks = keys, first.astype(np.int64)
        self.made_by_rank = made
        self.pairs = dict(zip(keys.tolist(), zip(first.tolist(), made[first].tolist(), strict=True), strict=True))
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self._split_any = regex.compile(PATTERN)
        self._split_latin, self._other = latin_split()

    # ---- text to words ----

    def _split(self, text: str) -> list[str]:
        return (self._split_any if self._other.search(text) else self._split_latin).findall(text)

    def words(self, text: str) -> list[str]:
        """The words of ``text``; a special string is a word of its own."""
        if not any(s in text for s in self.specials):
            return self._split(text)
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._split(text[at:])

    # ---- words to ids ----

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_RANK where there is no merge."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one behind the other, number of ids of each word)."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        alone = sizes > LONG_WORD
        for i, w in enumerate(words) if self.specials else ():
            alone[i] |= w in self.specials
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # places, sizes, ids
        for i in np.flatnonzero(alone).tolist():
            ids = np.array([self.specials[words[i]]], np.int64) if words[i] in self.specials else self._encode_long(raw[i])
            found.append((np.array([i]), np.array([len(ids)]), ids))
        short = np.flatnonzero(~alone)
        upto = np.cumsum(sizes[short])
        for part in np.split(short, np.searchsorted(upto, np.arange(ROUND_SYMBOLS, upto[-1], ROUND_SYMBOLS)) if len(short) else []):
            if len(part):
                self._rounds(b"".join([raw[i] for i in part.tolist()]), sizes[part], part, found)
        where, counts, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(where)
        return gather(ids, (np.cumsum(counts) - counts)[order], counts[order]).astype(np.int32), counts[order]

    def _rounds(self, raw: bytes, sizes: np.ndarray, where: np.ndarray, found: list) -> None:
        sym = self.byte_ids[np.frombuffer(raw, np.uint8)]
        starts = np.cumsum(sizes) - sizes
        rank = np.full(len(sym), NO_RANK)  # of the pair that begins at each symbol
        inner = np.ones(len(sym), bool)
        inner[starts + sizes - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner] = self.ranks_of(sym[inner], sym[inner + 1])
        while len(sym):
            low = np.minimum.reduceat(rank, starts)
            done = low == NO_RANK
            if done.any():
                keep = np.repeat(~done, sizes)
                found.append((where[done], sizes[done], sym[~keep]))
                sym, rank = sym[keep], rank[keep]
                where, low, sizes = where[~done], low[~done], sizes[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(sym):
                    return
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            # of overlapping occurrences (equal symbols in a run) every second one merges
            run = np.r_[True, np.diff(at) != 1]
            if not run.all():
                order = np.arange(len(at))
                at = at[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
            sym[at] = self.made_by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            gone = np.zeros(len(sym) + 1, np.int64)
            gone[at + 2] = 1
            np.cumsum(gone, out=gone)  # symbols that have gone before each place
            sym, rank = sym[keep], rank[keep]
            sizes = sizes - (gone[starts + sizes] - gone[starts])
            starts = np.cumsum(sizes) - sizes
            at = at - gone[at]
            ends = starts + sizes - 1
            first, last = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
            first[starts], last[ends] = True, True
            rank[at] = NO_RANK
            right = at[~last[at]]
            rank[right] = self.ranks_of(sym[right], sym[right + 1])
            left = at[~first[at]] - 1
            rank[left] = self.ranks_of(sym[left], sym[left + 1])

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """One very long word: a heap of (rank, place) over a linked list of symbols."""
        sym = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n, base, pairs = len(sym), self.base, self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i) for i in range(n - 1) if (p := pairs.get(sym[i] * base + sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i] if sym[i] >= 0 else n
            if j >= n or (p := pairs.get(sym[i] * base + sym[j])) is None or p[0] != rank:
                continue
            sym[i], sym[j] = p[1], -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if p := pairs.get(sym[i] * base + sym[k]):
                    heapq.heappush(heap, (p[0], i))
            if (h := prv[i]) >= 0 and (p := pairs.get(sym[h] * base + sym[i])):
                heapq.heappush(heap, (p[0], h))
        return np.array([s for s in sym if s >= 0], np.int64)

    # ---- ids to text ----

    def byte_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all token bytes, start of each token, length of each token)."""
        sizes = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))
        return np.frombuffer(b"".join(self.token_bytes), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]], sizes


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[s:s+n] one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def known(index: dict[str, int], words: list[str], learn: Callable[[list[str]], None]) -> np.ndarray:
    """The index of each word; ``learn`` adds those that aren't there to it."""
    which = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(which < 0)
    if len(at):
        new = [words[i] for i in at.tolist()]
        learn(list(dict.fromkeys(new)))
        which[at] = np.fromiter(map(index.__getitem__, new), np.int64, len(new))
    return which


class Codec:
    """Encodes batches of texts, remembering the ids of words it has met.

    The memory of words is bounded: beyond ``remember`` words it starts afresh."""

    def __init__(self, path: str, remember: int = 1_200_000) -> None:
        self.bpe = ByteBPE(path)
        self.remember = remember
        self.bytes_flat, self.bytes_start, self.bytes_size = self.bpe.byte_table()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _learn(self, words: list[str]) -> None:
        joined, sizes = self.bpe.encode_words(words)
        n, m = len(self.index), len(words)
        while self.used + len(joined) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > len(self.start):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        self.flat[self.used : self.used + len(joined)] = joined
        self.size[n : n + m] = sizes
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(joined)
        self.index.update(zip(words, range(n, n + m), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids of each text)."""
        words: list[str] = []
        ends = []
        for t in texts:
            words += self.bpe.words(t)
            ends.append(len(words))
        if len(self.index) > self.remember:
            self._forget()
        which = known(self.index, words, self._learn)
        sizes = self.size[which]
        ids = gather(self.flat, self.start[which], sizes)
        upto = np.r_[0, np.cumsum(sizes)][np.array([0, *ends], np.int64)]
        return ids, np.diff(upto)

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all id lists one behind the other, end of each list's bytes)."""
        sizes = self.bytes_size[ids]
        raw = gather(self.bytes_flat, self.bytes_start[ids], sizes).tobytes()
        return raw, np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each id list; bytes that are not UTF-8 become U+FFFD."""
        raw, ends = self.decode_bytes(ids, counts)
        out, at = [], 0
        for end in ends.tolist():
            out.append(raw[at:end].decode("utf-8", "replace"))
            at = end
        return out


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


_CODECS: dict[str, Codec] = worker_cache("codecs")


def codec(path: str) -> Codec:
    """The codec of this Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]
