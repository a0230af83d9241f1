"""Operator 7: exact token counts at every prefix of a text, by prefix dynamic programming.

Byte pair encoding has this property: the encoding of a string's prefix is the encoding of
a shorter prefix and one last token, and a split is the encoding exactly when each pair of
neighbouring tokens is what the merges make of the pair. So last[e], the last token of the
prefix of e bytes, is the one token t that ends at e and fits behind last[e - len(t)], and
count[e] = count[e - len(t)] + 1. The tables are filled for all new words of a batch at a
time in numpy, remembered, and strung together into the counts of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.bpe import NO_RANK, ByteBPE, gather, known, slices
from tillroll.llm.common import id_and_text, use_package

FITS_SLOTS = 1 << 20  # remembered pairs of tokens (a direct-mapped table)
TABLE_BYTES = 1 << 19  # bytes of words whose tables are filled together
RUN = 1024  # bytes of a run of a long word; its table is filled beside those of other runs
CONTRACTIONS = ("'re", "'ve", "'ll")  # words that are split when cut after two characters


class PrefixCounter:
    """Counts of ByteBPE tokens at every character of a text."""

    def __init__(self, path: str, remember: int = 400_000) -> None:
        self.bpe = bpe = ByteBPE(path)
        self.remember = remember
        size = bpe.base
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.left, self.right = np.arange(size), np.arange(size)
        made = bpe.made_by_rank
        self.born[made[::-1]] = np.arange(len(made))[::-1]  # the lowest rank of a token
        order = np.argsort(bpe.pair_ranks)
        pairs = bpe.pair_keys[order][::-1]
        self.left[made[bpe.pair_ranks[order]][::-1]] = pairs // size
        self.right[made[bpe.pair_ranks[order]][::-1]] = pairs % size
        # a trie of the tokens as sorted edges (node, byte)
        nodes: dict[bytes, int] = {b"": 0}
        token = [-1]
        edges: list[tuple[int, int]] = []
        special = set(bpe.specials.values())
        for i, raw in enumerate(bpe.token_bytes):
            if i in special or not raw:
                continue
            for n in range(1, len(raw) + 1):
                if raw[:n] not in nodes:
                    nodes[raw[:n]] = len(token)
                    token.append(-1)
                    edges.append((nodes[raw[: n - 1]] * 256 + raw[n - 1], nodes[raw[:n]]))
            token[nodes[raw]] = i
        edges.sort()
        self.edge_keys, self.edge_to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.node_token = np.array(token, np.int64)
        self.token_size = np.fromiter(map(len, bpe.token_bytes), np.int64, len(bpe.token_bytes))
        self.reach = max(len(t) for i, t in enumerate(bpe.token_bytes) if i not in special)  # bytes of the longest token
        self.pair_slot = np.full(FITS_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(FITS_SLOTS, bool)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.lead = np.zeros(1 << 16, bool)  # the word begins with white space
        self.blank = np.zeros(1 << 16, bool)  # the word is white space

    # ---- which tokens may follow each other ----

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the neighbours a, b as they are."""
        key = a * self.bpe.base + b
        slot = (key * 0x9E3779B1 >> 7) % FITS_SLOTS
        known = self.pair_slot[slot] == key
        if not known.all():
            fresh, first = np.unique(key[~known], return_index=True)
            at = np.flatnonzero(~known)[first]
            ok = self._undo(a[at], b[at])
            got = np.empty(len(key), bool)
            got[known] = self.pair_fits[slot[known]]
            got[~known] = ok[np.searchsorted(fresh, key[~known])]
            self.pair_slot[slot[at]], self.pair_fits[slot[at]] = key[at], ok
            # two fresh keys of one slot: the last one stays; its value must be its own
            stays = self.pair_slot[slot[at]] == key[at]
            self.pair_fits[slot[at][stays]] = ok[stays]
            return got
        return self.pair_fits[slot]

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges of a's end and b's begin, latest first; a and b fit if no pair
        that lay across the border would have merged before the merge undone last."""
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), NO_RANK)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            clash = self.bpe.ranks_of(x, y) < limit[live]
            ok[live[clash]] = False
            bx, by = self.born[x], self.born[y]
            more = ~clash & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[more], x[more], y[more], bx[more], by[more]
            of_a = bx > by
            limit[live] = np.where(of_a, bx, by + 1)
            a[live] = np.where(of_a, self.right[x], x)
            b[live] = np.where(of_a, y, self.left[y])
        return ok

    # ---- tables of words ----

    def tables(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts at every byte of all words one behind the other, sizes)."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        short = sizes <= 4 * (RUN + self.reach)
        if short.all():
            return self._fill(raw)[1], sizes
        near = np.cumsum(np.where(short, sizes, 0))
        counts = self._fill([w for w, s in zip(raw, short.tolist(), strict=True) if s])[1] if short.any() else np.zeros(0, np.int32)
        each = [counts[b - n : b] if s else self._long(w) for w, n, b, s in zip(raw, sizes.tolist(), near.tolist(), short.tolist(), strict=True)]
        return np.concatenate(each), sizes

    def _long(self, word: bytes) -> np.ndarray:
        """Counts at every byte of a long word, whose runs are filled side by side.

        Each run starts some bytes early, as if the word began there. A last token depends on
        the text and on the last tokens of as many bytes before as the longest token has: once
        these agree with the word's own, so do all that follow. Where they don't, the run is
        filled again behind the word's own last tokens. A count is the length of the chain of
        last tokens, added up by pointer doubling."""
        early = 4 * self.reach
        last = np.zeros(len(word), np.int64)
        group = TABLE_BYTES // (RUN + early)
        begins = list(range(0, len(word), RUN))
        for g in range(0, len(begins), group):
            own = begins[g : g + group]
            pieces = [word[max(0, b - early) : b + RUN] for b in own]
            filled, at = self._fill(pieces)[0], 0
            for b, piece in zip(own, pieces, strict=True):
                got = filled[at : at + len(piece)]
                at += len(piece)
                behind = len(piece) - len(word[b : b + RUN])  # bytes before the run
                if b and (behind < early or not np.array_equal(got[behind - self.reach : behind], last[b - self.reach : b])):
                    behind = self.reach
                    got = self._fill([word[b - behind : b + RUN]], last[b - behind : b])[0]
                last[b : b + RUN] = got[behind:]
        count = np.ones(len(word), np.int32)
        jump = np.arange(len(word)) - self.token_size[last]
        live = np.flatnonzero(jump >= 0)
        while len(live):
            to = jump[live]
            more, jump[live] = count[to], jump[to]
            count[live] += more
            live = live[jump[live] >= 0]
        return count

    def _fill(self, raw: list[bytes], given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(last tokens, counts) at every byte of all words one behind the other. ``given``: the
        last tokens of the first bytes of a single word, whose counts then mean nothing."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-sizes, kind="stable")  # longest first: active words are a prefix
        sizes_o = sizes[order]
        text = np.frombuffer(b"".join([raw[i] for i in order.tolist()]), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes_o) - sizes_o
        in_word = np.arange(len(text)) - np.repeat(begin, sizes_o)
        left = np.repeat(sizes_o, sizes_o) - in_word  # bytes from here to the word's end
        # every token that begins at every place
        place, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        ends, lens, toks = [], [], []
        n = 0
        while len(place):
            key = node * 256 + text[place + n]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            there = self.edge_keys[at] == key
            place, node = place[there], self.edge_to[at[there]]
            n += 1
            tok = self.node_token[node]
            hit = tok >= 0
            ends.append(place[hit] + n - 1)
            lens.append(np.full(int(hit.sum()), n))
            toks.append(tok[hit])
            more = left[place] > n
            place, node = place[more], node[more]
        end, length, tok = (np.concatenate(x) for x in (ends, lens, toks))
        by = np.lexsort((-length, end))
        end, length, tok = end[by], length[by], tok[by]
        first = np.searchsorted(end, np.arange(len(text) + 1))  # candidates of each end
        count, last = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
        active = len(raw)
        if given is not None:
            last[: len(given)] = given
        for e in range(0 if given is None else len(given), int(sizes_o[0]) if len(sizes_o) else 0):
            while sizes_o[active - 1] <= e:
                active -= 1
            todo = begin[:active] + e
            pick = first[todo].copy()
            while len(todo):
                t, ln = tok[pick], length[pick]
                before = todo - ln
                whole = ln == e + 1
                good = whole.copy()
                inner = np.flatnonzero(~whole)
                good[inner] = self.fits(last[before[inner]], t[inner])
                done = todo[good]
                last[done] = t[good]
                count[done] = np.where(whole[good], 1, count[np.maximum(before[good], 0)] + 1)
                todo, pick = todo[~good], pick[~good] + 1
        back = np.argsort(order)
        return gather(last, begin[back], sizes), gather(count, begin[back], sizes)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        upto = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        cuts = [0, *np.unique(np.searchsorted(upto, np.arange(TABLE_BYTES, upto[-1], TABLE_BYTES)) + 1).tolist(), len(raw)]
        flat, sizes = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            counts, _ = self.tables(raw[a:b])
            text = np.frombuffer(b"".join(raw[a:b]), np.uint8)
            char_end = np.r_[(text[1:] & 0xC0) != 0x80, True]  # the next byte begins a character
            flat.append(counts[char_end])
            sizes.append(np.fromiter(map(len, words[a:b]), np.int64, b - a))
        joined, n_chars = np.concatenate(flat), np.concatenate(sizes)
        starts = np.cumsum(n_chars) - n_chars
        for w in CONTRACTIONS:
            if w in words:
                joined[starts[words.index(w)] + 1] = 2
        n, m = len(self.index), len(words)
        while self.used + len(joined) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while n + m > len(self.start):
            for name in ("start", "size", "lead", "blank"):
                old = getattr(self, name)
                setattr(self, name, np.r_[old, np.zeros_like(old)])
        self.flat[self.used : self.used + len(joined)] = joined
        self.start[n : n + m], self.size[n : n + m] = self.used + starts, n_chars
        self.lead[n : n + m] = [w[0].isspace() for w in words]
        self.blank[n : n + m] = [w.isspace() for w in words]
        self.used += len(joined)
        self.index.update(zip(words, range(n, n + m), strict=True))

    def _known(self, words: list[str]) -> np.ndarray:
        return known(self.index, words, self._learn)

    def _total(self, words: list[str]) -> int:
        which = self._known(words)
        return int(self.flat[self.start[which] + self.size[which] - 1].sum())

    # ---- texts ----

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(count at every character of all texts one behind the other, characters of each text)."""
        if len(self.index) > self.remember:
            self._forget()
        words: list[str] = []
        ends = [0]
        special: list[int] = []
        for t in texts:
            own = self.bpe.words(t)
            if self.bpe.specials and any(s in t for s in self.bpe.specials):
                special += [len(words) + i for i, w in enumerate(own) if w in self.bpe.specials]
            words += own
            ends.append(len(words))
        which = self._known(words)
        size, start = self.size[which], self.start[which]
        total = self.flat[start + size - 1].astype(np.int64)
        total[special] = 1
        after = np.cumsum(total)
        text_of_word = np.repeat(np.arange(len(texts)), np.diff(ends))
        text_base = np.r_[0, after][np.array(ends[:-1], np.int64)]
        base = after - total - text_base[text_of_word]  # tokens of the text before each word
        out = gather(self.flat, start, size) + np.repeat(base, size).astype(np.int32)
        at = np.cumsum(size) - size
        # white space before a word belongs to the run before it as long as the text ends there
        lead, blank = self.lead[which], self.blank[which]
        for i in np.flatnonzero(blank[:-1] & lead[1:] & (text_of_word[:-1] == text_of_word[1:])).tolist() if len(words) else ():
            out[at[i + 1]] = base[i] + self._total([words[i] + words[i + 1][0]])
        # a special string counts once it is whole; cut, it is ordinary text behind the last word
        for i in special:
            w = words[i]
            joins = i > ends[text_of_word[i]] and i - 1 not in special
            for n in range(1, len(w)):
                cut = self.bpe.words((words[i - 1] if joins else "") + w[:n])
                out[at[i] + n - 1] = base[i - 1 if joins else i] + self._total(cut)
            out[at[i] + len(w) - 1] = base[i] + 1
        return out, np.fromiter(map(len, texts), np.int64, len(texts))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of this Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored counts."""
    ok = np.flatnonzero(counts <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", keep_counts: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within, prefix_counts) for each row.

    ``n_tokens`` is the number of tokens of the whole text (byte-level BPE file ``path``,
    no added special tokens), ``chars_within`` the length in characters of its longest
    prefix of at most ``limit`` tokens, and ``prefix_counts`` the token count of every
    prefix, as little-endian 32-bit integers, one per character (null unless
    ``keep_counts``): a later budget or truncation question is a look into them
    (``longest_within``). A null text counts as empty (no bytes, no tokens); null ids stay
    null; repeated rows each give a row; an empty table gives an empty result; other
    columns are not read. No shuffle.
    """
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                counts, chars = c.counts(texts[a:b])
                ends = np.cumsum(chars)
                each = np.split(counts, ends[:-1])
                n = [int(x[-1]) if len(x) else 0 for x in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(t.encode()) for t in texts[a:b]], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                        pa.array([len(x) if k <= limit else longest_within(x, limit) for x, k in zip(each, n, strict=True)], pa.int64()),
                        pa.array([x.astype("<i4").tobytes() if keep_counts else None for x in each], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within", "prefix_counts"],
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long, prefix_counts binary"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
