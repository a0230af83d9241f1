"""Operator 3: removal of long strings that an earlier document has, by suffix sorting.

A byte goes when a string of ``width`` bytes covers it that also starts in a document with
a smaller id. Windows (strings of ``width`` bytes) are grouped by their minimiser, the least
hashed k-mer in them: equal windows have the same one, and neighbouring windows mostly
share theirs, so that a stretch of windows travels as one string.

1. Documents are dealt to slices by id. Each slice reports its distinct minimisers; those of
   a single document anywhere are done with.
2. The slices send the stretches of the others, each distinct string of a slice once, with
   the smallest id that has it. By ranges of minimisers, the suffixes of these strings are
   sorted deep-shallow: multikey quicksort, eight bytes at a time, to a shallow depth, then
   a blind trie for each group whose long common prefix goes on. Equal windows get the
   smallest id of all.
3. These go back to the slices, which mark what an earlier document covers.

A passage that very many documents share is one string of each slice. Between the steps
only hashes and ids are kept, in the checkpoint folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import gather
from tillroll.llm.common import checkpointed, id_and_text, use_package

WIDTH = 50
SLICE_BYTES = 1 << 20  # text of a slice, about
RANGE_BYTES = 1 << 21  # text whose minimisers share a range, about
PIECE_BYTES = 1 << 19  # bytes handled in one array
SHALLOW = 24  # bytes sorted by multikey quicksort

_LAST_ID = 2**63 - 1  # stands for a null id
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1024)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Stretches:
    """The stretches of a piece of concatenated documents: maximal runs of neighbouring
    windows with the same minimiser. Arrays, one element each: ``start`` of the first and
    ``end`` behind the last window, ``owner`` (position in ``ends``), hash ``minimiser`` of
    the minimiser (even) and hash ``content`` of the string."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> None:
        k = max(1, width * 2 // 5)
        n, w = len(buf), width - k + 1
        if n < width:
            self.start = self.end = self.owner = np.zeros(0, np.int64)
            self.minimiser = self.content = np.zeros(0, np.uint64)
            return
        up, down = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        kmer = _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
        # least of each w k-mers, the leftmost of equal ones; the place is in the low bits
        least = (kmer & ~_LOW) | np.arange(len(kmer), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: n - width + 1], least[w - size :]) if w > size else least
        place = (least & _LOW).astype(np.int64)
        lengths = np.diff(np.r_[0, ends])
        left = np.repeat(ends, lengths)[: n - width + 1] - np.arange(n - width + 1)
        at = np.flatnonzero(left >= width)
        place = place[at]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (place[1:] != place[:-1])
        f = np.flatnonzero(first)
        self.start = at[f]
        self.end = at[np.r_[f[1:], len(at)] - 1] + width if len(f) else at[f]
        self.owner = np.searchsorted(ends, self.start, "right")
        self.minimiser = kmer[place[f]] & ~np.uint64(1)
        self.content = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(_BASE))


def pieces(texts: list[bytes], width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, document, offset in it) of pieces of bounded size that hold every window
    of ``texts`` once; a longer text lies in several pieces, which overlap by width - 1."""
    out, held, docs, offsets, size = [], [], [], [], 0

    def close() -> None:
        nonlocal held, docs, offsets, size
        if held:
            out.append((np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), np.array(docs), np.array(offsets)))
        held, docs, offsets, size = [], [], [], 0

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - width + 1), PIECE_BYTES):
            part = t[a : a + PIECE_BYTES + width - 1]
            if size + len(part) > PIECE_BYTES + width:
                close()
            held.append(part)
            docs.append(i)
            offsets.append(a)
            size += len(part)
    close()
    return out


# ---- suffix sorting ----


class BlindTrie:
    """A trie of equally long strings that stores branching bytes only.

    A string is first walked down blindly, comparing no more than the branching bytes;
    one comparison with the leaf it meets gives the common prefix, where it is put in."""

    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [-1, string, members]; inner: [depth, {byte: node}]

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, s, [member]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[1] == s:
            node[2].append(member)
            return
        differ = int.from_bytes(node[1]) ^ int.from_bytes(s)
        common = len(s) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while 0 <= node[0] < common:
            above, node = node, node[1][s[node[0]]]
        leaf = [-1, s, [member]]
        if node[0] == common:
            node[1][s[common]] = leaf
            return
        some = node
        while some[0] >= 0:
            some = next(iter(some[1].values()))
        inner = [common, {some[1][common]: node, s[common]: leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Members by string, in the strings' order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number that sorts like them."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def sort_windows(text: np.ndarray, pos: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the windows text[p : p + width] of ``pos`` with equal ones next to each
    other, and whether each begins a new one. Groups are sorted among themselves by depth."""
    word = _words(text)
    n = len(pos)
    order = np.argsort(word[pos], kind="stable")
    key = word[pos[order]]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    depth = min(8, width)

    def tied() -> tuple[np.ndarray, np.ndarray]:
        """Places that share their group with another one, and their groups."""
        group = np.cumsum(first) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if n else np.zeros(0, bool)
        return np.flatnonzero(several), group

    # shallow: multikey quicksort by words, ties only
    while depth + 8 <= min(shallow, width):
        at, group = tied()
        if not len(at):
            return order, first
        key = word[pos[order[at]] + depth]
        by = np.lexsort((key, group[at]))
        order[at] = order[at][by]
        key, g = key[by], group[at]
        first[at[1:]] |= (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        depth += 8
    if depth >= width:
        return order, first
    # deep: groups that agree in all are found by comparing neighbours, others go to a trie
    at, group = tied()
    if not len(at):
        return order, first
    same = np.ones(len(at), bool)
    for d in [*range(depth, width - 7, 8), max(depth, width - 8)]:
        tail = min(8, width - d)
        key = word[pos[order[at]] + d] >> np.uint64(64 - 8 * tail)
        same[1:] &= key[1:] == key[:-1]
    g = group[at]
    begins = np.r_[True, g[1:] != g[:-1]]
    uneven = np.unique(g[~same & ~begins])
    lo, hi = np.searchsorted(g, uneven), np.searchsorted(g, uneven, "right")
    raw = text.tobytes()
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        members = order[at[a:b]]
        trie = BlindTrie()
        for m, p in zip(members.tolist(), pos[members].tolist(), strict=True):
            trie.add(raw[p + depth : p + width], m)
        leaves = trie.leaves()
        order[at[a:b]] = [m for leaf in leaves for m in leaf]
        starts = np.cumsum([0, *map(len, leaves)])[1:-1]
        first[at[a:b][starts]] = True
    return order, first


def smallest_ids(strings: list[bytes], least: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id of each window of all ``strings`` one behind the other, number of windows
    of each): the least of ``least`` over the strings that hold an equal window."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = sizes - width + 1
    begin = np.cumsum(sizes) - sizes
    pos = gather(np.arange(int(sizes.sum())), begin, windows)
    order, first = sort_windows(np.frombuffer(b"".join(strings), np.uint8), pos, width)
    ids = np.repeat(least, windows)
    if len(order):
        starts = np.flatnonzero(first)
        lowest = np.minimum.reduceat(ids[order], starts)
        ids[order] = np.repeat(lowest, np.diff(np.r_[starts, len(order)]))
    return ids, windows


# ---- on Spark ----


def _slice_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], list]:
    """Ids, texts and nullable ids of a slice's documents, in a fixed order."""
    rows = sorted(zip(table.column("id").to_pylist(), (t.encode() for t in table.column("text").to_pylist()), table.column("doc_id").to_pylist(), strict=True), key=lambda r: r[:2])
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], [r[2] for r in rows]


def _least_and_most(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each distinct key, smallest and largest id that has it)."""
    order = np.lexsort((ids, key))
    k = key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(k)] - 1 if len(k) else starts
    return order[starts], ids[order[starts]], ids[order[ends]]


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _by_range(minimiser: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each minimiser, hashed anew: as the least of many hashes they are small."""
    return ((_mixed(minimiser) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of ``docs``; ``width`` >= 8.

    Texts count as UTF-8 bytes, null as empty; matches do not cross documents. Each byte is
    removed that a string of ``width`` bytes covers which also starts in a document with a
    smaller id; overlaps count, and all is judged on the input. ``spans`` are the maximal
    removed runs (start, end exclusive), ``kept`` the remaining bytes. A text shorter than
    ``width`` stays. Rows that repeat an id count as one document among themselves, rows
    without an id as one that comes last. Other columns are not read; an empty table gives
    an empty result."""
    if width < 8:
        raise ValueError("width must be at least 8")
    use_package(docs.sparkSession)
    base = id_and_text(docs, id_col, text_col).withColumn("id", F.coalesce("doc_id", F.lit(_LAST_ID)))
    total = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    slices, ranges = max(1, total // SLICE_BYTES), max(1, total // RANGE_BYTES)
    dealt = base.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))

    # 1. minimisers of more than one document
    def minimisers(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts, _ = _slice_of(table)
        found, owners = [], []
        for buf, ends, doc, _ in pieces(texts, width):
            s = Stretches(buf, ends, width)
            found.append(s.minimiser)
            owners.append(ids[doc[s.owner]])
        key_of = np.concatenate(found) if found else np.zeros(0, np.uint64)
        at, lo, hi = _least_and_most(key_of, np.concatenate(owners) if owners else np.zeros(0, np.int64))
        part = _by_range(key_of[at], ranges)
        by = np.argsort(part, kind="stable")
        marked, part = (key_of[at] | (lo != hi).astype(np.uint64))[by], part[by]  # odd: several documents have it
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        return pa.table({
            "range": pa.array(part[cuts], pa.int64()),
            "slice": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "hashes": pa.array([_blob(x) for x in np.split(marked, cuts[1:])] if len(cuts) else [], pa.binary()),
        })

    def shared(table: pa.Table) -> pa.Table:
        marked = _joined(table.column("hashes"), "<u8")
        sizes = np.array([len(x) // 8 for x in table.column("hashes").to_pylist()], np.int64)
        owner = np.repeat(table.column("slice").to_numpy(), sizes)
        even = marked & ~np.uint64(1)
        order = np.argsort(even, kind="stable")
        k = even[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        several = np.diff(np.r_[starts, len(k)]) > 1
        several |= np.bitwise_or.reduceat(marked[order], starts) % 2 == 1
        keep = order[np.repeat(several, np.diff(np.r_[starts, len(k)]))]
        keep = keep[np.lexsort((even[keep], owner[keep]))]
        o = owner[keep]
        cuts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
        return pa.table({"slice": pa.array(o[cuts], pa.int64()), "hashes": pa.array([_blob(x) for x in np.split(even[keep], cuts[1:])] if len(cuts) else [], pa.binary())})

    reported = dealt.groupBy("slice").applyInArrow(minimisers, "range long, slice long, hashes binary")
    wanted = checkpointed(reported.groupBy("range").applyInArrow(shared, "slice long, hashes binary"))

    # 2. the stretches around them, sorted by range
    def stretches(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        ids, texts, _ = _slice_of(table)
        hashes = np.sort(_joined(asked.column("hashes"), "<u8"))
        out: dict[str, list] = {n: [] for n in ("range", "slice", "strings", "sizes", "content", "least", "most")}
        for buf, ends, doc, _ in pieces(texts, width):
            s = Stretches(buf, ends, width)
            near = np.minimum(np.searchsorted(hashes, s.minimiser), max(0, len(hashes) - 1))
            at = np.flatnonzero(hashes[near] == s.minimiser) if len(hashes) else np.zeros(0, np.int64)
            pick, lo, hi = _least_and_most(s.content[at], ids[doc[s.owner[at]]])
            at = at[pick]
            part = _by_range(s.minimiser[at], ranges)
            by = np.argsort(part, kind="stable")
            at, lo, hi, part = at[by], lo[by], hi[by], part[by]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.r_[cuts[1:], len(part)] if len(part) else cuts, strict=True):
                own = at[a:b]
                sizes = s.end[own] - s.start[own]
                for name, v in (
                    ("range", int(part[a])), ("slice", key[0].as_py()),
                    ("strings", pa.compress(gather(buf, s.start[own], sizes).tobytes(), codec="zstd", asbytes=True)),
                    ("sizes", _blob(sizes.astype("<u2"))), ("content", _blob(s.content[own])), ("least", _blob(lo[a:b])), ("most", _blob(hi[a:b])),
                ):
                    out[name].append(v)
        return pa.table({n: pa.array(v, pa.int64() if n in ("range", "slice") else pa.binary()) for n, v in out.items()})

    def earliest(table: pa.Table) -> pa.Table:
        """For each slice and string: where in it the smallest id changes, and to what."""
        sizes = _joined(table.column("sizes"), "<u2").astype(np.int64)
        per_row = [len(x) // 2 for x in table.column("sizes").to_pylist()]
        content, least, most = _joined(table.column("content"), "<u8"), _joined(table.column("least"), "<i8"), _joined(table.column("most"), "<i8")
        owner = np.repeat(table.column("slice").to_numpy(), per_row)
        raw, at = [], 0
        for blob, n in zip(table.column("strings").to_pylist(), per_row, strict=True):
            own = sizes[at : at + n]
            flat = pa.decompress(blob, decompressed_size=int(own.sum()), codec="zstd", asbytes=True)
            ends = np.cumsum(own).tolist()
            raw += [flat[e - k : e] for e, k in zip(ends, own.tolist(), strict=True)]
            at += n
        number = {t: i for i, t in enumerate(dict.fromkeys(raw))}
        which = np.fromiter(map(number.__getitem__, raw), np.int64, len(raw))
        lowest = np.full(len(number), _LAST_ID)
        np.minimum.at(lowest, which, least)
        ids, windows = smallest_ids(list(number), lowest, width)
        begin = np.cumsum(windows) - windows
        change = np.ones(len(ids), bool)
        change[1:] = ids[1:] != ids[:-1]
        change[begin] = True
        runs = np.flatnonzero(change)
        run_string = np.searchsorted(begin, runs, "right") - 1
        run_from = runs - begin[run_string]
        first_run = np.searchsorted(runs, begin)
        n_runs = np.diff(np.r_[first_run, len(runs)])
        tell = np.minimum.reduceat(ids, begin)[which] < most  # an earlier one for some document
        tell = np.flatnonzero(tell)
        tell = tell[np.argsort(owner[tell], kind="stable")]
        o = owner[tell]
        cuts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, np.int64)
        out: dict[str, list] = {n: [] for n in ("slice", "content", "froms", "ids")}
        for a, b in zip(cuts, np.r_[cuts[1:], len(o)] if len(o) else cuts, strict=True):
            n = n_runs[which[tell[a:b]]]
            every = gather(np.arange(len(runs)), first_run[which[tell[a:b]]], n)
            out["slice"].append(int(o[a]))
            out["content"].append(_blob(np.repeat(content[tell[a:b]], n)))
            out["froms"].append(_blob(run_from[every].astype("<u2")))
            out["ids"].append(_blob(ids[runs[every]]))
        return pa.table({n: pa.array(v, pa.int64() if n == "slice" else pa.binary()) for n, v in out.items()})

    sent = dealt.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInArrow(
        stretches, "range long, slice long, strings binary, sizes binary, content binary, least binary, most binary"
    )
    answers = checkpointed(sent.groupBy("range").applyInArrow(earliest, "slice long, content binary, froms binary, ids binary"))

    # 3. what an earlier document covers
    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, shown = _slice_of(table)
        content, froms, lowest = _joined(told.column("content"), "<u8"), _joined(told.column("froms"), "<u2").astype(np.int64), _joined(told.column("ids"), "<i8")
        by = np.lexsort((froms, content))
        content, froms, lowest = content[by], froms[by], lowest[by]
        marks = [np.zeros(len(t) + 1, np.int32) for t in texts]
        for buf, ends, doc, offset in pieces(texts, width):
            s = Stretches(buf, ends, width)
            a = np.searchsorted(content, s.content)
            n = np.searchsorted(content, s.content, "right") - a
            at = np.repeat(np.arange(len(n)), n)  # stretch of each run
            run = gather(np.arange(len(content)), a, n)
            last = np.ones(len(run), bool)
            last[:-1] = at[1:] != at[:-1]
            windows = s.end[at] - s.start[at] - width + 1
            until = np.where(last, windows, np.r_[froms[run][1:], 0] if len(run) else windows)
            hit = lowest[run] < ids[doc[s.owner[at]]]
            at, lo, hi = at[hit], froms[run][hit], until[hit]
            own = s.owner[at]
            shift = offset[own] - np.r_[0, ends][own]
            lo, hi, whose = s.start[at] + lo + shift, s.start[at] + hi - 1 + width + shift, doc[own]
            for d in np.unique(whose).tolist():
                of = whose == d
                np.add.at(marks[d], lo[of], 1)
                np.add.at(marks[d], hi[of], -1)
        n_bytes, n_removed, spans, kept = [], [], [], []
        for t, m in zip(texts, marks, strict=True):
            gone = np.cumsum(m[:-1]) > 0
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            n_bytes.append(len(t))
            n_removed.append(int(gone.sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes() if len(a) else t)
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": pa.array(shown, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pair), "kept": pa.array(kept, pa.binary()),
        })

    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    )


def digests(cut: DataFrame) -> DataFrame:
    """The rows with the number of spans and the SHA-256 of the kept bytes."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
