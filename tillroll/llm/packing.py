"""Operator 4: sum-of-squares online packing of tokenised documents into windows.

Each Spark partition packs its own documents as they come. A document's full windows are
sequences of their own; the rest goes to the open fill level (or a new window) after which
the sum of squared counts of partially filled windows is least. The state is the level
array (one count per fill level) and the pieces of the open windows, of which there are
``most_open`` at most: beyond that, and at the end, the emptiest windows are cut to fill
up the fullest ones, and the single window then left over is cut along the binary digits
of its fill, as windows of a power of two carry no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import codec, slices
from tillroll.llm.common import id_and_text, use_package

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

# a piece: (doc_id, start in the document, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Sum-of-squares packing of pieces into windows of ``window`` tokens.

    Closed sequences collect in ``closed`` until ``take()``."""

    def __init__(self, window: int = 1024, most_open: int = 4096, first_id: int = 0) -> None:
        if window < 2:
            raise ValueError("window must be at least 2")
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.levels = np.zeros(window + 1, np.int64)  # partially filled windows by fill
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.closed: list[tuple[int, list[Piece]]] = []

    def _close(self, pieces: list[Piece]) -> None:
        self.closed.append((self.next_id, pieces))
        self.next_id += 1

    def take(self) -> list[tuple[int, list[Piece]]]:
        out, self.closed = self.closed, []
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Place one document of at least one token."""
        n = len(ids)
        full = n - n % self.window
        for a in range(0, full, self.window):
            self._close([(doc_id, a, ids[a : a + self.window], n)])
        if full < n:
            self._place((doc_id, full, ids[full:], n))

    def _place(self, piece: Piece) -> None:
        size, levels, window = len(piece[2]), self.levels, self.window
        best, cost = 0, 2 * levels[size] + 1  # a new window
        if self.n_open:
            # joining level h takes one window from h and adds one at h + size (none if full)
            here = levels[1 : window - size + 1]
            after = 2 * levels[1 + size : window + 1] + 1
            after[-1:] = 0
            change = np.where(here > 0, after - 2 * here + 1, np.iinfo(np.int64).max)
            h = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest of equal ones
            if change[h] <= cost:
                best = h + 1
        if best:
            pieces = self.open[best].pop()
            levels[best] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        fill = best + size
        if fill == window:
            self._close(pieces)
        else:
            self.open.setdefault(fill, []).append(pieces)
            levels[fill] += 1
            self.n_open += 1
            if self.n_open > self.most_open:
                self._top_up()

    def _top_up(self) -> tuple[int, list[Piece]]:
        """Fill the fullest open windows with cuts of the emptiest; one at most stays open."""
        windows = [(fill, pieces) for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        i, j = 0, len(windows) - 1
        fill, pieces = windows[0] if windows else (0, [])
        while i < j:
            gap, spare = self.window - fill, windows[j][1]
            doc, start, ids, n = spare.pop()
            if len(ids) > gap:
                spare.append((doc, start + gap, ids[gap:], n))
                ids = ids[:gap]
            pieces.append((doc, start, ids, n))
            fill += len(ids)
            windows[j] = (windows[j][0] - len(ids), spare)
            if not spare:
                j -= 1
            if fill == self.window:
                self._close(pieces)
                i += 1
                fill, pieces = windows[i] if i <= j else (0, [])
        self.open, self.n_open = ({fill: [pieces]}, 1) if fill else ({}, 0)
        self.levels[:] = 0
        self.levels[fill] = self.n_open
        return fill, pieces

    def finish(self) -> None:
        """Close what is open."""
        fill, pieces = self._top_up()
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        for bit in range(fill.bit_length() - 1, -1, -1):
            want = fill & 1 << bit
            part: list[Piece] = []
            while want:
                doc, start, ids, n = pieces.pop(0)
                if len(ids) > want:
                    pieces.insert(0, (doc, start + want, ids[want:], n))
                    ids = ids[:want]
                part.append((doc, start, ids, n))
                want -= len(ids)
            if part:
                self._close(part)


def _rows(closed: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _ARROW]
    for sequence, pieces in closed:
        at = 0
        for doc, start, ids, n in pieces:
            for col, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), n, sequence, at), strict=True):
                col.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack(
    docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, most_open: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; a
    document is its tokens (byte-level BPE file ``path``) and then ``end_id``. Every token
    lies in exactly one piece; sequences hold at most ``window`` tokens and their offsets
    are gapless from 0. A null or empty text is the ``end_id`` alone; null ids stay null;
    each row, repeated or not, is a document of its own; an empty table gives an empty
    result; other columns are not read. ``sequence_id`` is unique over the whole result:
    the partition's number in the upper bits, a running number below. No shuffle; memory is
    one batch of texts and ``most_open`` windows per task.
    """
    use_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        packer = Packer(window, most_open, TaskContext.get().partitionId() << 33)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids, counts = c.encode(texts[a:b])
                at = 0
                for key, n in zip(keys[a:b], counts.tolist(), strict=True):
                    packer.add(key, np.append(ids[at : at + n], np.int32(end_id)))
                    at += n
                if packer.closed:
                    yield _rows(packer.take())
        packer.finish()
        yield _rows(packer.take())

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
