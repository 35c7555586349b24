"""Sum-of-squares packing of tokenised documents into fixed windows.

Online and narrow: each input partition is tokenised and packed as it streams through its task, so
no token is shuffled. A document gives full windows at once; its remainder goes to the fill level
h that minimises the sum over levels of the squared number of open windows, which a level array
tracks. Windows still open at the end of the partition (or beyond ``max_open``) are closed by
cutting pieces: the emptiest are poured into the fullest, and the last rest is cut at powers of
two, lengths that need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.bpe import ID_BYTES, encoder

WINDOW = 2048
END_ID = 1
MAX_OPEN = 2048
PARTITION_BITS = 33
WINDOWS_PER_BATCH = 256
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: A piece: document id, ids of the document before it, its ids as bytes, ids of the document.
Piece = tuple[object, int, bytes, int]


def cut(piece: Piece, length: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    at = length * ID_BYTES
    return (doc, start, ids[:at], total), (doc, start + length, ids[at:], total)


def n_ids(piece: Piece) -> int:
    return len(piece[2]) // ID_BYTES


class SumOfSquares:
    """Packs pieces into windows; ``done`` collects (sequence number, pieces) of closed windows."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows at each fill; the last stays 0
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = self.n_closed = 0
        self.done: list[tuple[int, list[Piece]]] = []

    def close(self, pieces: list[Piece]) -> None:
        self.done.append((self.n_closed, pieces))
        self.n_closed += 1

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        full = n_ids(piece) // self.window
        for first in range(0, full * self.window, self.window):
            self.close([(doc, start + first, ids[first * ID_BYTES : (first + self.window) * ID_BYTES], total)])
        if size := n_ids(piece) - full * self.window:
            self._place((doc, start + full * self.window, ids[full * self.window * ID_BYTES :], total), size)
        if self.n_open > self.max_open:
            self.finish(last=False)

    def _place(self, piece: Piece, size: int) -> None:
        """The level with the least change of the sum of squares; of equals the fullest."""
        last = self.window - size
        change = np.where(self.levels[: last + 1] > 0, 1 - 2 * self.levels[: last + 1], self.window << 32)
        change[0] = 0
        change[:last] += 1 + 2 * self.levels[size : self.window]
        level = last - int(np.argmin(change[::-1]))
        pieces: list[Piece] = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            self.close(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
            self.levels[level + size] += 1
            self.n_open += 1

    def finish(self, last: bool = True) -> None:
        """Pour the emptiest open windows into the fullest; with ``last``, cut the rest at powers of two."""
        rest = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        first = 0  # the emptiest
        while len(rest) - first > 1:
            fill, pieces = rest.pop()
            while fill < self.window and first < len(rest):
                donor = rest[first][1]
                piece = donor.pop()
                if n_ids(piece) > self.window - fill:
                    piece, back = cut(piece, self.window - fill)
                    donor.append(back)
                pieces.append(piece)
                fill += n_ids(piece)
                first += not donor
            if fill < self.window:
                rest.append((fill, pieces))
                break
            self.close(pieces)
        for _, pieces in rest[first:]:
            if not last:
                fill = sum(map(n_ids, pieces))
                self.open.setdefault(fill, []).append(pieces)
                self.levels[fill] += 1
                self.n_open += 1
            else:
                self._powers(pieces)

    def _powers(self, pieces: list[Piece]) -> None:
        left, queue = sum(map(n_ids, pieces)), list(reversed(pieces))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                piece = queue.pop()
                if n_ids(piece) > room:
                    piece, back = cut(piece, room)
                    queue.append(back)
                taken.append(piece)
                room -= n_ids(piece)
            self.close(taken)


def packed_rows(done: list[tuple[int, list[Piece]]], first_id: int) -> Iterator[tuple]:
    for number, pieces in done:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // ID_BYTES
            yield doc, start, length, zlib.crc32(ids), total, first_id + number, offset
            offset += length


def packed_batches(
    batches: Iterator[pa.RecordBatch], encode: Callable[[str | None], bytes], packer: SumOfSquares, ending: bytes, first_id: int
) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces of one partition. Closed windows hold their ids until they are given, so few wait."""
    id_type = None

    def flush() -> Iterator[pa.RecordBatch]:
        columns = list(zip(*packed_rows(packer.done, first_id), strict=True))
        packer.done = []
        if columns:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], FIELDS
            )

    for batch in batches:
        id_type = batch.schema.field(0).type
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encode(text.as_py()) + ending
            packer.add((doc.as_py(), 0, ids, len(ids) // ID_BYTES))
            if len(packer.done) >= WINDOWS_PER_BATCH:
                yield from flush()
    packer.finish()
    yield from flush()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer_path`` is a byte-level BPE file that every executor can open. Each document's ids are
    followed by ``end_id``, so a null or empty text is one id long. Other columns are ignored; repeated
    rows and null ids are packed like any other row; an empty table gives no rows. ``sequence_id`` is
    the number of the input partition and of the window in it. At most ``max_open`` windows are held.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ending = np.array([end_id], dtype="<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id = TaskContext.get().partitionId() << PARTITION_BITS
        return packed_batches(batches, encoder(tokenizer_path).encode, SumOfSquares(window, max_open), ending, first_id)

    longs = ", ".join(f"{f} long" for f in FIELDS[1:])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        packed, f"doc_id {id_type}, {longs}"
    )
