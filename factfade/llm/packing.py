"""Documents packed into sequences by bounded-space online best fit.

Each task keeps a fixed number of open sequences in a bitset over their free space.
A piece goes into the open sequence with the least space that still holds it; where
none does, a new one is opened, and of too many the fullest is closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.llm.tokens import ENCODED_CHARS, encode_bytes, text_slices
from factfade.session import materialize

ROOM = 1024
OPEN_BINS = 2048
#: Pieces that one task packs, about: what a task leaves open at its end is wasted.
TASK_PIECES = 100_000


class BestFit:
    """Open bins by free space; ``place`` answers (bin, offset) at once."""

    def __init__(self, room: int, open_bins: int):
        self.room, self.most = room, open_bins
        self.free = 0  # bit f is set while some open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(room + 1)]
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.room:
            raise ValueError(f"a piece of {size} does not fit into {self.room}")
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:  # the fullest has the least space left
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.room, self.made
            self.made += 1
        left = space - size
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.room - space

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def cut(n_tokens: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but, if need be, the first."""
    first = n_tokens % room or min(n_tokens, room)
    return [(0, first)] + [(s, room) for s in range(first, n_tokens, room)] if n_tokens else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document (doc_id, text)."""
    ending = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, some in text_slices(batch.column("text").to_pylist(), ENCODED_CHARS):
                rows: list[list] = [[], [], [], [], []]
                for k, coded in enumerate(encode_bytes(tokenizer, some)):
                    data = coded + ending
                    for piece, (start, length) in enumerate(cut(len(data) // 4, room)):
                        part = data[4 * start : 4 * (start + length)]
                        for column, value in zip(
                            rows, (ids[at + k], piece, start, length, zlib.crc32(part)), strict=True
                        ):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types, strict=True)], names
                )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(cut_pieces: DataFrame, room: int = ROOM, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length``.

    A task meets at most ``open_bins`` open sequences and keeps nothing else.  Each
    task numbers its own sequences; ids are unique and not consecutive.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, BestFit(room, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            where = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where[:, 0] + base), pa.array(where[:, 1])],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return cut_pieces.mapInArrow(fit, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, room: int = ROOM,
    open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are one piece that holds ``end_id`` alone.  Rows without
    doc_id and repeated rows are documents like any other (a repeated row is packed
    again).  Texts of any length are cut into full sequences and one remainder.  An
    empty table gives no row; other columns are not read.

    The ids are made once and stay where they are; only rows of a few numbers are
    dealt out by a hash of document and piece, ``task_pieces`` to a task.
    """
    cut_pieces = materialize(pieces(docs, tokenizer, end_id, room), "pieces")
    tasks = max(1, -(-cut_pieces.count() // task_pieces))
    lot = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = cut_pieces.repartition(tasks, lot).sortWithinPartitions(
        lot, "doc_id", "piece", "ids_crc32"  # the same arrivals in every run
    )
    return pack(dealt, room, open_bins)
