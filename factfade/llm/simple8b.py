"""Token ids in Simple-8b words: files that are written in order and decoded in bulk.

A 64-bit word holds a selector in its upper four bits and as many ids as fit into
the other 60 at the width that the selector names.  Ids of 60 bits and more stand
as 0 in the words and whole in a list of escapes.  A run of ids is cut into blocks
of ``block`` ids; no word crosses a block, and the payload lists where the words
of each block begin, so blocks can be decoded apart or all at once.

Payload (little endian): ids u64, block size u32, escapes u32, first word of each
block u64, words u64, places of escapes u64, values of escapes u64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfade.llm.tokens import ENCODED_CHARS, encode_bytes, text_slices
from factfade.session import materialize

BLOCK = 1024
_DECODED_AT_ONCE = 128

# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_LIMIT = 1 << 60


_SHORT = np.array([int(i).bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id (below 2**60) needs."""
    out = _SHORT[ids & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        high = ids >> np.uint64(shift)
        if not high.any():
            break
        some = high > 0
        out[some] = _SHORT[high[some] & np.uint64(0xFFFF)] + np.uint8(shift)
    return out


def _selectors(widest: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Selector of the word that would begin at each place; ``widest`` is used up."""
    n = len(widest)
    selector, reach = np.full(n, 15, np.uint8), 1
    for code in range(14, -1, -1):
        count, width = int(COUNTS[code]), int(WIDTHS[code])
        while reach < count < n:  # largest width among the next ``count`` ids
            step = min(reach, count - reach)
            np.maximum(widest[: n - step], widest[step:], out=widest[: n - step])
            reach += step
        fits = (widest <= width) & (room >= count)
        if not fits.any():  # longer words are narrower still
            break
        np.copyto(selector, np.uint8(code), where=fits)
    return selector


def pack(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """One payload for each run of ``lengths`` consecutive ids."""
    ids = ids.astype(np.uint64)
    lengths = np.asarray(lengths, np.int64)
    escaped = np.flatnonzero(ids >= _LIMIT)
    plain = ids
    if len(escaped):
        plain = ids.copy()
        plain[escaped] = 0
    n = len(ids)
    starts = np.cumsum(lengths) - lengths
    n_blocks = -(-lengths // block)
    block_no = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begins = np.repeat(starts, n_blocks) + block_no * block
    ends = np.append(begins[1:], n)
    sizes = ends - begins
    # Ids from each place to the end of its block, 255 standing for more.
    room = np.minimum(np.repeat(ends, sizes) - np.arange(n), 255).astype(np.uint8)
    selector = _selectors(_bits(plain), room)
    # All blocks take their next word at the same time.
    at, place, end = [], begins, ends
    while len(place):
        at.append(place)
        place = place + COUNTS[selector[place]]
        open_ = place < end
        place, end = place[open_], end[open_]
    at = np.sort(np.concatenate(at)) if at else np.zeros(0, np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for code in np.unique(chosen):
        width, count = int(WIDTHS[code]), int(COUNTS[code])
        if width:
            rows = np.flatnonzero(chosen == code)
            first = at[rows]
            word = plain[first]
            for k in range(1, count):
                word |= plain[first + k] << np.uint64(k * width)
            words[rows] |= word
    low = np.searchsorted(at, starts)
    high = np.searchsorted(at, starts + lengths)
    first_word = np.searchsorted(at, begins)
    last_block = np.cumsum(n_blocks)
    out = []
    for k, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        offsets = first_word[last_block[k] - n_blocks[k] : last_block[k]] - low[k]
        special = escaped[(escaped >= start) & (escaped < start + length)] if len(escaped) else escaped
        out.append(b"".join((
            struct.pack("<QII", length, block, len(special)),
            offsets.astype("<u8").tobytes(), words[low[k] : high[k]].astype("<u8").tobytes(),
            (special - start).astype("<u8").tobytes(), ids[special].astype("<u8").tobytes(),
        )))
    return out


def _expand(words: np.ndarray) -> np.ndarray:
    """Ids of all words; each of the 16 selectors is one vectorised step."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for code in np.unique(selector):
        width, count = int(WIDTHS[code]), int(COUNTS[code])
        if width:
            rows = np.flatnonzero(selector == code)
            shifts = (np.arange(count) * width).astype(np.uint64)
            mask = np.uint64((1 << width) - 1)
            out[first[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & mask
    return out


def unpack(payload: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of a payload, or of its blocks ``[from, to)`` only."""
    n = int(np.frombuffer(payload, "<u8", 1)[0])
    block, special = (int(x) for x in np.frombuffer(payload, "<u4", 2, 8))
    n_blocks = -(-n // block)
    begins = np.frombuffer(payload, "<u8", n_blocks, 16).astype(np.int64)
    n_words = (len(payload) - 16 - 8 * n_blocks - 16 * special) // 8
    words = np.frombuffer(payload, "<u8", n_words, 16 + 8 * n_blocks)
    low, high = blocks or (0, n_blocks)
    low, high = max(0, low), min(high, n_blocks)
    if low >= high:
        return np.zeros(0, np.uint64)
    end = int(begins[high]) if high < n_blocks else n_words
    out = _expand(words[int(begins[low]) : end])
    if special:
        tail = len(payload) - 16 * special
        places = np.frombuffer(payload, "<u8", special, tail).astype(np.int64) - low * block
        values = np.frombuffer(payload, "<u8", special, tail + 8 * special)
        near = (places >= 0) & (places < len(out))
        out[places[near]] = values[near]
    return out


def unpack_many(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each payload; the words of all are expanded in one go."""
    words, sizes, escapes = [], [], []
    for k, payload in enumerate(payloads):
        n, block, special = struct.unpack_from("<QII", payload)
        begin = 16 + 8 * -(-n // block)
        words.append(payload[begin : len(payload) - 16 * special])
        sizes.append(n)
        if special:
            escapes.append(k)
    ids = _expand(np.frombuffer(b"".join(words), "<u8"))
    out = np.split(ids, np.cumsum(sizes)[:-1]) if sizes else []
    for k in escapes:
        out[k] = unpack(payloads[k])
    return out


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the ids in ascending doc_id order.

    The files lie in the shared folder; the DataFrame given back reads them:
    ``shard`` (number of the file in order), ``seq`` (place in it), ``doc_id``,
    ``first`` (ids before the document in its shard) and ``payload``.

    NULL and empty texts hold only ``end_id``.  Rows without doc_id come first.
    Repeated rows are documents of their own, equal ids ordered by the text.  A text
    of any length is one payload of many blocks.  An empty table writes no row; other
    columns are not read.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, some in text_slices(texts, ENCODED_CHARS):
                coded = [b + ending for b in encode_bytes(tokenizer, some)]
                lengths = np.array([len(b) // 4 for b in coded], np.int64)
                payloads = pack(np.frombuffer(b"".join(coded), "<u4"), lengths, block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), shard, np.int64)),
                        pa.array(np.arange(seq, seq + len(some))),
                        batch.column("doc_id").slice(at, len(some)),
                        pa.array(first + np.cumsum(lengths) - lengths),
                        pa.array(payloads, pa.binary()),
                    ],
                    ["shard", "seq", "doc_id", "first", "payload"],
                )
                seq += len(some)
                first += int(lengths.sum())

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    rows = ordered.mapInArrow(
        encode, "shard long, seq long, doc_id long, first long, payload binary"
    )
    return materialize(rows, "simple8b")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    A shard's ids begin after those of all earlier shards: one row per shard meets
    in the running sum.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [], []
            payloads = batch.column("payload").to_pylist()
            for first in range(0, len(payloads), _DECODED_AT_ONCE):
                for ids in unpack_many(payloads[first : first + _DECODED_AT_ONCE]):
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard"), batch.column("doc_id"), batch.column("first"),
                    pa.array(counts, pa.int64()), pa.array(sums, pa.int64()),
                ],
                ["shard", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    decoded = files.mapInArrow(
        decode, "shard long, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return decoded


def shard_starts(decoded: DataFrame) -> DataFrame:
    """(shard, before): ids in all earlier shards."""
    totals = decoded.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded once from the files."""
    decoded = materialize(read_ids(files), "decoded-ids")
    return decoded.join(F.broadcast(shard_starts(decoded)), "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
