"""Near copies at a Jaccard similarity of 0.8 over five-word shingles, by wide SimHash.

Four bits of 64 hold copies of about 0.96 only, and no pigeonhole over 64 bits reaches
0.8 with selective keys.  Here a text has a SimHash of 512 bits over the set of its
shingles.  The share of differing bits estimates the angle of two sets and, with their
sizes, their Jaccard similarity (standard error about 0.04 at 0.8); ``LEAST`` lies under 0.8
so that few pairs above 0.8 are lost.

Which texts meet: each text names the ``SKETCH`` smallest hashes of its shingles, the
same choice in every text, so that alike texts name mostly the same ones.  They are
ordered by the number of texts that name them, rare ones first.  Two sketches of ``m``
hashes that share ``SHARED * m`` of them have a common one among their first
``m - SHARED * m + 1``, so only those are keys.  Lines and passages of many documents rank last.
What meets under a key is compared by the 512 bits, and only a spanning forest of the
links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfade.llm.simhash import GROUP, near_duplicates
from factfade.llm.tokens import text_slices
from factfade.llm.words import mixed
from factfade.operators.similarity import connected_components
from factfade.session import materialize

SHINGLE = 5
SEED = 42
SKETCH = 32
SHARED = 0.6
LEAST = 0.75
WIDE = 8  # 64-bit words of a fingerprint
_STEP = 0x9E3779B97F4A7C15
_SMALL = 24
_CHUNK = 1 << 14
_WORDS = [f"w{k}" for k in range(WIDE)]


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """512 bits as eight numbers: a bit is 1 where it is set in over half the hashes."""
    counts = np.zeros(64 * WIDE, np.int64)
    steps = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(_STEP)
    for at in range(0, len(hashes), _CHUNK):
        part = mixed(hashes[at : at + _CHUNK, None] + steps).astype("<u8").view(np.uint8)
        bits = np.unpackbits(part.reshape(-1, 8 * WIDE), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def likeness(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the sets behind fingerprints (rows of ``a``, ``b``)."""
    differing = np.bitwise_count(a ^ b).sum(axis=-1)
    shared = np.cos(np.pi * differing / (64 * WIDE)) * np.sqrt(size_a * size_b)
    shared = np.minimum(shared, np.minimum(size_a, size_b))
    return shared / (size_a + size_b - shared)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(text_hash, n, w0..w7, keys) of each different text that has words.

    ``n`` is the number of different shingles.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, wide = [], [], []
            for _, some in text_slices(batch.column("text").to_pylist()):
                for text in some:
                    hashes = shingle_hashes(text, size)
                    sizes.append(len(hashes))
                    keys.append(hashes[:SKETCH].view(np.int64))
                    wide.append(wide_fingerprint(hashes).view(np.int64))
            table = np.array(wide, np.int64).reshape(-1, WIDE)
            columns = [batch.column("text_hash"), pa.array(np.array(sizes, np.int64))]
            columns += [pa.array(np.ascontiguousarray(table[:, k])) for k in range(WIDE)]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["text_hash", "n", *_WORDS, "keys"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    schema = f"text_hash long, n long, {', '.join(f'{w} long' for w in _WORDS)}, keys array<long>"
    return texts.mapInArrow(sketched, schema).filter("n > 0").dropDuplicates(["text_hash"])


def rare_keys(found: DataFrame) -> DataFrame:
    """(text_hash, key) of the sketches: the first ones of each text by rarity.

    Keys that a single text names come first in the order and meet nothing.
    """
    named = found.select("text_hash", F.size("keys").alias("m"), F.explode("keys").alias("key"))
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    together = Window.partitionBy("text_hash")
    rarest = together.orderBy("texts", "key")
    room = F.col("m") - F.ceil(F.col("m") * F.lit(SHARED)) + 1
    return (
        named.join(counts, "key")
        .withColumn("alone", F.col("m") - F.count(F.lit(1)).over(together))
        .withColumn("rank", F.row_number().over(rarest) + F.col("alone"))
        .filter(F.col("rank") <= room)
        .select("text_hash", "key")
    )


def dealt(keys: DataFrame, group: int = GROUP) -> DataFrame:
    """(text_hash, place): texts that must meet share a place.

    A key of more than ``group`` texts is cut into blocks; every pair of blocks is a place.
    """
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    blocks = F.when(F.col("texts") > group, F.ceil(F.col("texts") / F.lit(group)) + 1).otherwise(F.lit(1))
    rows = keys.join(counts.select("key", blocks.cast("long").alias("blocks")), "key")
    mine = F.pmod(F.xxhash64("text_hash"), F.col("blocks"))
    rows = rows.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    return rows.select(
        "text_hash", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("place")
    )


def _forest(wide: np.ndarray, size: np.ndarray, least: float) -> tuple[list, list]:
    """Links (as row numbers) that connect all rows that link; compares what is left only."""
    a, b, tail = [], [], []
    rest = np.arange(len(size))
    while len(rest):
        tail.append(rest[0])
        rest = rest[1:]
        while tail and len(rest):
            at = tail.pop()
            near = likeness(wide[at], size[at], wide[rest], size[rest]) >= least
            if near.any():
                found = rest[near]
                a += [at] * len(found)
                b += found.tolist()
                tail += list(found)
                rest = rest[~near]
        tail = []
    return a, b


def links(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) of texts (place, text_hash, n, w0..w7) that meet and are alike, enough to
    connect all that are."""

    def compare(place: np.ndarray, ids: np.ndarray, size: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(place)) + 1
        begin = np.concatenate(([0], cuts))
        members = np.diff(np.append(begin, len(place)))
        pairs = [np.zeros((0, 2), np.int64)]
        for k in np.flatnonzero(members > _SMALL):
            own = slice(begin[k], begin[k] + members[k])
            x, y = _forest(wide[own], size[own], least)
            pairs.append(np.stack([ids[own][x], ids[own][y]], axis=1) if x else pairs[0])
        small = np.repeat((members <= _SMALL) & (members > 1), members)
        place, ids, size, wide = place[small], ids[small], size[small], wide[small]
        for lag in range(1, _SMALL):
            at = np.flatnonzero(place[lag:] == place[:-lag])
            if not len(at):
                break
            at = at[likeness(wide[at + lag], size[at + lag], wide[at], size[at]) >= least]
            pairs.append(np.stack([ids[at], ids[at + lag]], axis=1))
        found = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"]
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last place may go on in the next batch
        for batch in batches:
            more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "text_hash", "n")]
            more.append(np.stack(
                [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in _WORDS], axis=1
            ))
            held = [np.concatenate(v) for v in zip(held, more, strict=True)] if held else more
            if len(held[0]) and held[0][0] != held[0][-1]:
                last = int(np.searchsorted(held[0], held[0][-1]))
                yield compare(*(v[:last] for v in held))
                held = [v[last:] for v in held]
        if held and len(held[0]):
            yield compare(*held)

    return (
        rows.select("place", "text_hash", "n", *_WORDS)
        .repartition("place").sortWithinPartitions("place")
        .mapInArrow(scan, "a long, b long").distinct()
    )


def wide_links(docs: DataFrame, least: float = LEAST, size: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(a, b): links of different texts of ``docs`` (text), by xxhash64 of the text."""
    found = materialize(sketches(docs, size), "wide-fingerprints")
    keys = materialize(rare_keys(found), "rare-keys")
    return links(dealt(keys, group).join(found.drop("keys"), "text_hash"), least)


def near_copies(docs: DataFrame, least: float = LEAST, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash, fp and label of every document (doc_id, text).

    ``label`` is one number for all documents that are connected by links of
    ``simhash.near_duplicates`` or by an estimated Jaccard similarity of ``least`` over
    five-word shingles.  NULL, empty and blank texts are linked by the former only, texts
    under five words are one shingle.  Texts of any length are read whole.  Repeated rows and
    equal texts are compared once.  An empty table gives no row; other columns are not read.
    """
    narrow = materialize(near_duplicates(docs).select("doc_id", "text_hash", "fp", "label"), "narrow")
    labels = narrow.select("text_hash", "label").distinct()
    edges = (
        wide_links(docs, least, group=group)
        .join(labels.select(F.col("text_hash").alias("a"), F.col("label").alias("x")), "a")
        .join(labels.select(F.col("text_hash").alias("b"), F.col("label").alias("y")), "b")
        .filter(F.col("x") != F.col("y"))
        .select(F.lit(0).alias("grp"), F.col("x").alias("a"), F.col("y").alias("b"))
    )
    joined = connected_components(materialize(edges, "wide-links")).select(
        F.col("node").alias("label"), F.col("label").alias("_lowest")
    )
    return narrow.join(joined, "label", "left").select(
        "doc_id", "text_hash", "fp", F.coalesce("_lowest", "label").alias("label")
    )
