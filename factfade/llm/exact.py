"""Exact duplicates found through a minimal perfect hash over the texts of a history.

The distinct SHA-256 digests of the history are dealt to buckets of bounded size.
Each bucket gets a minimal perfect hash (three hash functions, peeled hypergraph):
as many slots as digests, and a slot holds the whole digest, the document that stays
and the size of its group.  A lookup computes one slot and compares all 32 bytes, so
a text outside the history is never taken for one inside; such texts are grouped
among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.session import materialize

BUCKET_KEYS = 16_384
_NO_ID = -(1 << 63)  # stands for a document without doc_id
_EMPTY = 3  # a vertex that no digest owns; counts as 0 modulo 3


def _vertices(digests: np.ndarray, seed: int, part: int) -> np.ndarray:
    """Three vertices per digest, one from each third of the table."""
    words = digests.view("<u8").reshape(-1, 4)[:, :3].copy()
    words ^= np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    words ^= words >> np.uint64(33)
    words *= np.uint64(0xFF51AFD7ED558CCD)
    words ^= words >> np.uint64(29)
    return (words % np.uint64(part)).astype(np.int64) + np.arange(3) * part


def build_hash(digests: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, table, slot of each digest) for distinct digests (n x 32 bytes)."""
    n = len(digests)
    part = n * 5 // 12 + 2
    for seed in range(1000):
        edges = _vertices(digests, seed, part)
        degree = np.bincount(edges.ravel(), minlength=3 * part)
        incident = np.zeros(3 * part, np.int64)
        for k in range(3):
            np.bitwise_xor.at(incident, edges[:, k], np.arange(n))
        rounds, left = [], n
        while left:
            lone = np.flatnonzero(degree == 1)
            if not len(lone):
                break
            keys, where = np.unique(incident[lone], return_index=True)
            rounds.append((keys, lone[where]))
            for k in range(3):
                np.subtract.at(degree, edges[keys, k], 1)
                np.bitwise_xor.at(incident, edges[keys, k], keys)
            left -= len(keys)
        if left:
            continue
        table = np.full(3 * part, _EMPTY, np.uint8)
        for keys, own in reversed(rounds):
            which = np.argmax(edges[keys] == own[:, None], axis=1)
            others = table[edges[keys]].astype(np.int64).sum(axis=1) - _EMPTY
            table[own] = (which - others) % 3
        return seed, table, slots(digests, seed, table)[0]
    raise RuntimeError("no seed gave a hash; are the digests distinct?")


def slots(digests: np.ndarray, seed: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, owned) of each digest; where not owned, it is surely none of the keys."""
    edges = _vertices(digests, seed, len(table) // 3)
    which = table[edges].astype(np.int64).sum(axis=1) % 3
    vertex = edges[np.arange(len(edges)), which]
    rank = np.cumsum(table != _EMPTY) - 1
    return rank[vertex], table[vertex] != _EMPTY


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, 32)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) per row; NULL text counts as empty."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("size")
    )


def _bucket(buckets: int):
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.pmod(first, F.lit(buckets)).cast("int")


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: seed, table and, in slot order, digests, winners and sizes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = _matrix(rows["digest"])
        seed, table, slot = build_hash(keys)
        place = np.argsort(slot)
        return pd.DataFrame({
            "bucket": [rows["bucket"].iat[0]], "seed": [seed], "pilot": [table.tobytes()],
            "digests": [keys[place].tobytes()],
            "keep_ids": [rows["keep_id"].to_numpy("<i8")[place].tobytes()],
            "sizes": [rows["size"].to_numpy("<i8")[place].tobytes()],
        })

    return groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(
        build,
        "bucket int, seed long, pilot binary, digests binary, keep_ids binary, sizes binary",
    )


def lookup(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """Every distinct digest of index and ``groups``: digest, keep_id, size, historical.

    A digest found in its slot joins the group of the history; any other one is a
    group of its own.
    """

    def probe(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keys = _matrix(asked["digest"])
        keep, size = asked["keep_id"].to_numpy("<i8"), asked["size"].to_numpy("<i8")
        if not len(held):
            return pd.DataFrame({
                "digest": [k.tobytes() for k in keys], "keep_id": keep, "size": size,
                "historical": False,
            })
        row = held.iloc[0]
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        winners = np.frombuffer(row["keep_ids"], "<i8").copy()
        sizes = np.frombuffer(row["sizes"], "<i8").copy()
        slot, owned = slots(keys, int(row["seed"]), np.frombuffer(row["pilot"], np.uint8))
        member = owned & (known[np.where(owned, slot, 0)] == keys).all(axis=1)
        hit = slot[member]
        winners[hit] = np.maximum(winners[hit], keep[member])
        sizes[hit] += size[member]
        return pd.DataFrame({
            "digest": [k.tobytes() for k in known] + [k.tobytes() for k in keys[~member]],
            "keep_id": np.concatenate([winners, keep[~member]]),
            "size": np.concatenate([sizes, size[~member]]),
            "historical": np.arange(len(known) + (~member).sum()) < len(known),
        })

    asked = groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return asked.cogroup(index.groupBy("bucket")).applyInPandas(
        probe, "digest binary, keep_id long, size long, historical boolean"
    )


def deduplicate(history: DataFrame, arriving: DataFrame, every_row: bool = False) -> DataFrame:
    """Every document of both tables (doc_id, text) with the one that stays.

    doc_id, keep_id (largest doc_id among equal texts), group_size, kept, historical
    (its text occurs in the history) and text_sha256.  NULL text counts as empty and
    equals empty text.  A document without doc_id gives way to any other; a repeated
    row (same doc_id, same text) is one document and one row, unless ``every_row`` asks
    for a row, and a count in group_size, of each.  Two texts under one doc_id are two
    documents.  Empty tables on either side are fine; other columns are not read.
    """
    rows = (digests(history), digests(arriving))
    old, new = (materialize(d if every_row else d.distinct(), "digests") for d in rows)
    old_groups, new_groups = (materialize(_groups(d), "digest-groups") for d in (old, new))
    buckets = max(1, -(-max(old_groups.count(), new_groups.count()) // BUCKET_KEYS))
    index = materialize(build_index(old_groups, buckets), "digest-index")
    classes = lookup(index, new_groups, buckets)
    # Documents meet their class by an ordinary join, whose hot digests are split.
    both = old.unionByName(new)
    joined = (both if every_row else both.distinct()).join(classes, "digest")
    real = F.when(F.col("keep_id") != _NO_ID, F.col("keep_id"))
    return joined.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
        real.alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), "historical",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def split_by_age(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, arriving): documents up to the middle of the id range, and the rest."""
    low, high = docs.agg(
        F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))
    ).first()
    middle = ((low or 0) + (high or 0)) // 2
    late = F.coalesce(F.col("doc_id").cast("long") > middle, F.lit(False))
    return docs.filter(~late), docs.filter(late)
