"""Near-duplicates by SimHash, linked through a generalised pigeonhole search.

The 64 bits of a fingerprint are grouped into partitions, correlated bits together.
If two fingerprints differ in at most ``t`` bits and the thresholds of ``m``
partitions add up to ``t - m + 1``, then in some partition they differ in no more bits
than its threshold (a threshold of -1 leaves a partition out).  Thresholds need not be
equal: dynamic programming picks them, and the number of partitions, for the fewest
probes and candidates, estimated from the bits of all fingerprints.

Every fingerprint is dealt to the keys that lie within the threshold of its own value
in each partition.  What meets under a key is compared exactly, and only a spanning
forest of the links leaves the task, so a group of any density gives fewer rows than
it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.llm.tokens import text_slices
from factfade.operators.similarity import connected_components
from factfade.session import materialize

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints that one task compares under one key; more are dealt to pairs of blocks.
GROUP = 65_536
#: What a candidate costs beside a probe that is shuffled, in the choice of thresholds.
CANDIDATE_COST = 4.0
_LAGS = 24
_CHUNK = 1 << 16


def simhash(text: str, size: int = SHINGLE) -> int:
    """Fingerprint as an unsigned number; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -size])).tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint is a signed 64-bit number.

    NULL text counts as empty; ``text_hash`` tells rows of one doc_id apart.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, some in text_slices(batch.column("text").to_pylist()):
                out += [simhash(t, size) for t in some]
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"]
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_hash"),
    )
    return texts.mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of bits set together) over all rows of ``fp``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        rows = 0
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            total += bits.T @ bits
            rows += len(values)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, BITS * BITS)), pa.array(np.append([rows], total.ravel()).astype(np.int64))],
                ["cell", "n"],
            )

    cells = fps.select("fp").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = dict(tuple(r) for r in cells.collect())  # 4,097 numbers at any size
    table = np.array([found.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)
    return int(found.get(-1, 0)), table


def partition_bits(rows: int, together: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of nearly equal number, correlated bits in one group."""
    p = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(together / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = (BITS + k) // m
        order = sorted(left)
        group = [order[int(np.argmax(link[np.ix_(order, order)].sum(axis=1)))]]
        left.remove(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: link[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _differing(p: np.ndarray, most: int) -> np.ndarray:
    """Probability that two random fingerprints differ in at most 0..most of these bits."""
    ways = np.zeros(most + 2)
    ways[0] = 1.0
    for q in 2 * p * (1 - p):
        ways[1:] = ways[1:] * (1 - q) + ways[:-1] * q
        ways[0] *= 1 - q
    return np.cumsum(ways)[: most + 1]


def choose_thresholds(
    rows: int, together: np.ndarray, distance: int = DISTANCE
) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, the cheapest found."""
    p = np.diag(together) / max(rows, 1)
    best: tuple[float, list] = (np.inf, [])
    for m in range(2, distance + 2):
        groups = partition_bits(rows, together, m)
        # cheapest[s]: cost and thresholds of the partitions so far with sum s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            near = _differing(p[bits], distance)
            ball, price = 0.0, {-1: 0.0}
            for t in range(distance + 1):
                ball += float(np.prod([len(bits) - i for i in range(t)]) / np.prod(range(1, t + 1)))
                price[t] = rows * ball + CANDIDATE_COST * rows * rows * near[t]
            after: dict[int, tuple[float, list[int]]] = {}
            for done, (cost, taken) in cheapest.items():
                for t, more in price.items():
                    if done + t not in after or cost + more < after[done + t][0]:
                        after[done + t] = (cost + more, [*taken, t])
            cheapest = after
        cost, taken = cheapest[distance - m + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, taken, strict=True) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(bits: list[int], threshold: int) -> list[int]:
    return [
        _signed(sum(1 << b for b in some))
        for t in range(threshold + 1) for some in combinations(bits, t)
    ]


def _longs(values: list[int]) -> Column:
    """A constant array; one string in the plan instead of many literals."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _key(number: int, masked: Column) -> Column:
    return F.xxhash64(F.lit(number), masked)


def probes(fps: DataFrame, chosen: list[tuple[list[int], int]], group: int = GROUP) -> DataFrame:
    """(key, block, fp): fingerprints that must be compared share key and block."""
    parts, hot = [], []
    for number, (bits, threshold) in enumerate(chosen):
        masks = _masks(bits, threshold)
        own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        parts.append(
            fps.select("fp", F.explode(_longs(masks)).alias("_mask"))
            .select(_key(number, own.bitwiseXOR(F.col("_mask"))).alias("key"), "fp")
        )
        full = (
            fps.groupBy(own.alias("_own")).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > group // len(masks))
        )
        hot.append(
            full.select("n", "_own", F.explode(_longs(masks)).alias("_mask"))
            .select(_key(number, F.col("_own").bitwiseXOR(F.col("_mask"))).alias("key"), "n")
        )
    rows, large = parts[0], hot[0]
    for more, too in zip(parts[1:], hot[1:], strict=True):
        rows, large = rows.unionByName(more), large.unionByName(too)
    large = materialize(
        large.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(group) + 1).cast("int").alias("blocks")),
        "crowded-keys",
    )
    if large.isEmpty():
        return rows.withColumn("block", F.lit(0).cast("long"))
    # A crowded key is cut into blocks; every pair of blocks is a group of its own.
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    return (
        rows.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "fp",
            (F.least("_mine", "_other") * F.col("blocks") + F.greatest("_mine", "_other"))
            .cast("long").alias("block"),
        )
    )


def _forest(members: np.ndarray, distance: int) -> tuple[list, list]:
    """Spanning forest of the links among the members; exact, compares what is left only."""
    a, b, tail, rest = [], [], [], members
    while len(rest):
        tail.append(rest[0])
        rest = rest[1:]
        while tail and len(rest):
            at = tail.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                a += [at] * len(found)
                b += found.tolist()
                tail += list(found)
                rest = rest[~near]
        tail = []
    return a, b


def links(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of fingerprints that share key and block, enough to connect all that link."""

    def compare(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin = np.concatenate(([0], cuts))
        size = np.diff(np.append(begin, len(key)))
        a, b = [], []
        for k in np.flatnonzero(size > _LAGS):
            x, y = _forest(np.unique(fp[begin[k] : begin[k] + size[k]]), distance)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        small = np.repeat((size <= _LAGS) & (size > 1), size)
        key, fp = key[small], fp[small]
        for lag in range(1, _LAGS):
            same = key[lag:] == key[:-lag]
            if not same.any():
                break
            near = same & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance) & (fp[lag:] != fp[:-lag])
            a.append(fp[:-lag][near])
            b.append(fp[lag:][near])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
        pairs = np.unique(np.stack([x.view(np.int64), y.view(np.int64)], axis=1), axis=0)
        low, high = pairs.min(axis=1, initial=np.iinfo(np.int64).max), pairs.max(axis=1, initial=np.iinfo(np.int64).min)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))  # the last group may go on
                yield compare(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield compare(key, fp)

    grouped = rows.select(F.xxhash64("key", "block").alias("key"), "fp")
    return (
        grouped.repartition("key").sortWithinPartitions("key")
        .mapInArrow(scan, "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp, label and component_id of every document (doc_id, text).

    ``label`` is the smallest fingerprint of a component and ``component_id`` the
    smallest doc_id that can be reached over links of at most
    ``distance`` differing bits, NULL where all of them lack an id.  NULL, empty and
    blank texts have fingerprint 0, linked like any other.  Repeated rows and equal
    texts share one fingerprint, which is compared once.  An empty table gives no row;
    other columns are not read.
    """
    placed = materialize(fingerprints(docs, size), "fingerprints")
    groups = materialize(placed.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-groups")
    fps = groups.select("fp")
    rows, together = bit_statistics(fps)
    edges = links(probes(fps, choose_thresholds(rows, together, distance)), distance)
    linked = connected_components(materialize(
        edges.select(F.lit(0).alias("grp"), "a", "b"), "fingerprint-links"
    )).select(F.col("node").alias("fp"), "label")
    labelled = groups.join(linked, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = labelled.join(lowest, "label").select("fp", "label", "component_id")
    return placed.join(classes, "fp").select("doc_id", "text_hash", "fp", "label", "component_id")


def removed(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the documents that give way: all but one per component.

    The smallest doc_id stays (NULL last), of equal ids the smallest ``text_hash``.
    """
    rank = F.struct(
        F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("doc_id"),
        F.col("text_hash").alias("text_hash"),
    )
    ranked = found.select("doc_id", "text_hash", "label", rank.alias("rank"))
    first = ranked.groupBy("label").agg(F.min("rank").alias("first"))
    return (
        ranked.join(first, "label").filter(~F.col("rank").eqNullSafe(F.col("first")))
        .select("doc_id", "text_hash").distinct()
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
