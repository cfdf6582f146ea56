"""Best rows of many long texts at once, by adding up every word in blocks.

A text of a hundred words, most of them common, shares words with nearly all rows of its
group, and no bound rules many of them out.  For such batches the sums themselves are the
work.  Keys and rows of a group are dealt to blocks of about ``ENTRIES`` words, a block
travels as a few packed columns, and each pair of blocks is added up by one group of a
cogroup, which hands on the best rows of each of its keys only.

Inside a pair the common words are a product of two matrices of short floats and the rare
ones are added up row by row.  These sums only choose: rows that may be among the best
within the error of a short float are added up again, word by word, in full precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from factfade.operators.textindex import RANK_DECIMALS
from factfade.session import materialize

#: Words of a block, of keys as of rows.  What travels is the words of all blocks times the
#: number of blocks they meet, so blocks are as large as a worker can hold.
ENTRIES = 1 << 21
#: Keys of a block at most: few words a key must not make one long task.
KEYS = 1 << 14
#: Keys and rows of a pair of blocks of which all rows are handed on.
ALL_KEYS, ALL_ROWS = 256, 1 << 13

#: Tasks for the pairs of blocks, at most.
MOST_TASKS = 4096

#: Numbers of the matrix of common words, and of the sums that are held at a time.
_MATRIX = 1 << 23
_SUMS = 1 << 21
#: A word is common if at least one in so many rows holds it.
_COMMON = 24
#: Rows from which a first bound of the best is taken.
_SAMPLE = 4096

_NO_OWNER = -(1 << 63)
_PACKED = "grp long, own_block long, ids binary, words binary, counts binary, row binary, value binary"
_PARTS = (("ids", "<i8"), ("words", "<i8"), ("counts", "<i4"), ("row", "<i4"), ("value", "<f8"))
_SCORED = pa.schema([("key", pa.int64()), ("obs_id", pa.int64()), ("units", pa.int64())])


def _pack(rows: pa.Table) -> pa.Table:
    """A block in one row: its ids, its words (``no``) and the places of both, word by word."""
    owner = pc.fill_null(rows["owner"], _NO_OWNER).to_numpy()
    no, value = rows["no"].to_numpy(), rows["value"].to_numpy()
    ids, row = np.unique(owner, return_inverse=True)
    order = np.lexsort((row, no))
    words, counts = np.unique(no, return_counts=True)
    parts = (ids, words, counts, row[order], value[order])
    packed = {name: [a.astype(t).tobytes()] for (name, t), a in zip(_PARTS, parts, strict=True)}
    return pa.table({"grp": rows["grp"][:1], "own_block": rows["own_block"][:1]} | packed)


def _unpack(block: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(block[name][0].as_buffer(), t) for name, t in _PARTS]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each span, one span after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class _Held:
    """Rows of a block by their words, and words by their rows."""

    def __init__(self, block: pa.Table):
        self.ids, self.words, self.counts, self.row, self.value = _unpack(block)
        self.start = np.cumsum(self.counts, dtype=np.int64) - self.counts
        word = np.repeat(np.arange(len(self.words), dtype=np.int32), self.counts)
        by_row = np.argsort(self.row, kind="stable")  # of a row, words in their order
        self.row_word, self.row_value = word[by_row], self.value[by_row]
        self.row_size = np.bincount(self.row, minlength=len(self.ids))
        self.row_start = np.cumsum(self.row_size) - self.row_size

    def common(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The commonest of the asked words and their weights in all rows."""
        n = len(self.ids)
        often = asked[self.counts[asked] * _COMMON >= n]
        often = often[np.argsort(-self.counts[often], kind="stable")][: _MATRIX // n]
        matrix = np.zeros((len(often), n), np.float32)
        for i, w in enumerate(often):
            span = slice(self.start[w], self.start[w] + self.counts[w])
            np.add.at(matrix[i], self.row[span], self.value[span])
        return often, matrix

    def exact(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sums of the rows for ``times`` of each word, added in the order of the words."""
        size = self.row_size[rows]
        at = _spans(self.row_start[rows], size)
        parts = self.row_value[at] * times[self.row_word[at]]
        return np.bincount(np.repeat(np.arange(len(rows)), size), parts, minlength=len(rows))


def _hopeful(sums: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) that can be among the ``most`` best of a key, ``slack`` being the error of a sum.

    Sums that are one after rounding are of the same rank.
    """
    n = sums.shape[1]
    same = 2 * 10.0**-RANK_DECIMALS
    floor = np.zeros(len(sums))
    sample = sums[:, :: max(1, n // max(_SAMPLE, 2 * most))]
    if sample.shape[1] > most:
        floor = np.partition(sample, -most, axis=1)[:, -most] * (1 - slack) - same
    key, row = np.nonzero((sums >= floor[:, None]) & (sums > 0))
    found = sums[key, row]
    order = np.lexsort((-found, key))
    key, row, found = key[order], row[order], found[order]
    first = np.searchsorted(key, np.arange(len(sums) + 1))
    last = first[:-1] + most - 1
    full = last < first[1:]
    floor[full] = found[last[full]] * (1 - slack) - same
    keep = found >= floor[key]
    return key[keep], row[keep]


def _best_of_pair(asked: pa.Table, held: pa.Table, most: int) -> pa.Table:
    """(key, obs_id, units): the best ``most`` rows of the one block for each key of the other.

    Words are added in the order of their numbers, so equal texts have equal sums.
    """
    if not len(asked) or not len(held):
        return _SCORED.empty_table()
    keys, words, counts, key, times = _unpack(asked)
    block = _Held(held)
    n = len(block.ids)
    at = np.minimum(np.searchsorted(block.words, words), len(block.words) - 1)
    known = np.repeat(block.words[at] == words, counts)
    word, key, times = np.repeat(at, counts)[known], key[known], times[known]
    order = np.argsort(key, kind="stable")
    word, key, times = word[order], key[order], times[order]
    often, matrix = block.common(np.unique(word))
    column = np.full(len(block.words), -1)
    column[often] = np.arange(len(often))
    # A sum of m short floats above 0 is off by m steps at most, of each product one more.
    slack = 2 * (len(often) + 8) * 2.0**-23
    first = np.searchsorted(key, np.arange(len(keys) + 1))
    table = np.zeros(len(block.words))
    step = max(1, _SUMS // n)
    out = []
    for lo in range(0, len(keys), step):
        hi = min(lo + step, len(keys))
        span = slice(first[lo], first[hi])
        w, k, t = word[span], key[span] - lo, times[span]
        of = column[w]
        rare = np.flatnonzero(of < 0)
        sums = np.zeros((hi - lo) * n)
        # Rare words of a few keys at a time: there may be many rows in all.
        size = block.counts[w[rare]].astype(np.int64)
        cuts = np.searchsorted(np.cumsum(size), np.arange(_SUMS, size.sum(), _SUMS))
        for part in np.split(np.arange(len(rare)), cuts):
            if not len(part):
                continue
            some = rare[part]
            places = _spans(block.start[w[some]], size[part])
            cell = np.repeat(k[some] * n, size[part]) + block.row[places]
            weight = block.value[places] * np.repeat(t[some], size[part])
            sums += np.bincount(cell, weight, minlength=len(sums))
        sums = sums.reshape(hi - lo, n)
        if len(often):
            asks = np.zeros((hi - lo, len(often)), np.float32)
            dense = of >= 0
            np.add.at(asks, (k[dense], of[dense]), t[dense])
            sums += asks @ matrix
        hope_key, hope_row = _hopeful(sums, most, slack)
        bounds = np.searchsorted(hope_key, np.arange(hi - lo + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            rows = np.sort(hope_row[bounds[i] : bounds[i + 1]])
            own = slice(first[lo + i], first[lo + i + 1])
            np.add.at(table, word[own], times[own])
            units = np.rint(block.exact(rows, table) * 10.0**RANK_DECIMALS).astype(np.int64)
            table[word[own]] = 0
            if len(units) > most:  # lowest ids first
                best = np.lexsort((rows, -units))[:most]
                rows, units = rows[best], units[best]
            out.append((np.full(len(units), keys[lo + i]), block.ids[rows], units))
    if not out:
        return _SCORED.empty_table()
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_SCORED)


def _all_of_pair(asked: pa.Table, held: pa.Table) -> pa.Table:
    """(key, obs_id, units): all rows of the one block with a word of a key of the other.

    Words are added in the order of their numbers, so equal texts have equal sums.
    """
    if not len(asked) or not len(held):
        return _SCORED.empty_table()
    keys, words, counts, key, times = _unpack(asked)
    ids, held_words, held_counts, row, value = _unpack(held)
    start = np.cumsum(held_counts, dtype=np.int64) - held_counts
    at = np.minimum(np.searchsorted(held_words, words), len(held_words) - 1)
    known = np.repeat(held_words[at] == words, counts)
    word, key, times = np.repeat(at, counts)[known], key[known], times[known]
    order = np.argsort(key, kind="stable")  # by key, then by word
    word, key, times = word[order], key[order], times[order]
    keys_found, first = np.unique(key, return_index=True)
    out = []
    for k, lo, hi in zip(keys_found, first, np.append(first, len(key))[1:], strict=True):
        size = held_counts[word[lo:hi]].astype(np.int64)
        places = _spans(start[word[lo:hi]], size)
        parts = value[places] * np.repeat(times[lo:hi], size)
        sums = np.bincount(row[places], parts, minlength=len(ids))
        touched = np.flatnonzero(sums)  # no weight is 0
        units = np.rint(sums[touched] * 10.0**RANK_DECIMALS).astype(np.int64)
        out.append((np.full(len(touched), keys[k]), ids[touched], units))
    if not out:
        return _SCORED.empty_table()
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_SCORED)


def _pairs_of_blocks(
    terms: DataFrame, weights: DataFrame, group: Column, most_keys: int, most_rows: int | None
) -> tuple[GroupedData, GroupedData, DataFrame]:
    """Keys and rows in blocks, once per pair they meet in, and (grp, key, keep) of the keys."""
    numbers = materialize(
        terms.select("phrase").distinct().withColumn("no", F.monotonically_increasing_id()),
        "numbers",
    )
    asked = materialize(
        terms.join(numbers, "phrase").select(
            F.col("grp").cast("long").alias("grp"), F.col("key").cast("long").alias("owner"), "no",
            F.col("times").cast("double").alias("value"), "keep",
        ),
        "asked-words",
    )
    held = materialize(
        weights.select(group.cast("long").alias("grp"), "phrase", "obs_id", "weight")
        .join(numbers, "phrase")
        .select(
            "grp", F.col("obs_id").cast("long").alias("owner"), "no", F.col("weight").alias("value")
        ),
        "held-words",
    )

    keeps = materialize(
        asked.groupBy("grp", F.col("owner").alias("key"), "keep").agg(F.count(F.lit(1)).alias("n")),
        "keys",
    )

    def blocks(n: Column, name: str, owners: Column, most: int | None) -> Column:
        least = F.lit(1) if most is None else F.ceil(owners / F.lit(most))
        return F.greatest(F.ceil(n / F.lit(ENTRIES)), least).cast("long").alias(name)

    sizes = materialize(
        keeps.groupBy("grp").agg(blocks(F.sum("n"), "asked", F.count(F.lit(1)), most_keys)).join(
            held.groupBy("grp").agg(
                blocks(F.count(F.lit(1)), "held", F.approx_count_distinct("owner"), most_rows)
            ), "grp",
        ),
        "block-counts",
    )
    pairs = sizes.agg(F.sum(F.col("asked") * F.col("held"))).first()[0] or 1
    tasks = min(4 * pairs, MOST_TASKS)  # pairs are dealt by hash: with room to lie apart

    def packed(entries: DataFrame, own: str, other: str) -> DataFrame:
        placed = entries.join(sizes.select("grp", own), "grp").select(
            "grp", F.pmod(F.xxhash64("owner"), F.col(own)).alias("own_block"), "owner", "no", "value",
        )
        parts = [name for name, _ in _PARTS]
        return materialize(
            placed.groupBy("grp", "own_block").applyInArrow(_pack, _PACKED), f"blocks-{own}"
        ).join(F.broadcast(sizes.select("grp", other)), "grp").select(
            "grp", F.col("own_block").alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_no"),
            *parts,
        ).withColumnRenamed(f"{other}_no", other).repartition(tasks, "grp", "asked", "held")

    pair = ["grp", "asked", "held"]
    return (
        packed(asked, "asked", "held").groupBy(*pair), packed(held, "held", "asked").groupBy(*pair),
        keeps,
    )


def best_rows_of_all(terms: DataFrame, weights: DataFrame, most: int, group: Column) -> DataFrame:
    """``textindex.best_rows`` without its bounds: (key, obs_id, position), the same rows.

    ``terms`` is (key, grp, phrase, times, keep); ``group`` says which rows of
    ``weights`` a key may use.  ``most`` bounds ``keep``.  Keys, groups and ids are longs.
    """
    asked, held, keeps = _pairs_of_blocks(terms, weights, group, KEYS, None)
    scored = asked.cogroup(held).applyInArrow(
        lambda left, right: _best_of_pair(left, right, most), "key long, obs_id long, units long"
    )
    by_score = Window.partitionBy("key").orderBy(F.desc("units"), "obs_id")
    return (
        scored.withColumn("rn", F.row_number().over(by_score)).filter(F.col("rn") <= most)
        .join(keeps.select("key", "keep").distinct(), "key").filter(F.col("rn") <= F.col("keep"))
        .select("key", "obs_id", (F.col("rn") - 1).alias("position"))
    )


def all_rows_of_all(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, obs_id, units) of all rows with a phrase of a key; ``terms`` is (key, phrase, times).

    ``units`` is the sum of weights in steps of the rounded rank.

    No pair of a word of a key and a row is written, and a pair of blocks hands on at most
    ``ALL_KEYS`` times ``ALL_ROWS`` rows at a time.
    """
    keyed = terms.filter(F.col("key").isNotNull()).withColumns({"grp": F.lit(0), "keep": F.lit(0)})
    asked, held, _ = _pairs_of_blocks(keyed, weights, F.lit(0), ALL_KEYS, ALL_ROWS)
    scored = asked.cogroup(held).applyInArrow(_all_of_pair, "key long, obs_id long, units long")
    return scored.withColumn("obs_id", F.nullif("obs_id", F.lit(_NO_OWNER)))
