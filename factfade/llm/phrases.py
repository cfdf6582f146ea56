"""Phrases whose words stay together, found by dynamic itemset counting.

The texts are dealt to ``SHARDS`` shards that are scanned in a cycle.  Words are counted
from the first scan on.  After every scan, what has reached the threshold is noted, and a
longer phrase is counted from the next scan on once both its parts (all words but the
last, all but the first) have reached it.  Each phrase is counted for one full cycle from
its start, wherever in the cycle that is, or until it has reached the threshold itself.
A phrase that is never started has a part below the threshold and is below it itself.

Scans count hashes: sorted blocks of them are dealt to buckets and added up there, a
bucket at a time, and what has not yet reached the threshold is kept for the next scan.
What has reached it is sent to the scans as one Bloom filter per step, of bounded size.
Filters never change once made, so a scan can tell at which step a phrase was started and
when its cycle ends.  Equal hashes or a false positive start a phrase early and lose
none: a closing cycle counts what passed the filters by its text, exactly.

NULL texts are empty and give no words, a NULL language counts as ``und``.  Repeated rows
and rows without id count like any other.  Texts of any length are read whole, in slices
of the table of about ``SLICE_BYTES``.  Words keep every sign but blanks, tabs and the
piece breaks.  Other columns than ``text`` and ``lang`` are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factfade.llm.words import mixed
from factfade.session import materialize

SHARDS = 4
LEAST = 10
LONGEST = 3
MOST = 2000
#: A phrase inside a longer one that has at least this share (per cent) of its count goes.
COVERED = 50
NO_LANGUAGE = "und"

#: Text of one language that is cut into words at once, and of all languages of a task.
SLICE_BYTES = 8 << 20
HELD_BYTES = 32 << 20
_OUT_ROWS = 1 << 17

#: Hashes that a bucket holds, about, and the most buckets (as shifts).
BUCKET_SHIFT = 21
MOST_BUCKETS_SHIFT = 20

#: Bloom filters: bits per phrase, at most so many bits (32 MB), hashes, bits of a block.
BITS_EACH = 16
MOST_BITS = 1 << 28
HASHES = 4
BLOCK = 1 << 16
NEVER = 1 << 30

_BREAK = b"."
_FOLD = bytes(
    ord(".") if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_RANK_PARTS, _FEWER_PARTS = 16, 4


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case, with a break sign between pieces and at the end."""
    return (text.translate(_FOLD).replace(_BREAK, b" . ") + b" .").split()


def slices(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, vocabulary, codes, n_words, shard): texts as numbers, a few MB in a row."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.col("text").cast("string").cast("binary").alias("text"),
    ).filter(F.col("text").isNotNull())

    def cut(batches):
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        all_held = 0
        number = count(TaskContext.get().partitionId())

        def done(lang: str) -> pa.RecordBatch:
            code_of: dict[bytes, int] = defaultdict(count(1).__next__)
            code_of[_BREAK] = 0
            parts = []
            for text in held.pop(lang):
                words = words_of(text)
                parts.append(np.fromiter(map(code_of.__getitem__, words), np.int32, len(words)))
            del size[lang]
            codes = np.concatenate(parts)
            return pa.RecordBatch.from_pydict({
                "lang": [lang], "vocabulary": pa.array([b" ".join(code_of)], pa.binary()),
                "codes": pa.array([codes.astype("<i4").tobytes()], pa.binary()),
                "n_words": pa.array([np.count_nonzero(codes)], pa.int64()),
                "shard": pa.array([next(number) % shards], pa.int32()),
            })

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held[lang].append(text)
                size[lang] += len(text)
                all_held += len(text)
                if size[lang] >= SLICE_BYTES or all_held >= HELD_BYTES:
                    most = max(size, key=size.get)
                    all_held -= size[most]
                    yield done(most)
        for lang in sorted(held):
            yield done(lang)

    made = rows.mapInArrow(
        cut, "lang string, vocabulary binary, codes binary, n_words long, shard int"
    )
    return materialize(made, "slices", partition_by=("shard",))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 byte plane by byte plane: leading zeros compress away."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


_BLOCKS = "words int, bucket int, keys binary, n binary"


def _block(words: int, bucket: int, keys: np.ndarray, n: np.ndarray) -> tuple:
    """Ascending keys go as differences."""
    return words, bucket, pack(np.diff(keys, prepend=keys.dtype.type(0))), pack(n)


def _block_rows(rows: list[tuple], more: dict[str, list] | None = None) -> pa.RecordBatch:
    words, bucket, keys, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({
        "words": pa.array(words, pa.int32()), "bucket": pa.array(bucket, pa.int32()),
        "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary()), **(more or {}),
    })


def short(hashes: np.ndarray, shift: int) -> np.ndarray:
    """The part of a hash that is kept: its bucket (``shift`` bits) and 32 bits more."""
    return hashes >> np.uint64(32 - shift)


class Reached:
    """Steps at which phrases reached the threshold: a Bloom filter for each step."""

    def __init__(self):
        self.steps: list[tuple[int, np.ndarray]] = []

    def last(self) -> int:
        return self.steps[-1][0] if self.steps else -1

    def add(self, step: int, blocks: DataFrame, n: int) -> None:
        """Note the ``n`` phrases in blocks (bucket, keys) as reached at ``step``."""
        if not n:
            return
        bits = BLOCK
        while bits < min(BITS_EACH * n, MOST_BITS):
            bits *= 2

        def place(batches):
            for batch in batches:
                for bucket, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    known = np.cumsum(unpack(keys).astype(np.uint64)) | np.uint64(bucket << 32)
                    at = np.unique(np.concatenate(list(places(known, bits))).astype(np.int64))
                    cut = np.flatnonzero(np.diff(at // BLOCK)) + 1
                    parts = np.split(at, cut)
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([int(p[0]) // BLOCK for p in parts], pa.int32()),
                        "offsets": pa.array([(p % BLOCK).astype("<u2").tobytes() for p in parts], pa.binary()),
                    })

        def unite(batches):
            block, seen = None, np.zeros(BLOCK, bool)

            def done():
                return pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int32()),
                    "bits": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary()),
                })

            for batch in batches:
                for b, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if b != block:
                        if block is not None:
                            yield done()
                        block = b
                        seen[:] = False
                    seen[np.frombuffer(offsets, "<u2")] = True
            if block is not None:
                yield done()

        placed = blocks.select("bucket", "keys").mapInArrow(place, "block int, offsets binary")
        united = (
            placed.repartition("block").sortWithinPartitions("block")
            .mapInArrow(unite, "block int, bits binary")
        )
        found = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
        for row in united.collect():  # the filter, of bounded size
            found[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        self.steps.append((step, found.reshape(-1)))

    def step_of(self, keys: np.ndarray) -> np.ndarray:
        """The first step whose filter has each key (``short``), NEVER where none has."""
        out = np.full(len(keys), NEVER, np.int64)
        open_ = np.arange(len(keys))
        for step, found in self.steps:
            some = open_
            for k in range(HASHES):
                at = place_no(keys[some], k, 8 * len(found))
                has = found[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
                some = some[has & 1 == 1]
            out[some] = step
            open_ = open_[out[open_] == NEVER]
        return out


def place_no(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    spread = mixed(keys)
    low, high = spread & np.uint64(0xFFFFFFFF), (spread >> np.uint64(32)) | np.uint64(1)
    return (low + np.uint64(k) * high) & np.uint64(bits - 1)


def places(keys: np.ndarray, bits: int):
    for k in range(HASHES):
        yield place_no(keys, k, bits)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    head = lang.encode("utf-8", "surrogatepass") + b"\0"
    return np.array([xxhash.xxh64_intdigest(head + w, 42) for w in words], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Slice:
    """Words, pairs and triples of a slice, with their hashes and when they were reached.

    Pairs are those of two reached words, triples those of two such pairs.
    """

    def __init__(self, lang: str, vocabulary: bytes, codes: bytes, reached, shift: int):
        self.words = vocabulary.split(b" ")
        self.codes = np.frombuffer(codes, "<i4")
        self.reached, self.shift, self.size = reached, shift, len(self.words)
        self.h1 = _word_hashes(lang, self.words)
        self.step1 = reached[1].step_of(short(self.h1, shift))
        self.step1[0] = NEVER  # no phrase crosses a break

    def count_words(self) -> np.ndarray:
        return np.bincount(self.codes, minlength=self.size)

    def find_pairs(self) -> None:
        known = self.step1[self.codes] < NEVER
        self.at = np.flatnonzero(known[:-1] & known[1:])
        a, b = self.codes[self.at].astype(np.int64), self.codes[self.at + 1]
        self.pair, pairs = pd.factorize(a * self.size + b)
        self.left, self.right = pairs // self.size, pairs % self.size
        self.h2 = _joined(self.h1[self.left], self.h1[self.right])
        self.step2 = self.reached[2].step_of(short(self.h2, self.shift))
        self.seen2 = np.maximum(self.step2, np.maximum(self.step1[self.left], self.step1[self.right]))

    def count_pairs(self) -> np.ndarray:
        return np.bincount(self.pair, minlength=len(self.left))

    def triples(self, wanted=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first pair, second pair, count) of triples; ``wanted`` picks by their start."""
        next_to = np.flatnonzero(np.diff(self.at) == 1)  # pairs that share a word
        first, second = self.pair[next_to], self.pair[next_to + 1]
        # A filter may hold a pair by mistake before its words are reached and scans see it.
        start = np.maximum(self.seen2[first], self.seen2[second])
        live = (start < NEVER) if wanted is None else wanted(start + 1)
        first, second = first[live].astype(np.int64), second[live]
        _, one, n = np.unique(
            first * self.size + self.right[second], return_index=True, return_counts=True
        )
        return first[one], second[one], n

    def h3(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return _joined(self.h2[first], self.h1[self.right[second]])


def _each_slice(batches, reached, shift):
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0], Slice(*row, reached, shift)


def scan(shard: DataFrame, step: int, shards: int, reached: dict[int, Reached], shift: int) -> DataFrame:
    """Blocks of counts of the phrases that are in their cycle and not yet reached."""
    sent = shard.sparkSession.sparkContext.broadcast(reached)

    def in_cycle(start):
        return (start <= step) & (step < start + shards)

    def counted(part: Slice):
        if step < shards:
            live = np.flatnonzero(part.step1[1:] >= step) + 1
            yield 1, part.h1[live], part.count_words()[live]
        if not sent.value[1].steps:
            return
        part.find_pairs()
        start = np.maximum(part.step1[part.left], part.step1[part.right]) + 1
        live = np.flatnonzero(in_cycle(start) & (part.step2 >= step))
        yield 2, part.h2[live], part.count_pairs()[live]
        if sent.value[2].steps:
            first, second, n = part.triples(in_cycle)
            yield 3, part.h3(first, second), n

    def run(batches):
        for _, part in _each_slice(batches, sent.value, shift):
            for words, hashes, n in counted(part):
                keys = short(hashes, shift)
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                buckets = (keys >> np.uint64(32)).astype(np.int64)
                low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                cut = np.flatnonzero(np.diff(buckets)) + 1
                bounds = [0, *cut.tolist(), len(keys)]
                yield _block_rows([
                    _block(words, int(buckets[i]), low[i:j], n[i:j])
                    for i, j in zip(bounds, bounds[1:]) if i < j
                ])

    made = shard.select("lang", "vocabulary", "codes").mapInArrow(run, _BLOCKS)
    return materialize(made, f"scan-{step}")


def add_up(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks per bucket: keys with their sums, apart by whether they have reached it."""

    def merge(batches):
        key, keys, counts = None, [], []

        def done():
            known, where = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
            full = sums >= least
            kinds = [k for k in (False, True) if (full == k).any()]
            rows = [_block(*key, known[full == k], sums[full == k]) for k in kinds]
            return _block_rows(rows, {
                "full": pa.array(kinds, pa.bool_()),
                "size": pa.array([int((full == k).sum()) for k in kinds], pa.int64()),
            })

        for batch in batches:
            for words, bucket, some, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (words, bucket) != key:
                    if key is not None:
                        yield done()
                    key, keys, counts = (words, bucket), [], []
                keys.append(np.cumsum(unpack(some), dtype=np.uint32))
                counts.append(unpack(n))
        if key is not None:
            yield done()

    return (
        blocks.select("words", "bucket", "keys", "n")
        .repartition("words", "bucket").sortWithinPartitions("words", "bucket")
        .mapInArrow(merge, f"{_BLOCKS}, full boolean, size long")
    )


def _note(reached: dict[int, Reached], step: int, sums: DataFrame) -> None:
    full = sums.filter("full")
    sizes = {r["words"]: r["n"] for r in full.groupBy("words").agg(F.sum("size").alias("n")).collect()}
    for words, n in sizes.items():
        reached[words].add(step, full.filter(F.col("words") == words), n)


def find_phrases(table: DataFrame, least: int, shards: int, shift: int) -> dict[int, Reached]:
    """Filters that hold every phrase with ``least`` occurrences or more."""
    reached = {k: Reached() for k in range(1, LONGEST + 1)}
    scans: list[DataFrame] = []
    waiting = None  # sums of words and pairs that have not reached it
    while (step := len(scans)) < shards or step <= max(reached[k].last() for k in (1, 2)) + shards:
        shard = table.filter(F.col("shard") == step % shards)
        scans.append(scan(shard, step, shards, reached, shift))
        if step < shards or step <= reached[1].last() + shards:  # pairs are in their cycle
            blocks = scans[-1].filter(F.col("words") < LONGEST)
            if waiting is not None:
                blocks = blocks.unionByName(waiting.select("words", "bucket", "keys", "n"))
            sums = materialize(add_up(blocks, least), f"sums-{step}")
            _note(reached, step, sums)
            # Words are done after one cycle.
            waiting = sums.filter(~F.col("full") & (F.col("words") > (1 if step >= shards - 1 else 0)))
    longest = scans[0]
    for found in scans[1:]:
        longest = longest.unionByName(found)
    longest = materialize(add_up(longest.filter(F.col("words") == LONGEST), least), "sums-longest")
    _note(reached, len(scans), longest)
    return reached


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases with n >= least, (lang, n) of all words)."""
    table = slices(docs, shards)
    total = table.groupBy("lang").agg(F.sum("n_words").alias("n"))
    n_words = total.agg(F.sum("n")).first()[0] or 0
    shift = min(MOST_BUCKETS_SHIFT, max(4, int(n_words).bit_length() - BUCKET_SHIFT))
    sent = docs.sparkSession.sparkContext.broadcast(find_phrases(table, least, shards, shift))

    def named(part: Slice):
        texts = pa.array(part.words, pa.binary())
        live = np.flatnonzero(part.step1 < NEVER)
        yield 1, texts.take(live), part.count_words()[live], part.h1[live]
        part.find_pairs()
        two = pc.binary_join_element_wise(texts.take(part.left), texts.take(part.right), b" ")
        live = np.flatnonzero(part.step2 < NEVER)
        yield 2, two.take(live), part.count_pairs()[live], part.h2[live]
        first, second, n = part.triples()
        h3 = part.h3(first, second)
        live = np.flatnonzero(sent.value[3].step_of(short(h3, shift)) < NEVER)
        last = texts.take(part.right[second[live]])
        three = pc.binary_join_element_wise(two.take(first[live]), last, b" ")
        yield 3, three, n[live], h3[live]

    def run(batches):
        for lang, part in _each_slice(batches, sent.value, shift):
            for words, phrase, n, hashes in named(part):
                yield _text_blocks(lang, words, phrase, n, short(hashes, shift) >> np.uint64(32))

    phrases = (
        table.select("lang", "vocabulary", "codes").mapInArrow(run, _TEXT_BLOCKS)
        .repartition("lang", "words", "bucket").sortWithinPartitions("lang", "words", "bucket")
        .mapInArrow(_add_texts(least), "lang string, words int, phrase binary, n long")
        .withColumn("phrase", F.col("phrase").cast("string"))
    )
    return materialize(phrases, "phrases"), total


_TEXT_BLOCKS = "lang string, words int, bucket int, texts binary, n binary"


def _text_blocks(lang, words, phrase, n, buckets) -> pa.RecordBatch:
    """Phrases in order, a block for each bucket (no phrase holds a line feed)."""
    whole = pa.table({"bucket": pa.array(buckets.astype(np.int32)), "phrase": phrase})
    order = pc.sort_indices(whole, [("bucket", "ascending"), ("phrase", "ascending")])
    n, phrase = n[order.to_numpy()], phrase.take(order)
    buckets = buckets[order.to_numpy()].astype(np.int64)
    cut = np.flatnonzero(np.diff(buckets)) + 1
    bounds = [0, *cut.tolist(), len(n)] if len(n) else [0]
    spans = list(zip(bounds, bounds[1:]))
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(spans), pa.string()),
        "words": pa.array([words] * len(spans), pa.int32()),
        "bucket": pa.array([int(buckets[i]) for i, _ in spans], pa.int32()),
        "texts": pa.array([b"\n".join(phrase[i:j].to_pylist()) for i, j in spans], pa.binary()),
        "n": pa.array([pack(n[i:j]) for i, j in spans], pa.binary()),
    })


def _add_texts(least: int):
    def merge(batches):
        key, parts = None, []

        def done():
            sums = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
            sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
            lang, words, _ = key
            for batch in sums.to_batches(_OUT_ROWS):
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.repeat(pa.scalar(lang, pa.string()), len(batch)),
                    "words": pa.repeat(pa.scalar(words, pa.int32()), len(batch)),
                    "phrase": batch["phrase"], "n": batch["n_sum"],
                })

        for batch in batches:
            for *this, texts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != key:
                    if key is not None:
                        yield from done()
                    key, parts = this, []
                parts.append(pa.table({
                    "phrase": pa.array(texts.split(b"\n"), pa.binary()),
                    "n": pa.array(unpack(n).astype(np.int64)),
                }))
        if key is not None:
            yield from done()

    return merge


def collocations(
    docs: DataFrame, least: int = LEAST, most: int = MOST, shards: int = SHARDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language.

    The score of a cut is the count of the phrase against those of its two parts, in
    millionths, and exact (decimals); the weakest cut counts.
    """
    phrases, totals = count_phrases(docs, least, shards)
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    longer = phrases.filter(F.col("words") > 1).select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w")
    )
    inside = (
        longer.filter(F.col("words") == 3)
        .select(
            "lang", "a",
            F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, 2)), F.concat_ws(" ", F.slice("w", 2, 2))))
            .alias("phrase"),
        )
        .groupBy("lang", "phrase").agg(F.max("a").alias("in_longer"))
    )
    kept = longer.join(inside, ["lang", "phrase"], "left").filter(
        F.col("in_longer").isNull() | (100 * F.col("in_longer") < COVERED * F.col("a"))
    )
    cut = F.when(F.col("words") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    cuts = kept.select("lang", "phrase", "words", "a", "w", F.explode(cut).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("rest"),
    )
    scored = (
        cuts.join(counts.withColumnsRenamed({"part": "head", "times": "l"}), ["lang", "head"])
        .join(counts.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"])
        .withColumn(
            "score",
            F.expr(
                "(cast(1000000 as decimal(38, 0)) * cast(a as decimal(38, 0)) * a)"
                " div (cast(l as decimal(38, 0)) * r)"
            ),
        )
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS)))
    for keys in (["lang", "part"], ["lang", "part"], ["lang"]):  # a language in parts first
        ranked = ranked.withColumn(
            "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        ).filter(F.col("rank") <= most)
        ranked = ranked.withColumn("part", F.col("part") % _FEWER_PARTS)
    return (
        ranked
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
