"""A trie over the turns of conversations, with totals of each node's subtree.

A node is a distinct sequence of first turns (role, text).  Prefixes travel as digests:
each turn's digest is hashed with its depth and the hashes are added up by XOR, so that
long conversations are digested in slices.  A count-min sketch over all prefix digests
screens them first.  Its estimate is never too low: where it says one, the prefix
belongs to a single conversation, and so does everything below it.  Such tails are
written out where they are read.  Only prefixes that may be shared are shuffled and
grouped exactly; a sketch that is too small for its input makes more of these and
changes no result.

Subtree totals need no walk level by level.  The conversation with the smallest id
stands for a node, and from some depth on it stands for every node on its path.  Each
node's own value is booked on that conversation; a node's total is the sum over its
members of what is booked on them, less what its own conversation has booked above it.

NULL roles and texts are empty.  NULL turns come first; turns that tie, repeated rows
included, are ordered by a digest of role and text.  Rows without conv_id belong to no
conversation and give no node.  Very long texts are reduced to a digest in the first
step; conversations of any number of turns are cut into slices of ``SLICE`` depths.
Other columns are not read.  Without conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.llm.running import running_before
from factfade.llm.words import mixed
from factfade.session import materialize

#: Turns that a conversation may take from the first one of its hundred.
MOST_LENT = 5
HUNDRED = 100
#: Depths that a window covers at once (a power of two, as a shift).
SLICE_SHIFT = 10
#: Ids that are joined into one piece of text before they are hashed (as a shift).
IDS_SHIFT = 9

#: Count-min sketch: hash rows, cells of a block, and bounds of the cells in a row.  What
#: reaches the tasks is one bit a cell, so 48 MB at most.
SKETCH_ROWS = 3
BLOCK = 1 << 16
LEAST_WIDTH = 1 << 16
MOST_WIDTH = 1 << 27
CELLS_PER_PREFIX = 4

KEY = ["depth", "x1", "x2"]
MAYBE, FIRST, TAIL = 0, 1, 2


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of every row that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def lent_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % (MOST_LENT + 1)


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) and (conv_id, length) of rebuilt conversations.

    A conversation takes the first turns of the first one of its hundred in place of as
    many of its own.
    """
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    numbered = materialize(
        running_before(
            turns.withColumn("one", F.lit(1).cast("long")), ["conv_id"], order, {"before": "one"}
        ).select("conv_id", (F.col("before") + 1).alias("k"), "digest", "chars"),
        "turns",
    )
    counts = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    lenders = counts.filter(F.col("conv_id") % HUNDRED == 0).select(
        F.col("conv_id").alias("lender"), F.col("n").alias("lender_n")
    )
    convs = materialize(
        counts.withColumn("h", lent_turns(F.col("conv_id")))
        .withColumn("lender", F.col("conv_id") - F.col("conv_id") % HUNDRED)
        .join(lenders, "lender", "left")
        .withColumn("lent", F.least("h", F.coalesce("lender_n", F.lit(0).cast("long"))))
        .withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
        "conversations",
    )
    heads = numbered.filter(
        (F.col("conv_id") % HUNDRED == 0) & (F.col("k") <= MOST_LENT)
    ).withColumnRenamed("conv_id", "lender")
    borrowed = (
        convs.select("conv_id", "lender", "h").join(heads, "lender")
        .filter(F.col("k") <= F.col("h"))
        .select("conv_id", F.col("k").alias("depth"), "digest", "chars")
    )
    own = (
        numbered.join(convs.select("conv_id", "h", "lent"), "conv_id")
        .filter(F.col("k") > F.col("h"))
        .select(
            "conv_id", (F.col("k") - F.col("h") + F.col("lent")).alias("depth"), "digest", "chars"
        )
    )
    return borrowed.unionByName(own), convs.select("conv_id", "length")


def _running(df: DataFrame, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, for ``new: (old, function)``, the function over shallower rows of conv_id.

    ``function`` is ``sum`` or ``bit_xor``.  Windows cover one slice of depths; one row
    per slice carries on what came before.
    """
    combine = {
        "sum": (F.sum, lambda a, b: a + b),
        "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    }
    zero = F.lit(0).cast("long")
    df = df.withColumn("_slice", F.shiftright("depth", SLICE_SHIFT))
    keys = ["conv_id", "_slice"]
    slices = df.groupBy(*keys).agg(
        *[combine[f][0](old).alias(f"_all_{new}") for new, (old, f) in values.items()]
    )
    earlier = (
        Window.partitionBy("conv_id").orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = slices.select(
        *keys,
        *[
            F.coalesce(combine[f][0](f"_all_{new}").over(earlier), zero).alias(f"_before_{new}")
            for new, (_, f) in values.items()
        ],
    ).filter(F.col("_slice") > 0)
    inside = (
        Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    )
    out = df.select(
        "*",
        *[
            F.coalesce(combine[f][0](old).over(inside), zero).alias(f"_in_{new}")
            for new, (old, f) in values.items()
        ],
    ).join(slices, keys, "left")
    for new, (_, f) in values.items():
        joined = combine[f][1](F.col(f"_in_{new}"), F.coalesce(f"_before_{new}", zero))
        out = out.withColumn(new, joined).drop(f"_in_{new}", f"_before_{new}")
    return out.drop("_slice")


def prefixes(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and depth from 1: digest of the prefix and of its parent."""
    lanes = [
        F.xxhash64(F.lit(lane), F.col("depth").cast("long"), F.col("digest")).alias(f"own{lane}")
        for lane in (1, 2)
    ]
    turns = materialize(rebuilt.select("conv_id", "depth", "chars", *lanes), "rebuilt")
    above = _running(turns, {"p1": ("own1", "bit_xor"), "p2": ("own2", "bit_xor")})
    return materialize(
        above.join(lengths, "conv_id").select(
            "conv_id", F.col("depth").cast("long").alias("depth"),
            F.col("p1").bitwiseXOR(F.col("own1")).alias("x1"),
            F.col("p2").bitwiseXOR(F.col("own2")).alias("x2"),
            "p1", "p2", "chars", (F.col("depth") == F.col("length")).alias("last"),
        ),
        "prefixes",
    )


def cells(x1: np.ndarray, x2: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell of each digest in every row of the sketch."""
    a, b = x1.astype(np.int64).view(np.uint64), x2.astype(np.int64).view(np.uint64)
    for row in range(SKETCH_ROWS):
        yield mixed(a + mixed(b + np.uint64(row))) & np.uint64(width - 1)


def sketch_width(n: int) -> int:
    width = LEAST_WIDTH
    while width < min(CELLS_PER_PREFIX * n, MOST_WIDTH):
        width *= 2
    return width


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def shared_cells(rows: DataFrame, width: int) -> np.ndarray:
    """Bits (``SKETCH_ROWS`` x width) of the cells that count two digests or more.

    Tasks count their own rows and send each block of cells as the places that hold one
    and those that hold more; blocks are added up in a stream, one block in memory.
    """
    blocks = width // BLOCK

    def count(batches):
        for batch in batches:
            slots, ones, more = [], [], []
            for row, at in enumerate(cells(_numbers(batch, "x1"), _numbers(batch, "x2"), width)):
                where, times = np.unique(at.astype(np.int64), return_counts=True)
                cut = np.flatnonzero(np.diff(where // BLOCK)) + 1
                for places, n in zip(np.split(where, cut), np.split(times, cut), strict=True):
                    if len(places):
                        slots.append(row * blocks + int(places[0]) // BLOCK)
                        offsets = (places % BLOCK).astype("<u2")
                        ones.append(offsets[n == 1].tobytes())
                        more.append(offsets[n > 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())],
                ["slot", "ones", "more"],
            )

    def add_up(batches):
        slot, seen = None, np.zeros(BLOCK, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())],
                ["slot", "bits"],
            )

        for batch in batches:
            for s, ones, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != slot:
                    if slot is not None:
                        yield done()
                    slot = s
                    seen[:] = 0
                at = np.frombuffer(ones, "<u2")
                seen[at] = np.minimum(seen[at] + 1, 2)
                seen[np.frombuffer(more, "<u2")] = 2
        if slot is not None:
            yield done()

    counted = rows.select("x1", "x2").mapInArrow(count, "slot int, ones binary, more binary")
    added = (
        counted.repartition("slot").sortWithinPartitions("slot")
        .mapInArrow(add_up, "slot int, bits binary")
    )
    out = np.zeros((SKETCH_ROWS, width // 8), np.uint8)
    flat = out.reshape(SKETCH_ROWS * blocks, BLOCK // 8)
    for found in added.collect():  # one row per block: the bound of the sketch
        flat[found["slot"]] = np.frombuffer(found["bits"], np.uint8)
    return out


def may_be_shared(x1: np.ndarray, x2: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the estimate of each digest is two or more."""
    shared = np.ones(len(x1), bool)
    for row, at in enumerate(cells(x1, x2, bits.shape[1] * 8)):
        byte = bits[row, (at >> np.uint64(3)).astype(np.int64)]
        shared &= (byte >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return shared


def screen(rows: DataFrame) -> DataFrame:
    """Prefixes with ``kind``: MAYBE shared, FIRST or further (TAIL) single ones."""
    width = sketch_width(rows.count())
    sent = rows.sparkSession.sparkContext.broadcast(shared_cells(rows, width))

    def mark(batches):
        for batch in batches:
            own = may_be_shared(_numbers(batch, "x1"), _numbers(batch, "x2"), sent.value)
            above = may_be_shared(_numbers(batch, "p1"), _numbers(batch, "p2"), sent.value)
            above |= _numbers(batch, "depth") == 1  # the root is never single
            kind = np.where(own & above, MAYBE, np.where(above, FIRST, TAIL)).astype(np.int32)
            yield batch.append_column("kind", pa.array(kind))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(rows.mapInArrow(mark, f"{fields}, kind int").drop("p1", "p2"), "screened")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): SHA-256 of the ids in order, comma-joined.

    Ids meet in pieces of bounded length; the pieces of a node pass one task in a stream.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = (
        ends.withColumn("piece", F.shiftright("conv_id", IDS_SHIFT)).groupBy(*KEY, "piece")
        .agg(F.array_join(ids, ",").alias("ids"))
    )

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for *this, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = this, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _hash_rows(out)
        if key is not None:
            yield _hash_rows([(*key, sha.hexdigest())])

    return (
        pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
        .mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")
    )


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "ends_sha256"]
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over all rebuilt conversations."""
    rebuilt, lengths = rebuild(turn_digests(conversations))
    return trie_of(prefixes(rebuilt, lengths), lengths)


def trie_of(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie from all prefixes and the lengths of all conversations."""
    screened = screen(rows)
    zero = F.lit(0).cast("long")
    roots = lengths.select(
        "conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("chars"),
        (F.col("length") == 0).alias("last"),
    )
    maybe = screened.filter(F.col("kind") == MAYBE).drop("kind").unionByName(roots)
    nodes = materialize(
        maybe.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.max("chars").alias("chars"), F.sum(F.col("last").cast("long")).alias("n_ends"),
            F.min_by("last", "conv_id").alias("rep_ends"),
        )
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        .withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")),
        "nodes",
    )
    single = screened.filter(F.col("kind") != MAYBE)
    # What is booked on a conversation, and the depth from which it stands for its path.
    booked = (
        nodes.select("conv_id", "depth", "saved", "leaf")
        .unionByName(
            single.filter((F.col("kind") == FIRST) | F.col("last")).select(
                "conv_id", F.when(F.col("kind") == FIRST, F.col("depth")).alias("depth"),
                zero.alias("saved"), F.col("last").cast("long").alias("leaf"),
            )
        )
    )
    tops = materialize(
        booked.groupBy("conv_id").agg(
            F.min("depth").alias("top"), F.sum("saved").alias("booked_saved"),
            F.sum("leaf").alias("booked_leaves"),
        ),
        "tops",
    )
    members = materialize(maybe.join(tops, "conv_id"), "members")
    totals = members.groupBy(*KEY).agg(
        F.sum("booked_saved").alias("all_saved"), F.sum("booked_leaves").alias("n_leaves"),
        F.sum((F.col("top") == F.col("depth") + 1).cast("long")).alias("new_children"),
    )
    # The node above a conversation's topmost one belongs to another conversation.
    parents = (
        members.filter(F.col("depth") == F.col("top") - 1).select("conv_id", "top", *KEY)
        .join(nodes.select(*KEY, F.col("conv_id").alias("above")), KEY)
        .select("conv_id", "above")
    )
    tops = materialize(
        tops.select("conv_id", "top").join(parents, "conv_id", "left"), "parents"
    )
    parent = F.when(
        F.col("depth") > 0,
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    hashes = end_hashes(maybe.filter("last").select(*KEY, "conv_id"))
    grouped = (
        _running(nodes, {"saved_above": ("saved", "sum")})
        .join(totals, KEY).join(hashes, KEY, "left").join(tops, "conv_id")
        .select(
            "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs",
            (F.coalesce("new_children", zero) + (~F.col("rep_ends")).cast("long"))
            .alias("n_children"),
            "n_leaves", (F.col("all_saved") - F.col("saved_above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )

    def alone(rows: DataFrame, above: Column) -> DataFrame:
        one = F.lit(1).cast("long")
        return rows.select(
            "conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"),
            (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256))
            .otherwise(F.lit(nothing)).alias("ends_sha256"),
        )

    firsts = alone(single.filter(F.col("kind") == FIRST).join(tops, "conv_id"), parent)
    tails = alone(single.filter(F.col("kind") == TAIL), F.col("conv_id"))
    return grouped.unionByName(firsts).unionByName(tails)
