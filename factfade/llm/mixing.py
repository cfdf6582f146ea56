"""Sources mixed to target weights, block by block, with DataFrame functions only.

The words of a source, in order of its documents, are cut into blocks of equal
length.  Every output shard draws the source of each of its slots, so its counts per
source are multinomial with the targets as probabilities.  The slots of a source are
numbered through all shards and mapped to its blocks by a pseudorandom permutation:
each pass over a source uses every block once, so none is used oftener than the cap
allows.  What the draw missed of a target goes to a last shard; what it drew too
much is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.llm.running import running_before
from factfade.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
ROUNDS = 16
TASK_SLOTS = 100_000
MOST_TASKS = 50_000


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): the number of words, 0 for NULL text."""
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(words, F.lit(0)).alias("size"),
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    passes: int = MOST_PASSES,
) -> DataFrame:
    """(source_no, source, source_size, weight, target), one row per source.

    Sources count in the order of their code points, NULL last, and take the weights
    in turn.  They share ``share`` times all words; no target exceeds ``passes``
    times its source, and the excess goes to the others by weight.  The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name).cast("long"))
        .withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"),
            ),
        )
        .withColumn("most", F.col("source_size") * F.lit(float(passes)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    # Sources that are full first, come first: each is full if the level that the
    # sources before it leave to the rest reaches it.
    by_ratio = Window.orderBy("ratio", "source_no")
    whole = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levelled = numbered.select(
        "*",
        (
            (F.sum("source_size").over(whole) * F.lit(share)
             - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    ).withColumn("full", F.col("ratio") <= F.col("level"))
    open_level = F.min(F.when(~F.col("full"), F.struct("ratio", "source_no", "level"))).over(whole)
    return levelled.withColumn("_open", open_level).select(
        "source_no", "source", "source_size", "weight",
        F.least(
            F.col("most"),
            F.coalesce(F.col("weight") * F.col("_open.level"), F.col("most")),
        ).alias("target"),
    )


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Place of ``x`` in a pseudorandom permutation of 0..n-1 (swap-or-not rounds)."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        swap = F.xxhash64(key, r, F.greatest(at, partner), F.lit(7)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def draw_slots(plan: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source_no, first, n): numbered slots of every source in every shard.

    ``plan`` has one row per source: source_no, slots (how many it gets in all).
    """
    spark = plan.sparkSession
    by_no = Window.orderBy("source_no")
    until = F.sum("slots").over(by_no.rowsBetween(Window.unboundedPreceding, 0))
    ranges = materialize(
        plan.select("source_no", "slots", (until - F.col("slots")).alias("low"), until.alias("high")),
        "mix-ranges",
    )
    n_sources, total = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    # Cells cut [0, total) so that a draw meets only the sources of its own cell.
    cells = 1 << max(10, (4 * n_sources).bit_length())
    width = max(1, -(-total // cells))
    cell_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    cut = ranges.filter("slots > 0").withColumn(
        "cell", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high") - 1)))
    )
    drawn = (
        spark.range(total)
        .select(
            F.floor(F.col("id") / F.lit(shard_slots)).cast("long").alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("u"),
        )
        .withColumn("cell", cell_of(F.col("u")))
        .join(cut, "cell").filter("u >= low AND u < high")
        .groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    )
    drawn = materialize(drawn, "mix-draws")
    numbered = running_before(drawn, ["source_no"], [F.col("shard")], {"first": "n"})
    kept = numbered.join(ranges.select("source_no", "slots"), "source_no").select(
        "shard", "source_no", "first", F.least(F.col("n"), F.col("slots") - F.col("first")).alias("n")
    )
    totals = drawn.groupBy("source_no").agg(F.sum("n").alias("got"))
    last = F.lit(-(-total // shard_slots))
    missed = (
        ranges.join(totals, "source_no", "left")
        .withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
        .withColumn("first", F.explode(F.sequence(F.col("got"), F.col("slots") - 1, F.lit(shard_slots).cast("long"))))
        .select(
            last.cast("long").alias("shard"), "source_no", "first",
            F.least(F.lit(shard_slots).cast("long"), F.col("slots") - F.col("first")).alias("n"),
        )
    )
    return kept.filter("n > 0").unionByName(missed)


class Mix:
    """What ``mix`` decided: ``sources``, ``placed`` documents, ``slots`` and ``uses``."""

    def __init__(self, sources: DataFrame, placed: DataFrame, slots: DataFrame, block_words: int):
        self.sources, self.placed, self.slots, self.block_words = sources, placed, slots, block_words
        self.uses = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))

    def segments(self) -> DataFrame:
        """The part of each document in each block: words [low, high) of the source."""
        block = F.lit(self.block_words)
        start, stop = F.col("start"), F.col("start") + F.col("size")
        return (
            self.placed.filter("size > 0")
            .withColumn("block", F.explode(F.sequence(
                F.floor(start / block).cast("long"), F.floor((stop - 1) / block).cast("long")
            )))
            .withColumn("low", F.greatest(start, F.col("block") * block))
            .withColumn("high", F.least(stop, (F.col("block") + 1) * block))
            .join(self.uses, ["source_no", "block"], "left")
            .withColumn("uses", F.coalesce("uses", F.lit(0)))
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        key = ["source_no", "start", "doc_id", "size"]
        some = self.segments().groupBy(*key).agg(
            F.sum((F.col("high") - F.col("low")) * F.col("uses")).alias("taken")
        )
        none = self.placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
        facts = self.sources.select("source_no", "source_size", "target")
        return some.unionByName(none).join(facts, "source_no").select(
            "doc_id", "size", "source_size", "target", "taken"
        )

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mix as rows like ``docs``: what the drawn blocks hold of each document.

        A document taken whole keeps its text; else its drawn words are joined by a
        space.  One whose blocks are drawn twice gives a row for each pass.  Documents
        without words are in no block.  ``n_chars``, where there is one, follows the text.
        """
        key = ["source_no", "start", "doc_id", "size", "text_hash"]
        drawn = (
            self.segments().groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("block", "uses"))).alias("blocks"))
            .withColumn("block_uses", F.transform("blocks", lambda b: b["uses"]))
            .withColumn("most", F.array_max("block_uses")).filter("most > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
            .join(self.sources.select("source_no", "source"), "source_no")
            .select(
                F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"),
                F.col("text_hash").alias("_mix_hash"), F.col("block_uses").alias("_mix_uses"),
                F.col("copy").alias("_mix_copy"),
                F.pmod("start", F.lit(self.block_words)).alias("_mix_offset"),
            )
        )
        # Columns of ``docs`` may have any names: they travel under numbers.
        numbers = {name: f"_doc_{k}" for k, name in enumerate(docs.columns)}
        rows = docs.toDF(*numbers.values())
        doc_id, source, text = (F.col(numbers[c]) for c in ("doc_id", "source", "text"))
        rows = rows.withColumn("_text_hash", F.xxhash64(text.cast("string")))
        rows = rows.dropDuplicates([numbers["doc_id"], numbers["source"], "_text_hash"])
        joined = rows.join(
            drawn,
            doc_id.cast("long").eqNullSafe(F.col("_mix_id"))
            & source.cast("string").eqNullSafe(F.col("_mix_source"))
            & (F.col("_text_hash") == F.col("_mix_hash")),
        )

        def drawn_word(_: Column, place: Column) -> Column:
            block = F.floor((F.col("_mix_offset") + place) / F.lit(self.block_words)).cast("int")
            return F.get(F.col("_mix_uses"), block) >= F.col("_mix_copy")

        # The words are cut once per row, as the argument of the filter.
        words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), drawn_word)
        whole = F.forall("_mix_uses", lambda uses: uses >= F.col("_mix_copy"))
        taken = F.when(whole, text).otherwise(F.array_join(words, " "))
        out = joined.withColumn(numbers["text"], taken).select(
            *[F.col(number).alias(name) for name, number in numbers.items()]
        )
        if "n_chars" in docs.columns:
            kind = docs.schema["n_chars"].dataType
            out = out.withColumn("n_chars", F.char_length("text").cast(kind))
        return out


def mix(
    docs: DataFrame, seed: int = 20, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, passes: int = MOST_PASSES,
) -> Mix:
    """Choose the blocks of ``docs`` (doc_id, text, source) that the mix takes.

    NULL text has no words; NULL is a source of its own, ordered last.  Documents of
    a source lie in order of doc_id (NULL first), size and a hash of the text; repeated rows
    are documents of their own.  A text of any length is a run of blocks.  An empty
    table gives an empty mix; other columns are not read.
    """
    sizes = materialize(document_sizes(docs), "mix-sizes")
    sources = materialize(source_targets(sizes, weights, share, passes), "mix-sources")
    numbered = sizes.join(
        sources.select("source_no", F.col("source").alias("_s")),
        F.col("source").eqNullSafe(F.col("_s")),
    ).select("doc_id", "source_no", "text_hash", "size")
    placed = running_before(
        numbered, ["source_no"],
        [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_hash")], {"start": "size"},
    )
    plan = sources.withColumn(
        "blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    ).withColumn(
        "slots",
        F.when(
            F.col("source_size") > 0,
            F.least(
                F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"),
                F.col("blocks") * F.lit(passes),
            ),
        ).otherwise(F.lit(0).cast("long")),
    )
    plan = materialize(plan.select("source_no", "blocks", "slots"), "mix-plan")
    drawn = draw_slots(plan, seed, shard_slots)
    # The draws are a small table, the permutations of their slots the work: the number
    # of tasks follows the slots.
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    tasks = min(max(-(-total // TASK_SLOTS), 1), MOST_TASKS)
    numbered_slots = (
        drawn.repartition(tasks, "source_no", "first").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
        .join(plan.select("source_no", "blocks"), "source_no")
        .withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    )
    key = F.xxhash64(F.lit(seed), F.col("source_no"), F.col("pass"))
    slots = numbered_slots.withColumn("key", key).select(
        "shard", "source_no", "slot", "pass",
        permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("key")).alias("block"),
    )
    return Mix(sources, placed, materialize(slots, "mix-slots"), block_words)
