"""A text index that is kept on shared storage and maintained by writes.

Postings lie in blocks of rows of about equal weight, heaviest first, in folders by
batch and by bucket of the token.  A search reads only the buckets of its words.  A
block carries the highest weight of its rows at the mean length of its batch; it bounds
the weights at any later mean, so blocks that cannot matter are never opened.

A write adds a folder for its batch: blocks of the new rows, and changes to the number
of rows that hold a token.  Rows that are taken out change these numbers only; their
entries are passed over because the rows are no longer visible.  Writing a batch again
replaces its folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factfade.functions.text import tokens
from factfade.model import Memory, Write
from factfade.operators.textindex import (
    _FIELD_BREAK,
    _ROW_MARK,
    _SLACK,
    B,
    IDF_FLOOR,
    K1,
    add_common,
    bringing_terms,
    score_of_rank,
    text_weights,
)
from factfade.operators.visibility import live_observations
from factfade.session import materialize

BUCKETS = 64
BLOCK_ROWS = 128
_HASH_BITS = 24  # of a word beside its bucket, when entries are sorted

_ENTRY = "struct<obs_id:bigint,entity_id:bigint,row_tokens:int,at:array<int>>"
_CUT = f"token string, peak double, mean double, n int, entries array<{_ENTRY}>"
_BLOCKS = f"{_CUT}, batch int, token_bucket int"
_PLACES = "obs_id long, entity_id long, row_tokens int, token string, tf int, at binary"
_COUNTS = "token string, n long, batch int, token_bucket int"
_TOTALS = "n_rows long, all_tokens long, batch int"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _rows(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """(obs_id, entity_id, row_tokens, words); a break no phrase crosses is between fields."""
    # Written once: its true size lets a small table of names go to the texts, not both be dealt.
    names = materialize(
        entities.select(F.col("id").alias("entity_id"), tokens(F.col("name")).alias("_name")),
        "index-names",
    )
    empty = F.array().cast("array<string>")
    return (
        observations.filter(F.col("deleted_at").isNull())
        .select(
            F.col("id").alias("obs_id"), "entity_id", tokens(F.col("content")).alias("_content"),
            tokens(F.col("entity_type")).alias("_type"),
        )
        .join(names, "entity_id", "left")
        .withColumn("_name", F.coalesce("_name", empty))
        .select(
            "obs_id", "entity_id",
            (F.size("_name") + F.size("_content") + F.size("_type")).alias("row_tokens"),
            F.concat("_name", F.array(F.lit(_FIELD_BREAK)), "_content",
                     F.array(F.lit(_FIELD_BREAK)), "_type").alias("words"),
        )
    )


def _saturation(tf: Column, row_tokens: Column, mean: float) -> Column:
    """The part of a BM25 weight that depends on the row."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * row_tokens / F.lit(mean)))


def _places(batches):
    """One row per word of a row, with its places: words meet in the row they stand in."""
    for batch in batches:
        words = batch["words"]
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), length)
        at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((at, code, row))
        row, code, at = row[order], code[order], at[order].astype("<i4")
        first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(code, prepend=-1))
        tf = np.diff(first, append=len(row))
        offsets = pa.array(4 * np.append(first, len(row)), pa.int32())
        places = pa.Array.from_buffers(
            pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(at.tobytes())]
        )
        of_row = pa.array(row[first])
        out = pa.RecordBatch.from_pydict({
            "obs_id": batch["obs_id"].take(of_row), "entity_id": batch["entity_id"].take(of_row),
            "row_tokens": batch["row_tokens"].take(of_row).cast(pa.int32()),
            "token": coded.dictionary.take(pa.array(code[first])).cast(pa.string()),
            "tf": pa.array(tf, pa.int32()), "at": places,
        })
        yield out.filter(pc.not_equal(out["token"], _FIELD_BREAK))


def _cut_blocks(mean: float):
    """Entries in order to blocks of at most BLOCK_ROWS of one token."""
    fields = ("obs_id", "entity_id", "row_tokens", "at")

    def blocks(entries: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        bounds = np.append(cut, len(entries))
        entries = entries.combine_chunks()
        columns = {c: _one(entries[c]) for c in entries.column_names}
        places = columns["at"]
        sizes = pc.binary_length(places).to_numpy(zero_copy_only=False) // 4
        at = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
            pa.array(np.frombuffer(b"".join(places.to_pylist()), "<i4")),
        )
        rows = pa.StructArray.from_arrays([*(columns[c] for c in fields[:-1]), at], names=list(fields))
        starts = pa.array(cut)
        return pa.RecordBatch.from_pydict({
            "token": columns["token"].take(starts),
            "peak": pa.array(-columns["heavy"].take(starts).to_numpy()),
            "mean": pa.array(np.full(len(cut), mean)),
            "n": pa.array(np.diff(bounds), pa.int32()),
            "entries": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows),
            "token_bucket": pc.shift_right(columns["word_no"].take(starts), _HASH_BITS).cast(pa.int32()),
        })

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if not len(held):
                continue
            # The last block may go on in the next batch.
            cut = _block_starts(_one(held["token"].combine_chunks()))
            if len(cut) > 1:
                yield blocks(held.slice(0, int(cut[-1])), cut[:-1])
                held = held.slice(int(cut[-1]))
        if held is not None and len(held):
            yield blocks(held, _block_starts(_one(held["token"].combine_chunks())))

    return run


def _one(column):
    """A column in one piece."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _block_starts(token: pa.Array) -> np.ndarray:
    """Where a token begins, and every BLOCK_ROWS entries after that."""
    n = len(token)
    new = np.append(True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))
    since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero(since % BLOCK_ROWS == 0)


class TextIndex:
    """The index of one scope at a path all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, mem: Memory, path: str, buckets: int = BUCKETS) -> "TextIndex":
        index = cls(mem.observations.sparkSession, path, buckets)
        index.add(mem.observations, mem.entities, batch=0)
        return index

    # Writing

    def _put(self, df: DataFrame, table: str, batch: int, by_bucket: bool = True) -> None:
        writer = df.write.mode("overwrite")
        if by_bucket:
            writer = writer.partitionBy("token_bucket")
        writer.parquet(f"{self.path}/{table}/batch={batch}")

    def add(self, observations: DataFrame, entities: DataFrame, batch: int) -> None:
        """Index new rows; rows that are deleted already are left out."""
        rows = materialize(_rows(observations, entities), "index-rows")
        mean = float(rows.agg(F.avg("row_tokens")).first()[0] or 0.0) or 1.0
        # Dealt once, in the order of the blocks: bucket, token, weight.  Blocks are cut
        # where they lie, so a common word is many tasks and entries move a single time.
        # A number tells nearly all words apart: rows are compared without their words.
        bucket = _bucket(F.col("token"), self.buckets).cast("long")
        entries = rows.mapInArrow(_places, _PLACES).select(
            (bucket * F.lit(1 << _HASH_BITS)
             + F.shiftrightunsigned(F.xxhash64("token"), 64 - _HASH_BITS)).alias("word_no"),
            "token",
            (-_saturation(F.col("tf"), F.col("row_tokens"), mean)).alias("heavy"),
            "obs_id", "entity_id", "row_tokens", "at",
        )
        order = ["word_no", "token", "heavy", "obs_id"]
        blocks = (
            entries.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(_cut_blocks(mean), f"{_CUT}, token_bucket int")  # of the sorted number
        )
        self._put(blocks, "blocks", batch)
        counts = (
            self._table("blocks", _BLOCKS).filter(F.col("batch") == batch)
            .groupBy("token_bucket", "token").agg(F.sum("n").alias("n"))
        )
        self._put(counts.repartition("token_bucket"), "counts", batch)
        self._put(_totals(rows, 1), "totals", batch, by_bucket=False)

    def remove(self, observations: DataFrame, entities: DataFrame, batch: int) -> None:
        """Take rows out: ``observations`` as they were before they were deleted."""
        rows = materialize(_rows(observations, entities), "index-removed")
        counts = (
            rows.select(F.explode(F.array_distinct("words")).alias("token"))
            .filter(F.col("token") != _FIELD_BREAK)
            .groupBy("token").agg((-F.count(F.lit(1))).alias("n"))
            .withColumn("token_bucket", _bucket(F.col("token"), self.buckets))
        )
        self._put(counts.repartition("token_bucket"), "counts", batch)
        self._put(_totals(rows, -1), "totals", batch, by_bucket=False)

    def follow(self, before: Memory, write: Write, batch: int) -> None:
        """Bring the index to the state after ``write``, which started from ``before``.

        A write of this library either appends observations or marks some as deleted.
        """
        if "observations" in write.appended:
            self.add(write.appended["observations"], write.memory.entities, batch)
        elif "observations" in write.rewritten:
            gone = write.rewritten["observations"].filter(F.col("deleted_at").isNotNull())
            dying = before.observations.filter(F.col("deleted_at").isNull()).join(
                gone.select("id"), "id", "left_semi"
            )
            self.remove(dying, before.entities, batch)

    # Reading

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(
            f"{self.path}/{name}"
        )

    def _asked(self, name: str, schema: str, asked: DataFrame) -> DataFrame:
        """Rows of a table in the buckets of the asked tokens (at most all buckets)."""
        rows = asked.select(_bucket(F.col("token"), self.buckets).alias("b")).distinct().collect()
        return self._table(name, schema).filter(F.col("token_bucket").isin([r["b"] for r in rows]))

    def totals(self) -> tuple[int, int]:
        """(rows, tokens) in the index."""
        found = self._table("totals", _TOTALS).agg(F.sum("n_rows"), F.sum("all_tokens")).first()
        return found[0] or 0, found[1] or 0

    def counts(self, asked: DataFrame) -> DataFrame:
        """(token, n): rows that hold each asked token."""
        return (
            self._asked("counts", _COUNTS, asked).join(asked, "token", "left_semi")
            .groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
        )

    def all_counts(self) -> DataFrame:
        """(token, n) of all tokens that some row holds."""
        return self._table("counts", _COUNTS).groupBy("token").agg(F.sum("n").alias("n")).filter(
            F.col("n") > 0
        )

    def blocks(self, asked: DataFrame) -> DataFrame:
        return self._asked("blocks", _BLOCKS, asked).join(asked, "token", "left_semi")

    def entries(self, asked: DataFrame) -> DataFrame:
        """(token, obs_id, entity_id, row_tokens, at) of the asked tokens."""
        return self.blocks(asked).select("token", F.inline("entries"))

    def hits(self, phrases: DataFrame, mem: Memory, as_of) -> DataFrame:
        """What ``textindex.phrase_hits`` gives, from the buckets of the asked words."""
        words = F.split("phrase", " ")
        asked = materialize(
            phrases.select("phrase", F.size(words).alias("size"), F.posexplode(words).alias("no", "token")),
            "index-asked",
        )
        single = (
            self.entries(asked.filter("size = 1").select("token").distinct())
            .select(F.col("token").alias("phrase"), "obs_id", "entity_id", "row_tokens",
                    F.size("at").cast("long").alias("tf"))
        )
        found = single.unionByName(self._phrase_entries(asked.filter("size > 1")))
        status = mem.observations.filter(F.col("deleted_at").isNull()).select(
            F.col("id").alias("obs_id")
        ).join(
            live_observations(mem, as_of).select(F.col("id").alias("obs_id"), F.lit(True).alias("live")),
            "obs_id", "left",
        )
        n_rows, all_tokens = self.totals()
        columns = ["phrase", "obs_id", "entity_id", "live", "tf", "row_tokens", "all_tokens"]
        hits = found.join(status, "obs_id").select(
            "phrase", "obs_id", "entity_id", F.coalesce("live", F.lit(False)).alias("live"), "tf",
            F.col("row_tokens").cast("int").alias("row_tokens"),
            F.lit(None).cast("long").alias("all_tokens"),
        )
        mark = self.spark.createDataFrame(
            [(_ROW_MARK, None, None, None, n_rows, None, all_tokens)],
            "phrase string, obs_id long, entity_id long, live boolean, tf long, row_tokens int, "
            "all_tokens long",
        )
        return materialize(hits.select(*columns).unionByName(mark), "hits")

    def _phrase_entries(self, asked: DataFrame) -> DataFrame:
        """Rows of phrases of several words.

        Rows of the rarest word come first; the other words are met on (token, row) only.
        """
        counts = self.counts(asked.select("token").distinct())
        known = materialize(asked.join(counts, "token"), "index-words")
        # A phrase with a word that no row holds is nowhere.
        per = known.groupBy("phrase", "size").agg(
            F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "no")).alias("rare")
        ).filter(F.col("have") == F.col("size"))
        known = known.join(per.select("phrase", F.col("rare.no").alias("rare")), "phrase")
        first = materialize(
            known.filter(F.col("no") == F.col("rare"))
            .join(self.entries(known.filter(F.col("no") == F.col("rare")).select("token").distinct()), "token")
            .select("phrase", "obs_id", "entity_id", "row_tokens",
                    F.transform("at", lambda a: a - F.col("no")).alias("starts")),
            "index-first",
        )
        others = (
            known.filter(F.col("no") != F.col("rare")).select("phrase", "no", "token")
            .join(first.select("phrase", "obs_id"), "phrase")
            .join(
                self.entries(known.filter(F.col("no") != F.col("rare")).select("token").distinct())
                .select("token", "obs_id", "at"), ["token", "obs_id"],
            )
            .select("phrase", "obs_id", F.transform("at", lambda a: a - F.col("no")).alias("starts"))
        )
        # A start that each of the words allows, word for word, is an occurrence.
        starts = (
            first.select("phrase", "obs_id", F.explode("starts").alias("start"))
            .unionByName(others.select("phrase", "obs_id", F.explode("starts").alias("start")))
            .groupBy("phrase", "obs_id", "start").agg(F.count(F.lit(1)).alias("words"))
        )
        whole = starts.join(per.select("phrase", "size"), "phrase").filter("words = size")
        return (
            whole.groupBy("phrase", "obs_id").agg(F.count(F.lit(1)).alias("tf"))
            .join(first.drop("starts"), ["phrase", "obs_id"])
            .select("phrase", "obs_id", "entity_id", "row_tokens", "tf")
        )

    def weights(self, terms: DataFrame, mem: Memory, as_of) -> DataFrame:
        """(phrase, obs_id, weight) of all visible rows with the phrases of ``terms``."""
        live = materialize(live_observations(mem, as_of).select(F.col("id").alias("obs_id")), "live")
        search = _Search(self, terms, live)
        return search.weights(search.blocks).unionByName(search.phrase_weights(mem, as_of))

    # Top-k

    def best_rows(self, terms: DataFrame, mem: Memory, as_of, most: int) -> DataFrame:
        """The rows with the highest sum of term weights: (key, obs_id, position).

        ``terms`` is (key, phrase, times, keep); ``most`` bounds ``keep``.  Equal to
        ``textindex.best_rows`` over all weights.  The first blocks of each word give a
        score that ``keep`` rows reach; from then on only blocks are opened that can lift
        a row above it with the best of all other words of its key: a few for a key of one
        word however common, more for keys of several words of like weight.  Words that
        bring no rows are read once per batch, for rows still in.
        """
        asked = materialize(terms, "index-terms")
        live = materialize(live_observations(mem, as_of).select(F.col("id").alias("obs_id")), "live")
        search = _Search(self, asked, live)
        heads = search.weights(search.head_blocks(most))
        several = materialize(search.phrase_weights(mem, as_of), "index-phrases")
        split = bringing_terms(
            asked.withColumn("grp", F.lit(0)), _grouped(heads.unionByName(several)),
            _grouped(search.peaks(several), "peak"), most, _SLACK,
        )
        opened = search.weights(search.needed_blocks(split)).unionByName(several)
        common = split.filter(~F.col("brings_rows")).select("phrase").distinct()

        def of_rows(rows: DataFrame) -> DataFrame:
            """Weights of common words in the given rows."""
            single = search.weights(search.blocks.join(common.withColumnRenamed("phrase", "token"), "token", "left_semi"), rows)
            return _grouped(single.unionByName(several))

        return score_of_rank(add_common(split, _grouped(opened), of_rows, most, _SLACK), most)


def _grouped(weights: DataFrame, value: str = "weight") -> DataFrame:
    return weights.select(F.lit(0).alias("grp"), "phrase", *(["obs_id"] if value == "weight" else []), value)


def _totals(rows: DataFrame, sign: int) -> DataFrame:
    return rows.agg(
        (sign * F.count(F.lit(1))).cast("long").alias("n_rows"),
        (sign * F.coalesce(F.sum("row_tokens"), F.lit(0))).cast("long").alias("all_tokens"),
    )


class _Search:
    """Weights of single words in blocks, under the statistics of the moment."""

    def __init__(self, index: TextIndex, terms: DataFrame, live: DataFrame):
        self.index, self.live = index, live
        single = ~F.contains(F.col("phrase"), F.lit(" "))
        self.phrases = terms.filter(~single).select("phrase").distinct()
        tokens_ = terms.filter(single).select(F.col("phrase").alias("token")).distinct()
        n_rows, all_tokens = index.totals()
        self.mean = all_tokens / n_rows if all_tokens else 1.0
        idf = F.greatest(
            F.lit(IDF_FLOOR), F.log((F.lit(n_rows) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        )
        counted = materialize(index.counts(tokens_).select("token", idf.alias("idf")), "index-idf")
        # Rows gain at most as much as the mean length has grown, and lose if it fell.
        grown = F.greatest(F.lit(1.0), F.lit(self.mean) / F.col("mean"))
        self.blocks = index.blocks(tokens_).join(counted, "token").withColumn(
            "bound", F.col("idf") * F.col("peak") * grown
        )

    def head_blocks(self, most: int) -> DataFrame:
        """The first blocks of each word: twice the rows that a key keeps, at least one block."""
        nth = F.row_number().over(
            Window.partitionBy("token").orderBy(F.desc("bound"), "batch", F.desc("n"))
        )
        return self.blocks.withColumn("nth", nth).filter(F.col("nth") <= 1 + 2 * most // BLOCK_ROWS)

    def needed_blocks(self, split: DataFrame) -> DataFrame:
        """Blocks that may hold a row above the floor of some key."""
        floors = split.filter("brings_rows").groupBy("phrase").agg(
            F.min(F.col("floor") / F.col("times")).alias("least")
        )
        return self.blocks.join(
            floors.withColumnRenamed("phrase", "token"), "token"
        ).filter(F.col("bound") >= F.col("least") - _SLACK).drop("least")

    def weights(self, blocks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """(phrase, obs_id, weight) of the visible rows in some blocks."""
        entries = blocks.select(F.col("token").alias("phrase"), "idf", F.inline("entries"))
        return entries.join(self.live if rows is None else rows, "obs_id", "left_semi").select(
            "phrase", "obs_id",
            (F.col("idf") * _saturation(F.size("at"), F.col("row_tokens"), self.mean)).alias("weight"),
        )

    def peaks(self, several: DataFrame) -> DataFrame:
        """(phrase, peak): no row has a higher weight."""
        own = self.blocks.groupBy("token").agg(F.max("bound").alias("peak"))
        return own.withColumnRenamed("token", "phrase").unionByName(
            several.groupBy("phrase").agg(F.max("weight").alias("peak"))
        )

    def phrase_weights(self, mem: Memory, as_of) -> DataFrame:
        return text_weights(self.index.hits(self.phrases, mem, as_of)).select("phrase", "obs_id", "weight")
