"""SpotSigs fingerprints and their likeness, with DataFrame functions only.

Every common word (an anchor) starts a spot: the anchor and the next two content
words, common words between them left out.  The set of hashed spots is the
fingerprint.  A text without a spot takes all runs of three words, a shorter one its
whole words or, without words, itself, so no set is empty and equal texts have equal
sets.  A document is compared with its edited text and with its neighbour by doc_id
only.  ``length_partition`` tells which sets could reach a Jaccard similarity by their
length, but nothing is joined by it: a search for near copies among all documents is
left out, so near copies elsewhere are not compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factfade.session import materialize

# Common words of English, French, Spanish and German.
ANCHORS = (
    "the of and to in a is that for it was on are be with as at by this from or an "
    "de la le et les des en un une que qui dans est pour du au par sur se "
    "el los las y del por con su al lo es para "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für"
).split()

BUCKET_DOCUMENTS = 500
MOST_BUCKETS = 8192

# Patterns loop over single characters only: a long run of common words must neither
# deepen the matcher's stack nor be read once for each of its words.
_ANCHOR, _CONTENT = "\x01", "\x02"
_MARK_ANCHORS = f"(?<= )({'|'.join(sorted(set(ANCHORS), key=lambda w: (-len(w), w)))})(?= )"
_MARK_CONTENT = f"(?<= )([^ {_ANCHOR}][^ ]*)"
_RUN = "(?<= )(?=([^ ]+ [^ ]+ [^ ]+) )"


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits, one space before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def with_spots(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted set of hashed spots of column ``text`` (not NULL).

    The words are cut into chunks, each a run of anchors and the content words up to
    the next anchor.  All anchors of a chunk share the same two content words: the
    first two of the chunk, or its only one and the first of the next chunk.
    """
    words, chunks, firsts, follows, found = (
        f"_{name}_{x}" for x in ("words", "chunks", "firsts", "follows", "found")
    )
    df = df.withColumn(words, words_of(F.col(text)))
    marked = F.regexp_replace(
        F.regexp_replace(F.col(words), _MARK_ANCHORS, f"{_ANCHOR}$1"), _MARK_CONTENT, f"$1{_CONTENT}"
    )
    df = df.withColumn(chunks, F.split(marked, f"(?<={_CONTENT} )(?={_ANCHOR})"))
    df = df.withColumn(
        firsts,
        F.transform(chunks, lambda c: F.regexp_extract(c, f"([^ {_ANCHOR}]+){_CONTENT}", 1)),
    )

    def following(chunk: Column, at: Column) -> Column:
        second = F.regexp_extract(chunk, f"{_CONTENT} ([^ ]+){_CONTENT}", 1)
        return F.concat_ws(
            " ", F.get(F.col(firsts), at),
            F.coalesce(F.nullif(second, F.lit("")), F.get(F.col(firsts), at + 1)),
        )

    df = df.withColumn(follows, F.transform(chunks, following))

    def of_chunk(chunk: Column, at: Column) -> Column:
        anchors = F.array_distinct(F.filter(F.split(chunk, " "), lambda w: F.startswith(w, F.lit(_ANCHOR))))
        follow = F.get(F.col(follows), at)
        return F.transform(anchors, lambda w: F.when(F.contains(follow, F.lit(" ")), F.xxhash64(w, follow)))

    # The last chunk may lack its second content word, or the next one has none.
    spots = F.filter(F.flatten(F.transform(chunks, of_chunk)), lambda h: h.isNotNull())
    df = df.withColumn(found, spots)
    runs = F.regexp_extract_all(F.col(words), F.lit(_RUN), F.lit(1))
    short = F.when(F.col(words) == " ", F.concat(F.lit("\x00"), F.col(text))).otherwise(F.col(words))
    spots = F.when(F.size(found) > 0, F.col(found)).otherwise(
        F.when(F.length(words) > 0, F.transform(runs, lambda s: F.xxhash64(s)))
    )
    spots = F.when(F.size(spots) > 0, spots).otherwise(F.array(F.xxhash64(short)))
    # 40 bits per spot keep the fingerprint short; ten hexadecimal digits each.
    kept = F.array_sort(F.array_distinct(F.transform(spots, lambda h: F.shiftrightunsigned(h, 24))))
    return df.withColumn(name, kept).drop(words, chunks, firsts, follows, found)


def fingerprint(spots: Column) -> Column:
    """The set as text: sorted spots, ten hexadecimal digits each."""
    return F.array_join(F.transform(spots, lambda h: F.lower(F.lpad(F.hex(h), 10, "0"))), "")


def length_partition(spots: Column, threshold: float) -> Column:
    """Number of the length range; sets two ranges apart are less alike than ``threshold``."""
    return F.floor(F.log(F.size(spots).cast("double")) / F.lit(-math.log(threshold))).cast("int")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 where their lengths rule out ``least``."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    exact = shared / (F.size(a) + F.size(b) - shared)
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    apart = (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((bound < least) | apart, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(exact)
    )


def _bucketed(docs: DataFrame) -> DataFrame:
    """Adds ``bucket``: ranges of doc_id with about the same number of documents."""
    n = docs.count()
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_DOCUMENTS))
    splits: list[int] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets))).first()[0]
        splits = sorted(set(found or []))
    if not splits:
        return docs.withColumn("bucket", F.lit(0))
    ranges = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")
    # Binary search: how many split points are not above the id.
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(splits) + 1)))))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_ = at["low"] < at["high"]
        up = F.get(ranges, middle) <= F.col("doc_id")
        return F.struct(
            F.when(open_ & up, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & ~up, middle).otherwise(at["high"]).alias("high"),
        )

    place = F.aggregate(steps, start, halve, lambda at: at["low"])
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Documents (doc_id, text) in descending order beside ``next_text``.

    After the last document comes the first.  Neighbours are found inside ranges of
    doc_id; the first document of each range is copied to the range above it, where
    ``own`` marks it as a copy.  The window given back has the same order.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = _bucketed(rows.select("doc_id", "text"))
    # One row per range: its largest id, and the range that needs it.
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    up = Window.orderBy("bucket")
    tops = materialize(
        tops.select(
            F.coalesce(F.lead("bucket").over(up), F.min("bucket").over(Window.partitionBy())).alias("to"),
            "top", F.col("bucket").alias("of"),
        ),
        "range-tops",
    )
    copies = placed.join(
        F.broadcast(tops), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))
    ).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(False).alias("own"))
    both = placed.select("doc_id", "text", "bucket", F.lit(True).alias("own")).unionByName(copies)
    both = both.withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy(
        F.desc("own"), F.desc_nulls_last("doc_id"), "tie"
    )
    return both.withColumn("next_text", F.lead("text").over(order)), order


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text) and of its edited text.

    The edited text has its last half replaced by the beginning of the next document in
    descending doc_id.  doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and length_partition (of 0.8).

    NULL text counts as empty.  Documents without doc_id come last; equal ids are
    ordered by a hash of the text, and repeated rows are documents of their own (each
    the next of the other).  A single document is its own next one.  An empty table
    gives no row; other columns are not read.
    """
    rows, order = with_next(docs)
    half = "floor(n / 2)"
    rows = rows.withColumn("n", F.char_length("text").cast("long")).withColumn(
        "edited",
        F.expr(f"concat(substring(text, 1, int(n - {half})), substring(next_text, 1, int({half})))"),
    )
    rows = with_spots(rows.drop("next_text"), "text", "spots").drop("text")
    rows = rows.withColumn("next_spots", F.lead("spots").over(order)).filter("own")
    rows = with_spots(rows, "edited", "edited_spots")
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"),
        length_partition(F.col("spots"), 0.8).alias("length_partition"),
    )
