"""Quality of documents from learned subword vectors.

Words and their character n-grams are hashed into a table of vectors; the vectors of
a document are averaged and a softmax layer gives the score.  Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows.  A word that repeats the one before it counts as a marker of its own.

Because the layer is linear in the average, a trained table is folded into one number
per bucket, and a word's share is computed once for all its places in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.llm.words import Words, code_points, mixed, rolling, word_hashes, word_slices

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 2500
VECTOR = 12
#: Documents that training looks at, in as many rounds over the sample as it takes.
STEPS = 10_000
RATE = 0.5
#: The step of the vectors against that of the layer: shares are small numbers.
_SCALE = 20.0
#: Characters that are scored together: a worker holds some dozens of bytes for each.
SCORED_CHARS = 1 << 18
_SAME = 0  # bucket of the marker; buckets of words and grams begin at 1


def word_features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of each word and each of its character n-grams."""
    room = np.uint64(buckets - 1)
    found = [(mixed(word_hashes(words)) % room).astype(np.int64) + 1]
    owner = [np.arange(len(words))]
    points, word = code_points(words)
    for n in GRAMS:
        if len(points) >= n:
            inside = word[n - 1 :] == word[: len(word) - n + 1]
            grams = rolling(points, n)[inside]
            found.append((grams % room).astype(np.int64) + 1)
            owner.append(word[: len(word) - n + 1][inside])
    return np.concatenate(found), np.concatenate(owner)


def _repeats(words: Words) -> np.ndarray:
    same = np.zeros(len(words.codes))
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return same


def document_features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of one text, at most one pair per bucket."""
    words = Words([text or ""])
    found, owner = word_features(words.vocabulary, buckets)
    times = np.bincount(words.codes, minlength=len(words.vocabulary))
    sums = np.bincount(found, weights=times[owner], minlength=1)
    sums[_SAME] += _repeats(words).sum()
    used = np.flatnonzero(sums)
    return used, sums[used]


def train(
    features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS,
    size: int = VECTOR, steps: int = STEPS, rate: float = RATE, seed: int = 1,
) -> tuple[np.ndarray, float]:
    """(number per bucket, bias): log-odds of label 1 are bias plus the mean number."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((buckets, size)) - 0.5) / size).astype(np.float32)
    layer = np.zeros((2, size), np.float32)
    bias = np.zeros(2, np.float32)
    done = 0
    while features and done < steps:
        for k in rng.permutation(len(features))[: steps - done]:
            found, count = features[k]
            now = rate * (1 - done / steps)
            done += 1
            if not len(found):
                continue
            share = (count / count.sum()).astype(np.float32)
            mean = share @ vectors[found]
            out = layer @ mean + bias
            out = np.exp(out - out.max())
            wrong = -out / out.sum()
            wrong[int(labels[k])] += 1
            back = wrong @ layer
            layer += now * np.outer(wrong, mean)
            bias += now * wrong * 0.1
            vectors[found] += now * _SCALE * np.outer(share, back)
    return (vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text; texts without words get that of the bias."""
    out = []
    for _, words in word_slices(texts, most=SCORED_CHARS):
        found, owner = word_features(words.vocabulary, len(table))
        n = len(words.vocabulary)
        value = np.bincount(owner, weights=table[found], minlength=n)
        number = np.bincount(owner, minlength=n)
        same = _repeats(words)
        total = words.total(value[words.codes] + same * table[_SAME])
        count = words.total(number[words.codes] + same)
        out.append(bias + total / np.maximum(count, 1))
    odds = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int
) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents, chosen by a hash.

    Labels other than 0 and 1 are left out; of several for one document the highest
    counts.  The chosen labels are bounded by ``rows`` and so may be broadcast.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


class QualityModel:
    """A trained table that scores a column of texts."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    @classmethod
    def fit(
        cls, docs: DataFrame, labels: DataFrame, label: str = "quality",
        learn: Column | None = None, rows: int = SAMPLE_ROWS, buckets: int = BUCKETS,
    ) -> "QualityModel":
        """Learn from at most ``rows`` labelled documents (of those where ``learn``).

        Tasks turn texts into at most ``buckets`` pairs each; only these pairs of the
        bounded sample reach the driver.  Without labels every score is 0.5.
        """
        sample = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, rows)

        def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [document_features(t, buckets) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("label"),
                        pa.array([f.astype("<i4").tobytes() for f, _ in pairs], pa.binary()),
                        pa.array([c.astype("<f4").tobytes() for _, c in pairs], pa.binary()),
                    ],
                    ["doc_id", "label", "found", "counts"],
                )

        got = sample.mapInArrow(featurize, "doc_id long, label int, found binary, counts binary")
        found = sorted(got.toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["found"])))
        features = [
            (np.frombuffer(r["found"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in found
        ]
        return cls(*train(features, np.array([r["label"] for r in found]), buckets))

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with the score of ``text`` in a further column."""
        table, bias = self.table, self.bias

        @F.pandas_udf("double")
        def scored(texts):
            import pandas as pd

            return pd.Series(score_texts([t if isinstance(t, str) else None for t in texts], table, bias))

        return docs.withColumn(name, scored(F.col("text").cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, least: float = 0.3,
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (doc_id, text).

    Labels are learned only from ids outside the held-out fold (crc32 of the id modulo
    ``folds`` is not ``held``).  NULL and empty texts get the score of the bias, rows
    without doc_id and repeated rows are scored like any other, an empty table gives
    no row.  ``labels``, lang, source and doc_id are no input of a score.
    """
    model = QualityModel.fit(
        docs, labels, learn=remainder(F.col("doc_id"), folds) != held, rows=rows
    )
    scored = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
