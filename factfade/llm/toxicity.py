"""Toxicity of documents: boosted trees over a few dense features, then calibrated.

Features are rates per text: words of a lexicon, their closeness to the second
person, capitals, punctuation and spellings that hide a word.  The lexicon is a short
fixed list and words and word beginnings learned from a bounded labelled sample.  The
sample is cut into folds: a row is measured with the lexicon of the other folds, and
the isotonic calibration learns from log-odds of trees grown on the other folds, so
every row serves all three steps and none is judged by what it taught.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfade.llm.quality import labelled_sample, remainder
from factfade.llm.words import Words, word_slices
from factfade.session import materialize

# Words that insult, in English, French, Spanish and German.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless "
    "disgusting clown ugly fool freak filth vermin bastard jerk shut hate "
    "imbécile crétin débile ordure minable abruti raclure "
    "idiota imbécil estúpido basura escoria inútil patético payaso "
    "idioten dumm dummkopf abschaum müll erbärmlich wertlos widerlich trottel".split()
)
# Second person in the same languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros du dich dir dein deine ihr euch euer".split()
)
# Signs that stand for letters, and those that stand for either of two.
_LETTER_FOR = str.maketrans("03457@$+", "oeastast")
_EITHER = {"1": "li", "!": "il", "|": "il"}
_MOST_READ = 4

SAMPLE_ROWS = 9000
LEXICON_ENTRIES = 1500
FOLDS = 5
_LEAST_DOCUMENTS = 4
_LEAST_ODDS = 3
NEAR = 5
_PREFIXES = (4, 5, 6)
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_SIGN_INSIDE = re.compile(r"[^\W\d_][\d@$!|+*]+[^\W\d_]|[\d@$!|+]+[^\W\d_]{2}")
_LONG_RUN = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """Lower case, without signs around it."""
    return _STRIP.sub("", word.lower())


def readings(word: str) -> list[str]:
    """``word`` with each sign of two meanings as either letter, the usual ones first.

    Words with more than ``_MOST_READ`` such signs are read with all usual or all other
    letters.
    """
    places = [k for k, sign in enumerate(word) if sign in _EITHER]
    ways = [(0,) * len(places), (1,) * len(places)]
    if len(places) <= _MOST_READ:
        ways = list(product((0, 1), repeat=len(places)))
    found = []
    for way in ways if places else ways[:1]:
        signs = list(word)
        for k, which in zip(places, way, strict=True):
            signs[k] = _EITHER[word[k]][which]
        found.append("".join(signs))
    return found


def spelled(word: str, lexicon: Container[str] = ()) -> str:
    """A hidden spelling undone: signs for letters, stars and long runs taken away.

    Of several readings one that the lists know is taken, else the usual one.
    """
    low = word.lower().rstrip(".,;:!?").translate(_LETTER_FOR)
    found = [
        _LONG_RUN.sub(r"\1", _STRIP.sub("", re.sub(r"[^\w]|_", "", way))) for way in readings(low)
    ]
    return next((w for w in found if w in INSULTS or w in lexicon), found[0])


def keys_of(word: str) -> list[str]:
    """What the lexicon may know of a plain word: itself, and beginnings marked by ``-``."""
    return [word] + [word[:n] + "-" for n in _PREFIXES if len(word) > n]


FEATURES = (
    "lexicon rate", "lexicon words", "learned rate", "learned words", "learned mean",
    "strongest", "near second person", "second person", "hidden spelling",
    "hidden lexicon words", "capitals", "signs", "exclamations", "word length", "words",
)


def features(texts: list[str | None], lexicon: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    rows = []
    for _, words in word_slices(texts):
        rows.append(_slice_features(words, lexicon))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _slice_features(words: Words, lexicon: dict[str, float]) -> np.ndarray:
    facts = np.zeros((len(words.vocabulary), 9))
    for k, word in enumerate(words.vocabulary):
        bare = plain(word)
        row = facts[k]
        hidden = bool(_SIGN_INSIDE.search(word)) or bool(_LONG_RUN.search(bare))
        shown = spelled(word, lexicon) if hidden else bare
        row[0] = shown in INSULTS
        row[1] = max([lexicon.get(key, 0.0) for key in keys_of(shown)]) if shown else 0.0
        row[2] = bare in SECOND_PERSON
        row[3] = hidden
        row[4] = hidden and (row[0] > 0 or row[1] > 0)
        row[5] = len(word) > 1 and word.isupper()
        row[6] = len(word) - len(bare)
        row[7] = word.count("!")
        row[8] = len(word)
    each = facts[words.codes]
    n = np.maximum(words.counts, 1)
    learned = each[:, 1] > 0
    hit = (each[:, 0] > 0) | learned
    second = np.flatnonzero(each[:, 2] > 0)
    close = np.zeros(len(each))
    spots = np.flatnonzero(hit)
    if len(spots) and len(second):
        after = np.searchsorted(second, spots)
        for side in (np.maximum(after - 1, 0), np.minimum(after, len(second) - 1)):
            there = second[side]
            near = (np.abs(there - spots) <= NEAR) & (words.doc[there] == words.doc[spots])
            close[spots] = np.maximum(close[spots], near)
    strongest = np.zeros(len(words.counts))
    np.maximum.at(strongest, words.doc, each[:, 1])
    total = words.total
    in_lexicon, in_learned = total(each[:, 0]), total(learned.astype(float))
    return np.stack(
        [
            in_lexicon / n, in_lexicon, in_learned / n, in_learned, total(each[:, 1]) / n, strongest,
            total(close), total(each[:, 2]) / n, total(each[:, 3]) / n, total(each[:, 4]),
            total(each[:, 5]) / n, total(each[:, 6]) / n, total(each[:, 7]) / n, total(each[:, 8]) / n,
            np.log1p(words.counts),
        ],
        axis=1,
    )


class Trees:
    """Gradient-boosted trees for a 0/1 label, on feature histograms."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1
        ) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        if not len(x):
            self.edges = [np.zeros(0)] * x.shape[1]
            return self
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Quantiles of the values that are not the lowest: most rates are mostly zero.
        self.edges = [
            np.unique(np.append(np.quantile(c[c > c.min()], steps) if (c > c.min()).any() else [], c.min()))
            for c in x.T
        ]
        place = self._binned(x)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        odds = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            tree, leaf = self._grow(place, y - p, p * (1 - p))
            self.trees.append(tree)
            odds += leaf
        return self

    def _grow(self, place: np.ndarray, gradient: np.ndarray, weight: np.ndarray):
        """A tree as splits by level, (feature, bin) per node, and the value of each row."""
        node = np.zeros(len(place), np.int64)
        levels = []
        for level in range(self.depth):
            splits = []
            for k in range(1 << level):
                rows = node == k
                best, chosen = 1e-6, (0, 1 << 30)
                if rows.sum() >= 2:
                    g, h = gradient[rows], weight[rows]
                    whole = g.sum() ** 2 / (h.sum() + 1)
                    for f in range(place.shape[1]):
                        size = len(self.edges[f]) + 1
                        left_g = np.cumsum(np.bincount(place[rows, f], g, size))[:-1]
                        left_h = np.cumsum(np.bincount(place[rows, f], h, size))[:-1]
                        if not len(left_g):
                            continue
                        gain = (
                            left_g**2 / (left_h + 1)
                            + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
                        )
                        at = int(np.argmax(gain))
                        if gain[at] > best:
                            best, chosen = gain[at], (f, at)
                splits.append(chosen)
            levels.append(splits)
            node = self._down(place, node, splits)
        leaves = np.array([
            self.rate * gradient[node == k].sum() / (weight[node == k].sum() + 1)
            for k in range(1 << self.depth)
        ])
        return (levels, leaves), leaves[node]

    @staticmethod
    def _down(place: np.ndarray, node: np.ndarray, splits: list[tuple]) -> np.ndarray:
        feature = np.array([s[0] for s in splits])[node]
        at = np.array([s[1] for s in splits])[node]
        return 2 * node + (place[np.arange(len(place)), feature] > at)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        place = self._binned(x)
        out = np.full(len(x), self.base)
        for levels, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in levels:
                node = self._down(place, node, splits)
            out += leaves[node]
        return out


class Isotonic:
    """Non-decreasing steps from log-odds to a probability, by pooling violators."""

    def __init__(self):
        self.at, self.value = np.zeros(0), np.zeros(0)

    def fit(self, odds: np.ndarray, y: np.ndarray) -> "Isotonic":
        levels, where = np.unique(odds, return_inverse=True)
        pools: list[list[float]] = []  # mean, weight, first level
        for level, good, all_ in zip(
            levels, np.bincount(where, y, len(levels)), np.bincount(where, minlength=len(levels)),
            strict=True,
        ):
            pools.append([good / all_, all_, level])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                mean, weight, _ = pools.pop()
                last = pools[-1]
                last[0] = (last[0] * last[1] + mean * weight) / (last[1] + weight)
                last[1] += weight
        # One row of either label is added to each pool, so no score is quite 0 or 1.
        self.at = np.array([p[2] for p in pools])
        self.value = np.array([(p[0] * p[1] + 0.5 * 0.02) / (p[1] + 0.02) for p in pools])
        return self

    def __call__(self, odds: np.ndarray) -> np.ndarray:
        plain_score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if not len(self.at):
            return plain_score
        step = self.value[np.maximum(np.searchsorted(self.at, odds, side="right") - 1, 0)]
        return np.clip(0.98 * step + 0.02 * plain_score, 0, 1)  # ranks inside a pool stay


class Lexica:
    """Counts of words and beginnings of words in a labelled sample, by fold.

    ``sample`` has text, label and part (a fold from 0).  Documents of label 1 and 0 are
    counted per key once for all lexica.
    """

    def __init__(self, sample: DataFrame, folds: int = FOLDS):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                labels, parts = (batch.column(c).to_pylist() for c in ("label", "part"))
                for text, label, part in zip(
                    batch.column("text").to_pylist(), labels, parts, strict=True
                ):
                    words = {plain(w) for w in (text or "").split()}
                    found = sorted({k for w in words if w for k in keys_of(w)})
                    n = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found, pa.string()), pa.array([label] * n, pa.int32()),
                            pa.array([part] * n, pa.int32()),
                        ],
                        ["key", "label", "part"],
                    )

        sizes = sample.groupBy("part", "label").count().collect()
        self.sizes = {(r["part"], r["label"]): r["count"] for r in sizes}
        good = [
            F.sum(F.when(F.col("part") == k, F.col("label")).otherwise(0)).alias(f"a{k}")
            for k in range(folds)
        ]
        bad = [
            F.sum(F.when(F.col("part") == k, 1 - F.col("label")).otherwise(0)).alias(f"b{k}")
            for k in range(folds)
        ]
        counted = (
            sample.select("text", "label", "part")
            .mapInArrow(keys, "key string, label int, part int")
            .groupBy("key").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"), *good, *bad)
            .filter(F.col("a") >= _LEAST_DOCUMENTS)
        )
        self.counts = materialize(counted, "lexicon-counts")

    def learn(self, without: int | None = None, entries: int = LEXICON_ENTRIES) -> dict[str, float]:
        """Keys that mark label 1 in all folds but ``without``, with their log-odds.

        At most ``entries`` strongest keys come to the driver.
        """
        n0, n1 = (
            sum(n for (part, label), n in self.sizes.items() if label == which and part != without)
            for which in (0, 1)
        )
        if not n0 or not n1:
            return {}
        left = F.lit(0) if without is None else F.col(f"a{without}")
        a = F.col("a") - left
        b = F.col("b") - (F.lit(0) if without is None else F.col(f"b{without}"))
        odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
        found = (
            self.counts.select("key", a.alias("times"), odds.alias("odds"))
            .filter((F.col("times") >= _LEAST_DOCUMENTS) & (F.col("odds") >= _LEAST_ODDS))
            .orderBy(F.desc(F.col("times") * F.col("odds")), "key").limit(entries)
        )
        return {r["key"]: float(r["odds"]) for r in found.collect()}


class ToxicityModel:
    """Lexicon, trees and calibration, learned together."""

    def __init__(self, lexicon: dict[str, float], trees: Trees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    @classmethod
    def fit(
        cls, docs: DataFrame, labels: DataFrame, label: str = "toxic",
        learn: Column | None = None, rows: int = SAMPLE_ROWS,
    ) -> "ToxicityModel":
        """Learn from at most ``rows`` labelled documents in ``FOLDS`` folds.

        The lexicon and the trees that score are learned from all of them.  Without
        labels the fixed list alone counts.
        """
        learn = F.lit(True) if learn is None else learn
        part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int")
        sample = materialize(
            labelled_sample(docs, labels, label, learn, rows).withColumn("part", part), "labelled"
        )
        lexica = Lexica(sample)
        others = [lexica.learn(without=k) for k in range(FOLDS)]
        width = len(FEATURES)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = np.array(batch.column("part").to_pylist(), int)
                texts = batch.column("text").to_pylist()
                found = np.zeros((len(texts), width))
                for k in np.unique(parts):
                    mine = np.flatnonzero(parts == k)
                    found[mine] = features([texts[i] for i in mine], others[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("label"), batch.column("part"),
                        pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), width).cast(pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "part", "features"],
                )

        measured = sample.select("doc_id", "label", "part", "text").mapInArrow(
            measure, "doc_id long, label int, part int, features array<double>"
        )
        found = sorted(measured.collect())  # bounded: ``rows`` rows of a few numbers
        x = np.array([r["features"] for r in found], float).reshape(-1, width)
        y = np.array([r["label"] for r in found], float)
        fold = np.array([r["part"] for r in found], int)
        trees = Trees().fit(x, y)
        if not len(found):
            trees.base = -3.0
        odds = np.zeros(len(found))
        for k in np.unique(fold):
            odds[fold == k] = Trees().fit(x[fold != k], y[fold != k]).log_odds(x[fold == k])
        calibration = Isotonic().fit(odds, y) if len(np.unique(fold)) > 1 else Isotonic()
        return cls(lexica.learn(), trees, calibration)

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration(self.trees.log_odds(features(texts, self.lexicon)))

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def scored(texts):
            import pandas as pd

            return pd.Series(model.score_texts([t if isinstance(t, str) else None for t in texts]))

        return docs.withColumn(name, scored(F.col("text").cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.3,
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document (doc_id, text).

    Labels are learned only from ids outside the held-out fold (crc32 of the id modulo
    ``folds`` is not ``held``); labels, lang, source and doc_id are no input of a score.
    NULL and empty texts are scored by their features, all zero.  Rows without doc_id
    and repeated rows are scored like any other; an empty table gives no row.
    """
    model = ToxicityModel.fit(
        docs, labels, learn=remainder(F.col("doc_id"), folds) != held, rows=rows
    )
    scored = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
