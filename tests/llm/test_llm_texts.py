"""Fingerprints of spots, license scans and the two classifiers."""

import hashlib
import re

import edges
import numpy as np
import pytest
from pyspark.sql import functions as F

from factfade.llm import licenses, quality, spotsigs, toxicity
from factfade.llm.words import Words

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"  # 37 toxic texts of four languages to learn from
ANCHORS = set(spotsigs.ANCHORS)


def spots(text):
    """Chains by plain loops; what stands for a text without chains as documented."""
    words = "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()
    chains, content = set(), []
    for word in reversed(words):
        if word not in ANCHORS:
            content.append(word)
        elif len(content) > 1:
            chains.add((word, content[-1], content[-2]))
    if not chains:
        chains = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    if not chains:
        chains = {tuple(words)} if words else {text}
    return chains


def likeness(a, b):
    a, b = spots(a), spots(b)
    return len(a & b) / len(a | b)


def test_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_DOCUMENTS", 5)  # several ranges of ids
    texts = {k: f"The cat number {k % 7} of house {k} and a dog on the mat {k % 3} was big." for k in range(30)}
    texts |= {31: None, 32: "", 33: "one two", 34: "!!!", 35: "x y z v w", 36: "ÀÉ straße 中文 the the the b c"}
    texts |= {37: "the of " * 8000 + "one more", 38: "a word and the of last", 39: "Of " * 30_000, 40: "cat " * 50}
    df = spark.createDataFrame([(k * 3, t) for k, t in texts.items()], "doc_id long, text string")
    df = df.repartition(4).withColumn("n", F.lit("x")).withColumn("bucket", F.lit("x")).withColumn("own", F.lit("x"))
    rows = {r["doc_id"]: r for r in spotsigs.compare_edits(df).collect()}
    order = sorted(rows, reverse=True)
    assert len(order) == len(texts)
    for k, doc_id in enumerate(order):
        text, after = texts[doc_id // 3] or "", texts[order[(k + 1) % len(order)] // 3] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = rows[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(likeness(text, edited))
        assert row["near_next"] == pytest.approx(likeness(text, after))
        assert len(row["fingerprint"]) == 10 * len(spots(text))


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spotsigs.compare_edits(edges.documents(spark)).collect()
    source = edges.rows()
    assert len(rows) == len(source)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_id[1] == by_id[6] and by_id[5] == by_id[10] and by_id[2] == by_id[3]
    assert spotsigs.compare_edits(edges.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "the a b")], "doc_id long, text string")
    assert [r["near_next"] for r in spotsigs.compare_edits(one).collect()] == [1.0]


def test_pruning_leaves_no_similar_pair_out(spark):
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2], [1, 2, 3, 4]), ([1], [9])], "a array<long>, b array<long>")
    got = df.select(spotsigs.jaccard(a, b, 0.8).alias("p"), spotsigs.jaccard(a, b).alias("j")).collect()
    assert [(r["p"], r["j"]) for r in got] == [(0.8, 0.8), (0.0, 0.5), (0.0, 0.0)]
    parts = df.select(spotsigs.length_partition(a, 0.8).alias("x"), spotsigs.length_partition(b, 0.8).alias("y")).first()
    assert abs(parts["x"] - parts["y"]) <= 1


def test_license_windows_against_brute_force():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):
        words = rng.choice(vocabulary, int(rng.integers(0, 300))).tolist()
        for name in rng.choice(list(licenses.TEMPLATES), 2, replace=False):
            own = licenses.TEMPLATES[name].split()
            if k % 3 == 0 and len(own) > 20:  # a word changed: five shingles go
                own[int(rng.integers(len(own)))] = "changed"
            if k % 4 == 1:
                own = own[: len(own) // 2]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = own
        texts.append(" ".join(words).lower())
    index, words = licenses.TemplateIndex(licenses.TEMPLATES), Words(texts)
    found = licenses.Shingles(words)
    expected = set()
    for members, stride, reach, _, _ in index.classes:
        for low, high, doc in zip(*licenses._windows(found.doc, stride, reach), strict=True):
            assert set(found.doc[low:high]) == {doc}
            for t in members:
                share = len(np.intersect1d(found.hash[low:high], index.sets[t])) / len(index.sets[t])
                if share >= 0.8:
                    expected.add((int(doc), t, round(share, 9)))
    got = {(d, t, round(s, 9)) for d, t, _, _, s in index.matches(words)}
    assert got == expected and len(got) > 100
    # Any place of a whole template lies in some window.
    for shift in range(40):
        text = " ".join([f"x{i}" for i in range(shift)] + [licenses.TEMPLATES["GPL"].lower(), "y z"])
        assert any(index.names[m[1]] == "GPL" and m[4] == 1.0 for m in index.matches(Words([text])))


def test_license_scan(spark):
    rows = licenses.scan(edges.documents(spark)).collect()
    assert [(r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in rows] == [(12, "Apache-2.0 notice", 0, 6)]
    assert licenses.scan(edges.empty(spark)).count() == 0


@pytest.mark.parametrize("operator, label, folds, held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, operator, label, folds, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = operator.classify(docs, labels).join(labels, "doc_id").collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in found)
    out = [r for r in found if r["held_out"]]
    assert len(out) > 50 and {r[label] for r in out} == {0, 1}
    assert sum(r["predicted"] == r[label] for r in out) >= 0.97 * len(out)


@pytest.mark.parametrize(
    "operator, label, folder, auc, recall",
    [
        (quality, "quality", SF, 0.99, 0.95), (quality, "quality", SMALL, 0.99, 0.95),
        (toxicity, "toxic", SF, 0.98, 0.9),
        # What so few examples allow, as measured, not what is wanted.
        (toxicity, "toxic", SMALL, 0.85, 0.6),
    ],
)
def test_held_out_positives(spark, operator, label, folder, auc, recall):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = operator.classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    scores, y = np.array([r["score"] for r in found]), np.array([r[label] for r in found])
    above = scores[y == 1][:, None] - scores[y == 0]
    assert (above > 0).mean() + 0.5 * (above == 0).mean() >= auc
    assert np.mean([r["predicted"] for r in found if r[label] == 1]) >= recall
    assert np.mean([r["predicted"] for r in found if r[label] == 0]) <= 0.03


def plain_features(text, lexicon):
    """The features by loops over one text, from their names."""
    words = (text or "").split()
    n = max(len(words), 1)
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    hits, seconds = [], []
    for at, word in enumerate(words):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
        hidden = bool(toxicity._SIGN_INSIDE.search(word) or toxicity._LONG_RUN.search(bare))
        shown = toxicity.spelled(word, lexicon) if hidden else bare
        known = shown in toxicity.INSULTS
        weight = max([lexicon.get(k, 0.0) for k in toxicity.keys_of(shown)], default=0.0) if shown else 0.0
        out["lexicon rate"] += known / n
        out["lexicon words"] += known
        out["learned rate"] += (weight > 0) / n
        out["learned words"] += weight > 0
        out["learned mean"] += weight / n
        out["strongest"] = max(out["strongest"], weight)
        out["second person"] += (bare in toxicity.SECOND_PERSON) / n
        out["hidden spelling"] += hidden / n
        out["hidden lexicon words"] += hidden and (known or weight > 0)
        out["capitals"] += (len(word) > 1 and word.isupper()) / n
        out["signs"] += (len(word) - len(bare)) / n
        out["exclamations"] += word.count("!") / n
        out["word length"] += len(word) / n
        if known or weight > 0:
            hits.append(at)
        if bare in toxicity.SECOND_PERSON:
            seconds.append(at)
    out["near second person"] = sum(any(abs(a - b) <= toxicity.NEAR for b in seconds) for a in hits)
    out["words"] = np.log1p(len(words))
    return [out[name] for name in toxicity.FEATURES]


def test_features_against_loops(spark):
    lexicon = {"blork": 4.0, "grumb-": 3.5, "idiot": 3.2}
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(300).collect()]
    texts += [None, "", "  ", "you 1d10t!", "You are BLORK, grumbling you", "!!! ... 1", "shut up you l*o*s*e*r " * 50]
    got = toxicity.features(texts, lexicon)
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts])


def test_log_odds_follow_the_trees():
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    trees = toxicity.Trees(rounds=9).fit(x, (x[:, 1] > 0.4).astype(float))

    def walk(row):
        total = trees.base
        for levels, leaves in trees.trees:
            node = 0
            for splits in levels:
                feature, at = splits[node]
                node = 2 * node + (sum(e < row[feature] for e in trees.edges[feature]) > at)
            total += leaves[node]
        return total

    assert np.allclose(trees.log_odds(x), [walk(row) for row in x])


def test_quality_scores_against_loops():
    rng = np.random.default_rng(4)
    table, bias = rng.normal(size=1 << 10), 0.3
    texts = ["one two two three", "", None, "été été x", "a" * 50, "the cat sat on the mat " * 40]

    def plainly(text):
        found, counts = quality.document_features(text, 1 << 10)
        return 1 / (1 + np.exp(-(bias + (table[found] * counts).sum() / max(counts.sum(), 1))))

    assert np.allclose(quality.score_texts(texts, table, bias), [plainly(t) for t in texts])


def fold_rows(spark):
    texts = [("blork day", 1), ("day blork", 1), ("fine day", 0), ("good day", 0), (None, 0)] * 10
    rows = [(k, t, label, k // 5 % 5) for k, (t, label) in enumerate(texts)]
    return spark.createDataFrame(rows + [(99, "zzz zzz", 1, 4)] * 12, "doc_id long, text string, label int, part int")


def test_a_lexicon_leaves_its_fold_out(spark):
    rows = fold_rows(spark)
    lexica = toxicity.Lexica(rows)
    assert set(lexica.learn()) == {"blork", "blor-", "zzz"}
    assert set(lexica.learn(without=4)) == {"blork", "blor-"}
    for k in (0, 4):
        alone = toxicity.Lexica(rows.filter(F.col("part") != k)).learn()
        assert lexica.learn(without=k) == pytest.approx(alone)
    assert toxicity.Lexica(rows.filter("label = 0")).learn() == {}


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows_are_scored(spark, operator, label):
    docs = edges.documents(spark)
    schema = f"doc_id long, {label} int, text string, score string"
    some = [(1, 1, "x", "y"), (1, 0, "x", "y"), (5, 0, None, None), (None, 1, None, None), (7, None, None, None), (8, 1, None, None), (9, 2, None, None), (12, 0, None, None), (11, 1, None, None)]
    for labels in (some, [], [(1, 1, None, None)]):
        found = operator.classify(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(found) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
        empty = {r["score"] for r in found if r["doc_id"] in (2, 3, 4)}
        assert len(empty) == 1
    assert operator.classify(edges.empty(spark), spark.createDataFrame(some, schema)).count() == 0


def test_hidden_spellings_are_read():
    assert [toxicity.spelled(w) for w in ("1d10t!", "$tup1d", "mooooron", "l*o*s*e*r")] == ["idiot", "stupid", "moron", "loser"]


def test_calibration_never_falls():
    rng = np.random.default_rng(1)
    odds = rng.normal(size=500)
    fitted = toxicity.Isotonic().fit(odds, (rng.random(500) < 1 / (1 + np.exp(-2 * odds))).astype(float))
    got = fitted(np.sort(rng.normal(size=300)))
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1


def test_trees_learn_a_rule_of_two_features():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((trees.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_words_are_counted_per_text():
    words = Words(["a b a", "", "b"])
    assert words.vocabulary == ["a", "b"] and words.counts.tolist() == [3, 0, 1]
    assert words.total(np.ones(4)).tolist() == [3.0, 0.0, 1.0] and not re.search("x", "".join(words.vocabulary))


def test_scoring_long_batches_holds_a_slice_at_a_time():
    import random
    import tracemalloc

    from factfade.llm import quality

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(400)) for _ in range(500)]
    table = np.random.default_rng(0).normal(size=quality.BUCKETS)
    quality.score_texts(texts[:9], table, 0.1)
    tracemalloc.start()
    whole = quality.score_texts(texts, table, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # two million characters
    assert (whole == np.concatenate([quality.score_texts([t], table, 0.1) for t in texts])).all()
