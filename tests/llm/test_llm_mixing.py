import re
from collections import Counter, defaultdict

import edges
import pytest
from pyspark.sql import functions as F

from factfade.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """Shares by weight, the excess over the cap given on again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= passes * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = passes * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def corpus(spark):
    extra = [(100 + k, " ".join(f"w{k}x{j}" for j in range(1 + 37 * k % 400))) for k in range(90)]
    return edges.documents(spark, extra=extra)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_targets_and_words(spark):
    docs = corpus(spark)
    sizes, per_doc = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        per_doc[(r["doc_id"], len(WORD.findall(r["text"] or "")))] += 1
    mixed = mixing.mix(docs, block_words=16, shard_slots=50)
    assert {r["source"]: pytest.approx(r["target"]) for r in mixed.sources.collect()} == targets(sizes)
    found = mixed.taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == per_doc
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_source = defaultdict(int)
    for r in found:
        by_source[(r["source_size"], r["target"])] += r["taken"]
    for (_, target), taken in by_source.items():
        assert abs(taken - target) <= 32
    # The same blocks again, and every block at most once a pass.
    again = mixing.mix(docs, block_words=16, shard_slots=50)
    key = ["source_no", "slot", "shard", "block"]
    assert sorted(map(tuple, mixed.slots.select(key).collect())) == sorted(map(tuple, again.slots.select(key).collect()))
    assert mixed.slots.groupBy("source_no", "pass", "block").count().filter("count > 1").isEmpty()


def test_documents_hold_the_taken_words(spark):
    docs = corpus(spark)
    mixed = mixing.mix(docs, block_words=16, shard_slots=50)
    out = mixed.documents(docs)
    assert out.columns == docs.columns
    words, texts = Counter(), defaultdict(Counter)
    for r in docs.collect():
        texts[r["doc_id"]].update(WORD.findall(r["text"] or ""))
    for r in out.collect():
        found = WORD.findall(r["text"])
        words[r["doc_id"]] += len(found)
        assert found and not Counter(found) - texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    taken = Counter()
    for r in mixed.taken().collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken


def test_nothing_to_mix(spark):
    none = mixing.mix(edges.empty(spark))
    assert none.taken().count() == 0 and none.documents(edges.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in mixing.mix(blank).taken().collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
