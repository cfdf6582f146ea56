import random
import re
from collections import Counter, defaultdict

import compare
import edges
import numpy as np
import pytest

from factfade.llm import phrases, queries


def brute(rows, least, most=2000):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang) by plain counting."""
    f = defaultdict(Counter)
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for words, a in counts.items():
            if len(words) == 1 or a < least:
                continue
            if len(words) == 2 and any(
                len(w) == 3 and words in (w[:2], w[1:]) and 100 * b >= 50 * a and b >= least
                for w, b in counts.items()
            ):
                continue
            cuts = [
                (10**6 * a * a // (counts[words[:k]] * counts[words[k:]]), k) for k in range(1, len(words))
            ]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(words).encode(), counts[words[:k]], counts[words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, least, **more).collect())


def prose(seed, docs, words):
    r = random.Random(seed)
    return [
        (" ".join(r.choice(words) + r.choice(["", "", "", ".", ", ", "\n"]) for _ in range(r.randint(0, 30))),
         r.choice(["en", "de", None]))
        for _ in range(docs)
    ]


@pytest.mark.parametrize("shards", [1, 2, 4])
def test_against_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    rows = prose(shards, 120, ["a", "B", "cc", "New", "York", "é", "#1"])
    assert found(spark, rows, 5, shards=shards) == brute(rows, 5)


def test_late_phrases_get_a_whole_cycle(spark, monkeypatch):
    """Words that reach the threshold in the last shard only, and a lone common phrase."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1)
    rows = [("one two three", "en")] * 40 + [("rare bird sings", "en")] * 10 + [("rare bird", "en")] * 9
    assert found(spark, rows, 10) == brute(rows, 10)


def test_awkward_texts(spark):
    rows = [
        (None, "en"), ("", None), ("  \t ", "en"), ("...;;;", "en"), ("A\tb  c. A b c\x0bA b\rc", "und"),
        ("a b c", None), ("nbsp x\x1cy", "en"), ("ÀÉ 中文 straße", "de"), ("x y " * 40_000, "en"),
    ] * 3
    assert found(spark, rows, 3) == brute(rows, 3)


def test_a_pair_that_a_filter_holds_by_mistake(spark):
    """Triples begin no earlier than their words are reached, else their cycle lacks shards.

    The filter of pairs at step 1 is full, the rare words are reached at step 3 only.
    """
    common = [f"c{k}" for k in range(64)]
    every = ". ".join(f"{a} {b}" for a in common for b in common) + "."
    rare = [f"r{k} c0 c1." for k in range(5000)]
    shards = [
        [" ".join(common)] * 10 + rare * 3, [every] * 10 + rare * 3, rare * 3, rare,
    ]
    docs = spark.createDataFrame(
        spark.sparkContext.parallelize([(" ".join(s), "en") for s in shards], 4), "text string, lang string"
    )
    counted, _ = phrases.count_phrases(docs)
    got = counted.filter("words = 3 and phrase like 'r%'")
    assert got.count() == len(rare) and got.filter("n <> 10").isEmpty()


def test_limit_and_ties(spark):
    rows = [(f"w{k} v{k}", "en") for k in range(50) for _ in range(3)]
    got = found(spark, rows, 3, most=7)
    assert got == brute(rows, 3, 7) and len(got) == 7


def test_edge_tables(spark):
    df = edges.documents(spark)
    rows = [(r["text"], r["lang"]) for r in df.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(df, 2).collect()) == brute(rows, 2)
    assert phrases.collocations(edges.empty(spark)).collect() == []


def test_filters_hold_what_was_added(spark):
    """Blocks of counts: sums, reached keys and the filters made of them."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**36, 3000, dtype=np.uint64))
    rows = []
    for times, some in ((1, keys), (1, keys[::2]), (300, keys[::3])):
        for bucket in range(16):
            own = some[some >> np.uint64(32) == bucket]
            if len(own):
                low = (own & np.uint64(2**32 - 1)).astype(np.uint32)
                rows.append(phrases._block(2, bucket, low, np.full(len(low), times)))
    blocks = spark.createDataFrame(rows, phrases._BLOCKS).repartition(5)
    sums = phrases.add_up(blocks, 2)
    want = np.ones(len(keys), int)
    want[::2] += 1
    want[::3] += 300
    got = {}
    for r in sums.collect():
        low = np.cumsum(phrases.unpack(r["keys"]), dtype=np.uint32).astype(np.uint64)
        n = phrases.unpack(r["n"])
        assert r["size"] == len(n) and ((n >= 2) == r["full"]).all()
        got |= dict(zip((low | np.uint64(r["bucket"] << 32)).tolist(), n.tolist()))
    assert got == dict(zip(keys.tolist(), want.tolist()))
    reached = phrases.Reached()
    reached.add(4, sums.filter("full"), int((want >= 2).sum()))
    assert (reached.step_of(keys[want >= 2]) == 4).all()
    assert (reached.step_of(keys[want < 2]) < phrases.NEVER).mean() < 0.02


def test_products_beyond_64_bits(spark):
    """The exact score of counts whose products pass 64 bits."""
    a, left, right = 3_000_000_000, 4_000_000_001, 3_000_000_007
    sql = (
        "(cast(1000000 as decimal(38, 0)) * cast(a as decimal(38, 0)) * a)"
        " div (cast(l as decimal(38, 0)) * r)"
    )
    row = spark.sql(f"select {a}L a, {left}L l, {right}L r").selectExpr(f"{sql} s").first()
    assert row["s"] == 10**6 * a * a // (left * right)


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = compare.duck(sf)
    got = compare.spark_rows(queries.QUERIES["op12_phrases"](spark, sf))
    assert compare.difference(got, compare.duck_rows(con, queries.ORACLES["op12_phrases"])) is None
