"""Near copies by wide SimHash against plain loops and planted pairs."""

import math
import random
import re

import edges
import pytest
import xxhash
from pyspark.sql import functions as F

from factfade.llm import nearcopies as nc
from factfade.llm.simhash import removed
from factfade.operators.similarity import connected_components

MASK = (1 << 64) - 1


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def spread(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & MASK
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def slow_wide(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)]
    out = 0
    for k in range(8):
        words = [spread(h + (k + 1) * 0x9E3779B97F4A7C15 & MASK) for h in hashes]
        for bit in range(64):
            out |= (2 * sum(w >> bit & 1 for w in words) > len(words)) << (64 * k + bit)
    return out, len(hashes)


def alike(a, b, least=nc.LEAST):
    if not a[1] or not b[1]:
        return False
    shared = math.cos(math.pi * (a[0] ^ b[0]).bit_count() / 512) * math.sqrt(a[1] * b[1])
    shared = min(shared, a[1], b[1])
    return shared / (a[1] + b[1] - shared) >= least


def groups(nodes, linked):
    """Components over all pairs; the smallest member names each."""
    nodes, label = sorted(nodes), {}
    for first in nodes:
        stack = [] if first in label else [first]
        label.setdefault(first, first)
        while stack:
            x = stack.pop()
            for y in nodes:
                if y not in label and linked(x, y):
                    label[y] = first
                    stack.append(y)
    return label


def edited(rng, words, share):
    words = list(words)
    for at in rng.sample(range(len(words)), max(1, round(share * len(words)))):
        words[at] = f"edit{rng.randrange(10**9)}"
    return words


def prose(rng, n):
    return [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]


@pytest.mark.parametrize("row", edges.rows())
def test_fingerprint(row):
    hashes = nc.shingle_hashes(row[1] or "")
    wide = sum(int(w) << 64 * k for k, w in enumerate(nc.wide_fingerprint(hashes)))
    assert (wide, len(hashes)) == slow_wide(row[1])


@pytest.mark.parametrize("group", [nc.GROUP, 30])
def test_links_connect_what_brute_force_connects(spark, group):
    """Rare pairs, a dense family and a line that all documents share."""
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(12))
    texts = []
    for _ in range(60):
        words = prose(rng, rng.choice([30, 80, 200]))
        texts += [" ".join(words), " ".join(edited(rng, words, 0.01)), line + " " + " ".join(prose(rng, 40))]
    family = prose(rng, 150)
    texts += [" ".join(edited(rng, family, 0.01)) for _ in range(80)] + ["two words", line]
    wide = {t: slow_wide(t) for t in texts}
    expected = {}
    for t, low in groups(wide, lambda a, b: alike(wide[a], wide[b])).items():
        expected.setdefault(low, set()).add(t)
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", texts[0]]], "text string").repartition(5)
    of_hash = {r["h"]: r["text"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    found = nc.wide_links(df, group=group)
    pairs = found.collect()
    assert all(alike(wide[of_hash[r["a"]]], wide[of_hash[r["b"]]]) for r in pairs)
    assert len(pairs) < 40 * len(texts)  # a forest for each key, not all pairs of the family
    got = {}
    for r in connected_components(found.select(F.lit(0).alias("grp"), "a", "b")).collect():
        got.setdefault(r["label"], set()).add(of_hash[r["node"]])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_recall_of_planted_pairs(spark):
    """Jaccard 0.8 and more is found, what is far below is not, over 1,500 pairs."""
    rng = random.Random(11)
    rows, truth = [], {}
    for k in range(1500):
        words = prose(rng, rng.randint(25, 400))
        other = edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.06, 0.1]))
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        truth[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    label = {r["doc_id"]: r["label"] for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k for k in truth if label[2 * k] == label[2 * k + 1]}
    near = {k for k, j in truth.items() if j >= 0.8}
    far = {k for k, j in truth.items() if j < 0.55}
    assert len(near) > 500 and len(far) > 300
    recall, wrong = len(found & near) / len(near), len(found & far) / len(far)
    print(f"recall {recall:.4f} of {len(near)}, far pairs linked {wrong:.4f} of {len(far)}")
    assert recall >= 0.97 and wrong <= 0.01
    # Pairs are strangers to each other.
    assert all(v // 2 == k // 2 for k, v in {i: min(j for j in label if label[j] == label[i]) for i in range(0, 3000, 97)}.items())


def test_documents(spark):
    docs = edges.documents(spark, extra=[(40, "The cat of the house sat on a mat and the dog looked at it again.")])
    found = nc.near_copies(docs).collect()
    assert len(found) == docs.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["label"])
    assert by_id[1] == by_id[6] == by_id[40] and by_id[5] == by_id[10]
    assert by_id[2] == by_id[3] == by_id[4] and by_id[7].isdisjoint(by_id[8] | by_id[2])
    away = {(r["doc_id"], r["text_hash"]) for r in removed(nc.near_copies(docs)).collect()}
    assert {i for i, _ in away} >= {6, 10, 40, 3, 4} and not {1, 2, 5, 7, 8} & {i for i, _ in away}
    assert nc.near_copies(edges.empty(spark)).count() == 0
