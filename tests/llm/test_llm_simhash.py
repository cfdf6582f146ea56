import random
import re

import edges
import numpy as np
import pytest
import xxhash

from factfade.llm import simhash as sh


def slow_simhash(text, size=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [words[i : i + size] for i in range(len(words) - size + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance):
    fps, label = sorted(set(fps)), {}
    for f in fps:
        if f in label:
            continue
        stack, label[f] = [f], f
        while stack:
            x = stack.pop()
            for y in fps:
                if y not in label and (x ^ y).bit_count() <= distance:
                    label[y] = f
                    stack.append(y)
    return label


@pytest.mark.parametrize("row", edges.rows())
def test_fingerprint(row):
    assert sh.simhash(row[1] or "") == slow_simhash(row[1])


def planted(n=400, seed=1):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):  # chains and dense groups around what is there
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    return [*fps, 0, 1, (1 << 64) - 1]


@pytest.mark.parametrize("group", [sh.GROUP, 40])
def test_links_connect_what_brute_force_connects(spark, group):
    from factfade.operators.similarity import connected_components
    from pyspark.sql import functions as F

    dense = [(0b11 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40)]
    fps = sorted({*planted(), *dense})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    rows, together = sh.bit_statistics(df)
    assert rows == len(fps)
    assert together[3, 7] == sum(1 for f in fps if f >> 3 & 1 and f >> 7 & 1)
    edges_ = sh.links(sh.probes(df, sh.choose_thresholds(rows, together), group))
    found = edges_.collect()
    for r in found:
        assert 0 < ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4
    assert len(found) < 8 * len(fps)  # not all pairs of the dense group
    labels = connected_components(edges_.select(F.lit(0).alias("grp"), "a", "b"))
    got = {}
    for r in labels.collect():
        got.setdefault(r["label"], set()).add(r["node"] % 2**64)
    expected = {}
    for f, low in components(fps, 4).items():
        expected.setdefault(low, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_thresholds_obey_the_generalised_pigeonhole():
    rng = np.random.default_rng(0)
    for rows in (10, 10**5, 10**8):
        bits = rng.random((500, 64)) < 0.5
        bits[:, 1] = bits[:, 0]
        together = bits.T.astype(float) @ bits * rows / 500
        chosen = sh.choose_thresholds(rows, together)
        groups = [set(g) for g, _ in chosen]
        assert sum(len(g) for g in groups) == len(set().union(*groups)) <= 64
        # Any four flips leave some partition within its threshold.
        for _ in range(300):
            flips = set(rng.choice(64, 4, replace=False).tolist())
            assert any(len(flips & g) <= t for g, (_, t) in zip(groups, chosen, strict=True))
    assert any({0, 1} <= set(g) for g in sh.partition_bits(rows, together, 4))


def test_documents(spark):
    base = "alpha beta gamma delta " + " ".join(f"w{i}" for i in range(300))
    extra = [(50 + k, base + f" tail{k}") for k in range(12)]
    docs = edges.documents(spark, extra=extra)
    rows = docs.select("doc_id", "text").collect()
    fps = {r["text"]: slow_simhash(r["text"]) for r in rows}
    label = components(fps.values(), 4)
    low = {}
    for r in rows:
        if r["doc_id"] is not None:
            group = label[fps[r["text"]]]
            low[group] = min(low.get(group, r["doc_id"]), r["doc_id"])
    expected = [(r["doc_id"], fps[r["text"]], low.get(label[fps[r["text"]]])) for r in rows]
    found = sh.near_duplicates(docs)
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    away = {(r["doc_id"], r["text_hash"]) for r in sh.removed(found).collect()}
    kept = [r for r in found.collect() if (r["doc_id"], r["text_hash"]) not in away]
    assert {r["label"] for r in kept} == {r["label"] for r in found.collect()}
    assert len({(r["doc_id"], r["fp"]) for r in kept}) == len({r["label"] for r in kept})


def test_nothing(spark):
    assert sh.near_duplicates(edges.empty(spark)).count() == 0
