import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factfade.llm import prefixtrie

CONV = "conv_id long, turn long, role string, text string"
FIELDS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def brute(rows):
    """The trie from plain tuples, node by node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c, said in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - int(np.fmod(c, 100))
        whole[c] = tuple(turns.get(lender, [])[:h] + said[h:])
    members = defaultdict(set)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[said[:d]].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        under = [totals[k] for k in children[node]]
        totals[node] = (
            saved + sum(s for s, _ in under), sum(n for _, n in under) if under else 1
        )
    out = []
    for node, has in members.items():
        ends = ",".join(str(c) for c in sorted(has) if len(whole[c]) == len(node))
        out.append((
            min(has), len(node), min(members[node[:-1]]) if node else None, len(has),
            len(children[node]), totals[node][1], totals[node][0],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, CONV).repartition(partitions)
    for name in ("depth", "k", "x1", "last", "top", "slot", "_part", "before", "one", "h", "n"):
        df = df.withColumn(name, F.lit("x"))
    return sorted((tuple(r[f] for f in FIELDS) for r in prefixtrie.prefix_trie(df).collect()), key=str)


def talk(seed, convs, words=3, turns=6):
    rng = np.random.default_rng(seed)
    return [
        (int(c), t, "user" if t % 2 == 0 else "assistant", f"w{rng.integers(words)}")
        for c in convs for t in range(int(rng.integers(1, turns)))
    ]


@pytest.mark.parametrize("words", [1, 2, 40])
def test_against_brute_force(spark, words):
    rows = talk(words, range(0, 260), words) + talk(words, range(905, 960), words)
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (0, None, None, None), (0, 0, "user", "hi"), (0, 1, "assistant", ""), (0, 1, "assistant", ""),
        (1, 5, "user", "x" * 50_000), (2, 0, None, "hi"), (2, 0, "user", None), (-7, 0, "user", "hi"),
        (None, 0, "user", "nobody"), (250, 0, "user", "no lender"), (251, 0, "user", "no lender"),
        (7, 3, "us", "er"), (8, 3, "user", ""), (9, 3, "", "user"), (300, 0, "user", "ÀÉ中文"),
    ]
    assert found(spark, rows) == brute(rows)


def test_long_conversations_are_cut_into_slices(spark):
    rows = [(c, t, "user", f"t{t}") for c in (0, 1, 100) for t in range(2500)]
    rows += [(3, t, "user", f"t{t if t < 2100 else -t}") for t in range(2300)]
    assert found(spark, rows) == brute(rows)


def test_many_copies_of_a_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(3000) for t in range(3)]
    rows += talk(5, range(3000, 3200), 2)
    assert found(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(None, 1, "user", "x")], 1) == []


def test_a_full_sketch_changes_no_result(spark, monkeypatch):
    """With every cell in use all prefixes go the exact way."""
    rows = talk(9, range(0, 220), 40)
    monkeypatch.setattr(prefixtrie, "may_be_shared", lambda x1, x2, bits: np.ones(len(x1), bool))
    assert found(spark, rows) == brute(rows)


def test_screen_never_misses_a_shared_prefix(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-(2**62), 2**62, (2, 4000))
    rows = [(int(x), int(x) ^ 5) for x in [*once, *twice, *twice]]
    width = prefixtrie.sketch_width(len(rows))
    bits = prefixtrie.shared_cells(
        spark.createDataFrame(rows, "x1 long, x2 long").repartition(7), width
    )
    assert prefixtrie.may_be_shared(twice, twice ^ 5, bits).all()
    assert prefixtrie.may_be_shared(once, once ^ 5, bits).mean() < 0.1


def test_query_covers_its_table(spark):
    from factfade.llm import queries

    df = queries.QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.001")
    assert tuple(df.columns) == FIELDS
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "conversations").select(
        "conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)
