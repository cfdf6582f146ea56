import random

import numpy as np
import pyarrow as pa
import pytest
from build import NOW, ent, memory, obs, queries, values
from pyspark.sql import functions as F

from factfade.operators import allrows, hints, search, textindex


@pytest.mark.parametrize("entries", [40, 1 << 18])
def test_best_rows_of_all_equal_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(allrows, "ENTRIES", entries)
    r = random.Random(entries)
    words = [f"w{k}" for k in range(12)]
    held = {
        (e, o): {w: r.choice([0.5, 1.25, 1e-6 / 3]) for w in words if r.random() < 0.6}
        for e in (1, 2) for o in range(100 * e, 100 * e + 40)
    }
    held |= {(1, 500 + k): held[1, 100] for k in range(5)}  # copies
    asked = {
        k: (r.choice([1, 2, 3]), {w: r.randint(1, 3) for w in r.sample([*words, "gone"], 4)})
        for k in range(30)
    }
    terms = spark.createDataFrame(
        [(k, e, w, n, 6) for k, (e, ws) in asked.items() for w, n in ws.items()],
        "key long, grp long, phrase string, times long, keep int",
    )
    weights = spark.createDataFrame(
        [(w, o, e, x) for (e, o), ws in held.items() for w, x in ws.items()],
        "phrase string, obs_id long, entity_id long, weight double",
    )
    want = []
    for k, (e, ws) in asked.items():
        scores = [
            (-round(sum(x * ws[w] for w, x in has.items() if w in ws), 9), o)
            for (owner, o), has in held.items() if owner == e and has.keys() & ws.keys()
        ]
        want += [(k, o, place) for place, (_, o) in enumerate(sorted(scores)[:6])]
    best = allrows.best_rows_of_all(terms, weights, 6, F.col("entity_id"))
    assert sorted(values(best, "key", "obs_id", "position")) == sorted(want)
    none = allrows.best_rows_of_all(terms.limit(0), weights, 6, F.col("entity_id"))
    assert none.collect() == []


def test_hints_of_facts_that_share_their_words_write_no_pairs(spark, monkeypatch):
    """Facts of common words meet all rows of their entity; only the best are written."""
    n, words = 120, [f"w{k}" for k in range(8)]
    r = random.Random(3)
    texts = [" ".join(r.sample(words, 6)) for _ in range(n)]
    mem = memory(
        spark, entities=[ent(1, "A")], observations=[obs(k + 1, 1, t) for k, t in enumerate(texts)]
    )
    facts = spark.createDataFrame(
        [(k, 1, t) for k, t in enumerate(texts)], "seq long, entity_id long, content string"
    )
    written = {}
    real = textindex.materialize

    def counted(df, label, partition_by=()):
        out = real(df, label, partition_by)
        written[label] = max(written.get(label, 0), out.count())
        return out

    for module in (textindex, allrows):
        monkeypatch.setattr(module, "materialize", counted)
    assert hints.conflict_hints(facts, mem, NOW, 12).count() >= n
    assert max(written.values()) <= 20 * n < n * n  # all pairs: 14,400 rows and more


def test_any_term_search_writes_no_pairs_of_query_and_row(spark, monkeypatch):
    n, words = 90, [f"w{k}" for k in range(8)]
    r = random.Random(5)
    texts = [" ".join(r.sample(words, 6)) for _ in range(n)]
    mem = memory(
        spark, entities=[ent(1, "A")], observations=[obs(k + 1, 1, t) for k, t in enumerate(texts)]
    )
    prepared = search.prepare_queries(queries(spark, *[(t, 2) for t in texts]))
    weights = search.search_weights(prepared, mem, NOW)
    best = values(textindex_any(prepared, weights), "query_id", "obs_id", "position")
    written = []
    real = textindex.materialize

    def counted(df, label, partition_by=()):
        out = real(df, label, partition_by)
        written.append(out.count())
        return out

    for module in (textindex, allrows):
        monkeypatch.setattr(module, "materialize", counted)
    got = search.fts_any_term(prepared, weights)
    assert sorted(values(got, "query_id", "obs_id", "position")) == sorted(best)
    assert max(written) <= 7 * n < n * n


def textindex_any(prepared, weights):
    """The same search by the bounds of ``textindex.best_rows``."""
    keyed = search.term_phrases(prepared).select(
        F.col("query_id").alias("key"), F.lit(0).alias("grp"), "phrase", "times",
        F.col("collect").alias("keep"),
    )
    found = textindex.best_rows(keyed, weights, search.most_hits(prepared), F.lit(0))
    return found.withColumnRenamed("key", "query_id")


@pytest.mark.parametrize("sums,matrix,sample", [(1 << 21, 1 << 23, 4096), (64, 100, 4), (7, 0, 4)])
def test_a_pair_of_blocks_chooses_as_full_sums_do(monkeypatch, sums, matrix, sample):
    for name, value in (("_SUMS", sums), ("_MATRIX", matrix), ("_SAMPLE", sample)):
        monkeypatch.setattr(allrows, name, value)
    r = random.Random(sums)
    often = [0.75, 1e-6 * 1.1, 1.0 / 3]
    held = {o: {w: r.choice(often) for w in range(9) if r.random() < 0.7} for o in range(300)}
    for o in held:
        held[o] |= {r.randint(9, 200): 5.5 + o % 3}
    held |= {1000 + k: dict(held[7]) for k in range(6)}  # copies
    asked = {k: {w: r.randint(1, 2) for w in r.sample(range(200), 40)} for k in range(25)}

    def block(rows):
        return allrows._pack(pa.table({
            "grp": [1] * len(rows), "own_block": [0] * len(rows), "owner": [x[0] for x in rows],
            "no": [x[1] for x in rows], "value": [float(x[2]) for x in rows],
        }))

    def flat(texts):
        rows = [(o, w, x) for o, ws in texts.items() for w, x in ws.items()]
        return r.sample(rows, len(rows))

    found = allrows._best_of_pair(block(flat(asked)), block(flat(held)), 5)
    want = []
    for k, ws in asked.items():
        scores = [
            (-round(sum(has[w] * ws[w] for w in sorted(has) if w in ws) * 1e9), o)
            for o, has in held.items() if has.keys() & ws.keys()
        ]
        want += [(k, o, -s) for s, o in sorted(scores)[:5]]
    got = list(zip(*(found[c].to_pylist() for c in ("key", "obs_id", "units")), strict=True))
    assert sorted(got) == sorted(want)


def test_words_of_a_block_travel_in_few_bytes_and_words_of_a_group_in_few_blocks():
    """Before: 24 bytes a word, and blocks of a group met 64 times as often."""
    n = 20_000
    r = np.random.default_rng(1)
    rows = {"owner": r.integers(0, n // 100, n), "no": r.zipf(1.3, n) % 1000, "value": r.random(n)}
    packed = allrows._pack(pa.table({"grp": [1] * n, "own_block": [0] * n} | rows))
    size = sum(len(packed[name][0].as_py()) for name, _ in allrows._PARTS)
    assert size <= 14 * n
    assert allrows.ENTRIES >= 1 << 21


def test_phrases_looked_up_by_their_rarest_word_are_those_found_in_every_text(spark, monkeypatch):
    r = random.Random(11)
    words = ["commonword", "a", "b", "c d", "é"]
    texts = [" ".join(r.choice(words) for _ in range(12)) + f" n{k % 9}" for k in range(60)]
    texts += ["a a a a", "commonword commonword commonword", "", "n1 a commonword"]
    mem = memory(
        spark, entities=[ent(1, "A commonword")],
        observations=[obs(k + 1, 1, t) for k, t in enumerate(texts)],
    )
    asked = ["a a", "a a a", "commonword b", "commonword commonword", "n1 a", "c d n3", "no such", "b", "c", "a commonword"]
    asked += [" ".join(t.replace("é", "e").split()[-5:]) for t in texts[:20]]
    phrases = spark.createDataFrame([(p,) for p in sorted(set(asked))], "phrase string")
    columns = ("phrase", "obs_id", "entity_id", "live", "tf", "row_tokens")

    def found():
        hits = textindex.phrase_hits(mem, NOW, phrases).filter(F.col("phrase") != "")
        return sorted(values(hits.filter(F.col("obs_id").isNotNull()), *columns))

    want = found()
    met = {}
    real = textindex._several_hits

    def counted(phrases, rows, each):
        met["rows"] = real(phrases, rows, each)
        return met["rows"]

    monkeypatch.setattr(textindex, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(textindex, "_several_hits", counted)
    assert found() == want and len(want) > 60
    assert met["rows"].count() == sum(v[4] for v in want if " " in v[0])


def test_match_ids_write_no_pairs_of_word_and_row(spark, monkeypatch):
    """Before, every word of a query met every row holding it, each a row of a shuffle."""
    n, words = 60, [f"w{k}" for k in range(8)]
    r = random.Random(8)
    texts = [" ".join(r.sample(words, 6)) for _ in range(n)]
    mem = memory(
        spark, entities=[ent(1, "A")], observations=[obs(k + 1, 1, t) for k, t in enumerate(texts)]
    )
    monkeypatch.setattr(allrows, "ALL_KEYS", 7)
    monkeypatch.setattr(allrows, "ALL_ROWS", 16)
    pairs = []
    monkeypatch.setattr(
        search, "all_rows_of_all", lambda *a: pairs.append(allrows.all_rows_of_all(*a)) or pairs[0]
    )
    got = values(
        search.text_match_ids(queries(spark, *[(t, 2) for t in texts[:20]]), mem, NOW),
        "query_id", "obs_id", "text_rank", "pos",
    )
    assert pairs[0].count() == len(got) == 20 * n
    hits = textindex.phrase_hits(
        mem, NOW, spark.createDataFrame([(w,) for w in words], "phrase string")
    )
    weight = {(p, o): w for p, o, w in values(textindex.text_weights(hits), "phrase", "obs_id", "weight")}
    for q in sorted({g[0] for g in got}):
        mine = sorted((g[3], g[1], g[2]) for g in got if g[0] == q)
        asked = texts[int(q) - min(int(g[0]) for g in got)].split()
        want = sorted((-round(sum(weight.get((w, o), 0) for w in asked), 9), o) for o in range(1, n + 1))
        assert [o for _, o, _ in mine] == [o for _, o in want]
        assert [x for *_, x in mine] == pytest.approx([s for s, _ in want])
        assert [p for p, *_ in mine] == list(range(1, n + 1))


def test_numbering_deals_rows_once(spark):
    """Before, numbered rows were dealt by their partition and sorted a second time."""
    from factfade.operators.ordering import number_rows

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    numbered = number_rows(df.repartition(7), [F.col("v")], "no")
    assert sorted(values(numbered, "v", "no")) == [(v, v + 1) for v in range(1000)]
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_hints_rank_candidates_without_their_whole_texts(spark, monkeypatch):
    """Before, the text of each of the fifty candidates of a fact was dealt to be ranked."""
    mem = memory(spark, entities=[ent(1, "A")], observations=[obs(1, 1, "word " * 60)])
    facts = spark.createDataFrame([(1, 1, "word")], "seq long, entity_id long, content string")
    ranked = []
    real = hints.score_candidates

    def score(hydrated, *args, **options):
        ranked.append(hydrated)
        return real(hydrated, *args, **options)

    monkeypatch.setattr(hints, "score_candidates", score)
    found = values(hints.conflict_hints(facts, mem, NOW, 12, min_score=0.0), "obs_id", "snippet")
    assert found == [(1, ("word " * 60)[:119] + "…")]
    assert "content" not in ranked[0].columns
