from build import NOW, ago, ent, memory, obs, queries, values
from pyspark.sql import functions as F

from factfade.operators import hints, search, substrings, textindex


def store(spark):
    return memory(
        spark,
        entities=[ent(1, "Zara"), ent(2, "ZaraMobile"), ent(3, "Tom", entity_type="person")],
        observations=[
            obs(1, 1, "likes coffee"), obs(2, 1, "works remotely"), obs(3, 2, "an app"),
            obs(4, 3, "met Zara yesterday"),
        ],
    )


def test_the_exact_entity_wins(spark):
    ranked = search.recall(queries(spark, ("Zara", 10)), store(spark), NOW, 12)
    best = {}
    for name, score in values(ranked, "entity_name", "composite_score"):
        best[name] = max(best.get(name, 0), score)
    assert best["Zara"] > best["ZaraMobile"] > 0 and best["Tom"] > 0


def test_blank_zero_and_unmatched_queries_return_nothing(spark):
    asked = queries(spark, ("   ", 5), ("Zara", 0), ("%", 5), ("qqq zzz", 5))
    mem = store(spark)
    prepared = search.prepare_queries(asked)
    candidates = search.collect_candidates(prepared, mem, NOW)
    ranked = search.recall_from(candidates, prepared, mem, NOW, 12)
    assert ranked.count() == 0
    metrics = search.search_metrics(asked, candidates, ranked)
    assert [r["channels"] for r in metrics.collect()] == [{}] * 4
    assert metrics.agg(F.sum("score_max")).first()[0] == 0.0


def test_phrases_cross_no_fields_and_count_overlaps(spark):
    mem = memory(
        spark, entities=[ent(1, "alpha beta")],
        observations=[obs(1, 1, "gamma gamma gamma", entity_type="kind"), obs(2, 1, "delta")])
    phrases = spark.createDataFrame(
        [("beta gamma",), ("gamma gamma",), ("alpha beta",), ("gamma kind",)], "phrase string")
    for size in (textindex.BROADCAST_BYTES, 0):  # in the scan, and by a shuffle
        hits = phrase_rows(mem, phrases, size)
        assert hits == {("alpha beta", 1): 1, ("alpha beta", 2): 1, ("gamma gamma", 1): 2}


def phrase_rows(mem, phrases, size):
    kept, textindex.BROADCAST_BYTES = textindex.BROADCAST_BYTES, size
    try:
        hits = textindex.phrase_hits(mem, NOW, phrases)
    finally:
        textindex.BROADCAST_BYTES = kept
    assert values(hits.filter("phrase = ''"), "tf", "all_tokens") == [(2, 9)]
    return {(p, o): tf for p, o, tf in values(hits.filter("phrase <> ''"), "phrase", "obs_id", "tf")}


def test_best_rows_equal_brute_force(spark):
    # Weights fall into a few common words that nearly all rows hold and rare ones.
    rows = []
    for word in range(30):
        for row in range(200):
            if word < 5 or (row * 31 + word * 17) % 23 == 0:
                rows.append((f"w{word}", row, row % 2, (1e-3 if word < 5 else 1.0) * (1 + (row * word) % 7)))
    weights = spark.createDataFrame(rows, "phrase string, obs_id long, entity_id long, weight double")
    terms = [(k, k % 2, f"w{w}", 1 + w % 2, 5) for k in range(6) for w in range(30) if (w + k) % 3]
    asked = spark.createDataFrame(terms, "key long, grp long, phrase string, times long, keep int")
    got = {}
    for key, row, place in values(textindex.best_rows(asked, weights, 5, F.col("entity_id")), "*"):
        got.setdefault(key, {})[place] = row
    for key in range(6):
        score = {}
        for k, grp, phrase, times, _ in terms:
            if k == key:
                for p, row, entity, weight in rows:
                    if p == phrase and entity == grp:
                        score[row] = score.get(row, 0) + weight * times
        best = sorted(score, key=lambda r: (-round(score[r], 9), r))[:5]
        assert [got[key][i] for i in range(len(best))] == best


def test_many_needles_equal_few(spark):
    texts = [f"row {i} {'needle' if i % 7 == 0 else 'hay'}{i}x ünïcode-{i % 5}" for i in range(120)]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "obs_id long, text string, g int")
    needles = [str(i) for i in range(60)] + [f"y{i}x" for i in range(40)] + ["n", "ün", "e-3", "dle7", "zzz"]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    assert len(needles) > substrings.FEW
    got = {}
    for g, n, row, place in values(
        substrings.lowest_ids_containing(rows, asked, 4, ("g",)), "g", "needle", "obs_id", "position"
    ):
        got.setdefault((g, n), []).append((place, row))
    for n in needles:
        for g in (0, 1):
            want = [i for i, t in enumerate(texts) if n in t and i % 2 == g][:4]
            assert sorted(got.get((g, n), [])) == list(enumerate(want)), (n, g)


def test_a_full_list_drops_new_rows_and_stops_later_steps(spark):
    hits = spark.createDataFrame(
        [(1, 0, "fts_phrase", 10, 0, 0), (1, 1, "fts", 11, 0, 0), (1, 2, "entity_exact", 12, 0, None),
         (1, 2, "entity_exact", 10, 1, None), (1, 2, "entity_exact", 13, 2, None),
         (1, 3, "entity_like", 11, 0, None), (2, 3, "entity_like", 5, 0, None)],
        "query_id long, step int, channel string, obs_id long, position int, fts_pos int")
    caps = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, cap int")
    kept = search.merge_hits(search.cap_candidates(hits, caps))
    got = {(q, o): c for q, o, c in values(kept, "query_id", "obs_id", "channels")}
    # Three rows fill the list in step 2: row 13 is dropped and step 3 does not run.
    assert got == {(1, 10): ["entity_exact", "fts_phrase"], (1, 11): ["fts"],
                   (1, 12): ["entity_exact"], (2, 5): ["entity_like"]}


def test_staged_look_up_changes_nothing(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "mu"]
    mem = memory(spark, entities=[ent(i, f"E{i}") for i in range(1, 4)], observations=[
        obs(i, i % 3 + 1, " ".join(words[(i * k) % 11] + "x" * (i % 2) for k in range(1, 5)))
        for i in range(1, 300)])
    asked = queries(spark, (" ".join(words), 20), (" ".join(reversed(words)) + " nowhere", 3), ("amm et", 5))
    columns = ("query_id", "rank", "obs_id", "channels", "composite_score")
    want = sorted(values(search.recall(asked, mem, NOW, 12), *columns))
    monkeypatch.setattr(search, "EARLY_STEPS", 2)
    assert sorted(values(search.recall(asked, mem, NOW, 12), *columns)) == want
    assert len(want) == 28


def test_touch_counts_each_return_of_a_visible_row(spark):
    mem = memory(spark, entities=[ent(1, "A")],
                 observations=[obs(1, 1, "x"), obs(2, 1, "y", deleted_at=NOW), obs(3, 1, "z")])
    returned = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    after = search.touch(mem, returned, NOW)
    assert sorted(values(after, "id", "access_count", "last_accessed")) == [
        (1, 2, NOW), (2, 0, None), (3, 0, None)]


def hint_ids(spark, mem, content, half_life=12, entity_id=1):
    facts = spark.createDataFrame([(1, entity_id, content)], "seq long, entity_id long, content string")
    return values(hints.conflict_hints(facts, mem, NOW, half_life).orderBy("rank"), "obs_id", "similarity")


def test_hints_stay_inside_the_entity(spark):
    mem = memory(spark, entities=[ent(1, "API"), ent(2, "Other")],
                 observations=[obs(1, 1, "rate limit is 100 per minute")])
    found = hint_ids(spark, mem, "rate limit is 200 per minute")
    assert len(found) == 1 and found[0][1] >= 0.6
    assert hint_ids(spark, mem, "rate limit is 200 per minute", entity_id=2) == []


def test_at_most_three_hints(spark):
    mem = memory(spark, entities=[ent(1, "API")], observations=[
        obs(i, 1, f"rate limit is {i}00 per minute") for i in range(1, 6)])
    assert len(hint_ids(spark, mem, "rate limit is 900 per minute")) == 3


def test_age_decides_hints_found_inside_words_only(spark):
    mem = memory(spark, entities=[ent(1, "API")], observations=[
        obs(1, 1, "scaler max_concurrent value 32", created_at=ago(weeks=8))])
    assert hint_ids(spark, mem, "scal", 12) == []
    assert [r[0] for r in hint_ids(spark, mem, "scal", 52)] == [1]
