import random
import tempfile

import numpy as np
import pyarrow as pa
from build import NOW, ent, facts, memory, obs, queries, values
from pyspark.sql import functions as F

from factfade.operators import hints, postings, search, textindex, writes
from factfade.operators.postings import TextIndex

WORDS = ["the", "of", "alpha", "beta", "gamma", "delta", "eps", "zeta", "rare", "seldom", "the"]
HIT = ("phrase", "obs_id", "entity_id", "live", "tf", "row_tokens", "all_tokens")


def store(spark, n=300, seed=1):
    r = random.Random(seed)
    entities = [ent(i, f"The {WORDS[i % 9]} {i}", entity_type="kind of thing") for i in range(1, 12)]
    entities[3]["deleted_at"] = NOW
    rows = [
        obs(
            i, r.randint(1, 11), " ".join(r.choice(WORDS[: 3 + i % 9]) for _ in range(r.randint(0, 12))),
            entity_type=r.choice([None, "kind", "the kind"]),
            deleted_at=NOW if i % 17 == 0 else None, superseded_by=1 if i % 13 == 0 else None,
        )
        for i in range(1, n + 1)
    ]
    return memory(spark, entities=entities, observations=rows)


def asked_phrases(spark):
    texts = ["the", "alpha beta", "the the", "the alpha the", "kind", "of thing", "absent", "the absent",
             "rare seldom", "the kind", "beta gamma"]
    return spark.createDataFrame([(t,) for t in texts], "phrase string")


def same_hits(spark, index, mem):
    want = textindex.phrase_hits(mem, NOW, asked_phrases(spark))
    got = index.hits(asked_phrases(spark), mem, NOW)
    real = F.col("phrase") != ""
    assert sorted(values(got.filter(real), *HIT[:-1])) == sorted(values(want.filter(real), *HIT[:-1]))
    mark = ("tf", "all_tokens")
    assert values(got.filter(~real), *mark) == [tuple(x or 0 for x in r) for r in values(want.filter(~real), *mark)]


def test_hits_equal_those_from_the_texts(spark, tmp_path):
    mem = store(spark)
    same_hits(spark, TextIndex.build(mem, str(tmp_path), buckets=8), mem)


def test_searches_are_the_same_with_and_without_an_index(spark, tmp_path):
    mem = store(spark)
    index = TextIndex.build(mem, str(tmp_path), buckets=8)
    asked = queries(
        spark, ("the", 3), ("the of", 5), ("the rare", 4), ("alpha beta the of", 20), ("seldom", 7),
        ("nothing here", 5), ("the-alpha of", 6), ("the the", 5), ("zeta eps rare seldom the of", 200),
    )
    columns = ("query_id", "rank", "obs_id", "channels", "composite_score")
    want = sorted(values(search.recall(asked, mem, NOW, 12), *columns))
    assert sorted(values(search.recall(asked, mem, NOW, 12, index), *columns)) == want and len(want) > 50
    ids = ("query_id", "obs_id", "pos", "text_rank")
    assert sorted(values(search.text_match_ids(asked, mem, NOW, index), *ids)) == sorted(
        values(search.text_match_ids(asked, mem, NOW), *ids))
    told = spark.createDataFrame(
        [(1, 2, "the alpha of"), (2, 5, "rare seldom"), (3, 5, "zeta")], "seq long, entity_id long, content string")
    hint = ("seq", "rank", "obs_id", "similarity")
    assert sorted(values(hints.conflict_hints(told, mem, NOW, 12, index=index), *hint)) == sorted(
        values(hints.conflict_hints(told, mem, NOW, 12), *hint))


def content(index, spark):
    """The whole index as plain values, blocks and batches aside."""
    tokens = index._table("counts", "token string, n long, batch int, token_bucket int").select("token").distinct()
    entries = index.entries(tokens).select("token", "obs_id", "entity_id", "row_tokens", "at")
    return (
        sorted(tuple(map(str, r)) for r in entries.collect()), sorted(values(index.counts(tokens), "token", "n")),
        index.totals(),
    )


def test_ten_writes_leave_the_index_of_a_new_build(spark, tmp_path):
    mem = store(spark, 60)
    index = TextIndex.build(mem, str(tmp_path / "kept"), buckets=4)
    for batch in range(1, 11):
        if batch % 3:
            write = writes.remember_batch(mem, facts(
                spark, (f"New {batch}", f"the rare word{batch} of alpha"), ("The alpha 2", f"beta gamma {batch}"),
                ("The alpha 2", "beta gamma repeated")), NOW)
        elif batch % 2:
            write = writes.forget_observations(
                mem, spark.createDataFrame([(batch,), (batch + 20,), (999,)], "id long"), NOW)
        else:
            write = writes.forget_entities(mem, spark.createDataFrame([("The beta 3",)], "name string"), NOW)
        index.follow(mem, write, batch)
        if batch == 4:  # a write that is done again replaces itself
            index.follow(mem, write, batch)
        after = {}
        for name in ("entities", "observations"):
            path = str(tmp_path / f"{name}-{batch}")
            getattr(write.memory, name).write.parquet(path)
            after[name] = spark.read.parquet(path)
        mem = write.memory.with_tables(**after)
    same_hits(spark, index, mem)
    anew = TextIndex.build(mem, str(tmp_path / "anew"), buckets=4)
    kept, want = content(index, spark), content(anew, spark)
    alive = {str(i) for (i,) in values(mem.observations.filter("deleted_at is null"), "id")}
    assert [r for r in kept[0] if r[1] in alive] == want[0] and kept[1:] == want[1:]


def test_a_search_reads_the_buckets_of_its_words_only(spark, tmp_path):
    mem = store(spark)
    index = TextIndex.build(mem, str(tmp_path), buckets=64)
    asked = spark.createDataFrame([("alpha",), ("rare",)], "token string")
    found = index._asked("blocks", postings._BLOCKS, asked)
    names = values(found.select(F.input_file_name().alias("f")).distinct(), "f")
    files = {f.split("token_bucket=")[1].split("/")[0] for (f,) in names}
    wanted = {str(b) for (b,) in values(asked.select(F.pmod(F.xxhash64("token"), F.lit(64)).alias("b")), "b")}
    assert files == wanted and len(files) <= 2
    plan = index.blocks(asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [token_bucket" in plan or "PartitionFilters: [isnotnull(token_bucket" in plan


def common(spark, tmp_path, n):
    """All rows hold ``the``, in rows of different lengths and counts."""
    entities = [ent(1, "E")]
    rows = spark.range(1, n + 1).select(
        "id", F.lit(1).cast("long").alias("entity_id"),
        F.concat(F.repeat(F.lit("the "), (F.col("id") % 5 + 1).cast("int")), F.lit("of "),
                 F.repeat(F.lit("pad "), (F.col("id") * 7919 % 83).cast("int"))).alias("content"),
    )
    mem = memory(spark, entities=entities, observations=[obs(1, 1, "x")])
    columns = [c if c in rows.columns else F.lit(None).cast(mem.observations.schema[c].dataType).alias(c)
               for c in mem.observations.columns]
    mem = mem.with_tables(observations=rows.select(*columns))
    return mem, TextIndex.build(mem, tempfile.mkdtemp(dir=tmp_path), buckets=4)


def test_rows_of_a_common_word_grow_with_k_and_not_with_the_word(spark, tmp_path, monkeypatch):
    opened, own = [], postings._Search.needed_blocks

    def counted(self, split):
        blocks = own(self, split)
        opened.append(blocks.agg(F.sum("n")).first()[0])
        return blocks

    monkeypatch.setattr(postings._Search, "needed_blocks", counted)
    for n, texts in ((2_000, ["the"]), (16_000, ["the"]), (2_000, ["the", "the of", "of pad"])):
        mem, index = common(spark, tmp_path, n)
        prepared = search.prepare_queries(queries(spark, *[(t, 4) for t in texts]))
        got = values(search.fts_any_term_indexed(prepared, index, mem, NOW), "query_id", "obs_id", "position")
        phrases = spark.createDataFrame([("the",), ("of",), ("pad",)], "phrase string")
        weights = textindex.text_weights(textindex.phrase_hits(mem, NOW, phrases))
        want = values(search.fts_any_term(prepared, weights), "query_id", "obs_id", "position")
        assert sorted(got) == sorted(want) and len(got) == len(texts) * 12
    assert opened[0] <= 512 and opened[1] <= 1024


def test_long_texts_are_added_up_from_the_index_without_bounds(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise AssertionError("blocks of long texts are not opened by bounds")

    monkeypatch.setattr(TextIndex, "best_rows", refused)
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [obs(i, 1, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(1, 600)]
    mem = memory(spark, entities=[ent(1, "A")], observations=rows)
    index = TextIndex.build(mem, str(tmp_path), buckets=4)
    prepared = search.prepare_queries(queries(spark, *[(" ".join(r.sample(words, 12)), 5) for _ in range(9)]))
    got = values(search.fts_any_term_indexed(prepared, index, mem, NOW), "query_id", "obs_id", "position")
    phrases = spark.createDataFrame([(w,) for w in words], "phrase string")
    weights = textindex.text_weights(textindex.phrase_hits(mem, NOW, phrases))
    want = values(search.fts_any_term(prepared, weights), "query_id", "obs_id", "position")
    assert sorted(got) == sorted(want) and got


def test_one_common_word_brings_the_rows_it_keeps(spark):
    rows = [("the", i, 0, 1.0 + (i * 37 % 1000) / 1000) for i in range(1000)]
    weights = spark.createDataFrame(rows, "phrase string, obs_id long, entity_id long, weight double")
    terms = spark.createDataFrame([(1, 0, "the", 1, 5)], "key long, grp long, phrase string, times long, keep int")
    by = weights.select(F.lit(0).cast("long").alias("grp"), "phrase", "obs_id", "weight")
    heads = by.orderBy(F.desc("weight")).limit(5)
    peaks = by.groupBy("grp", "phrase").agg(F.max("weight").alias("peak"))
    split = textindex.bringing_terms(terms, heads, peaks, 5, 1e-6)
    brought = split.join(by, ["grp", "phrase"]).filter(F.col("weight") * F.col("times") >= F.col("floor") - 1e-6)
    assert brought.count() == 5
    best = textindex.best_rows(terms, weights, 5, F.col("entity_id"))
    assert sorted(values(best, "obs_id")) == sorted((r[1],) for r in sorted(rows, key=lambda r: -r[3])[:5])


def test_an_empty_store(spark, tmp_path):
    mem = memory(spark, entities=[ent(1, "A")], observations=[])
    index = TextIndex.build(mem, str(tmp_path), buckets=4)
    same_hits(spark, index, mem)
    assert values(search.recall(queries(spark, ("the", 3)), mem, NOW, 12, index), "obs_id") == []


def test_places_of_the_words_of_a_row():
    words = [["a", "b", "|", "a", "|"], [], ["|", "é", "|", "é", "é", "a"]]
    batch = pa.RecordBatch.from_pydict({
        "obs_id": [1, 2, 3], "entity_id": [7, 7, 8], "row_tokens": pa.array([3, 0, 4], pa.int32()),
        "words": pa.array(words, pa.list_(pa.string())),
    })
    got = [
        (r["obs_id"], r["entity_id"], r["row_tokens"], r["token"], r["tf"], np.frombuffer(r["at"], "<i4").tolist())
        for out in postings._places([batch.slice(0, 2), batch.slice(2), batch.slice(0, 0)]) for r in out.to_pylist()
    ]
    want = [(1, 7, 3, "a", 2, [0, 3]), (1, 7, 3, "b", 1, [1]), (3, 8, 4, "a", 1, [5]), (3, 8, 4, "é", 3, [1, 3, 4])]
    assert sorted(got) == want


def test_blocks_are_cut_where_they_lie(monkeypatch):
    """Blocks go on from batch to batch and end with their token."""
    monkeypatch.setattr(postings, "BLOCK_ROWS", 3)
    r = random.Random(5)
    rows = [
        {"token_bucket": 1, "token": t, "heavy": -float(9 - i), "obs_id": i, "entity_id": 1, "row_tokens": i,
         "at": np.arange(r.randint(1, 3), dtype="<i4").tobytes()}
        for t, n in (("a", 7), ("b", 3), ("c", 1), ("d", 4)) for i in range(n)
    ]
    want = []
    for t in "abcd":
        own = [x for x in rows if x["token"] == t]
        for i in range(0, len(own), 3):
            part = own[i : i + 3]
            want.append((t, -part[0]["heavy"], len(part), [
                (x["obs_id"], x["row_tokens"], np.frombuffer(x["at"], "<i4").tolist()) for x in part]))
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)]
        got = [
            (b["token"], b["peak"], b["n"], [(e["obs_id"], e["row_tokens"], e["at"]) for e in b["entries"]])
            for out in postings._cut_blocks(2.0)(batches) for b in out.to_pylist()
        ]
        assert got == want


def test_sums_do_not_depend_on_the_order_of_terms(spark):
    terms = [(k, w) for k, order in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for w in order]
    df = spark.createDataFrame(terms, "key int, weight double").coalesce(1)
    by_key = df.groupBy("key").agg(F.sum("weight").alias("plain"), textindex.exact_sum(F.col("weight")).alias("exact"))
    assert len(set(values(by_key, "plain"))) == 2 and len(set(values(by_key, "exact"))) == 1
