"""The registered queries and the stages of the pipeline."""

import compare
import edges
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from factfade.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    found = entry_point.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert "pipeline" in found and set(q.ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, name):
    got = compare.spark_rows(q.QUERIES[name](spark, SF))
    assert compare.difference(got, compare.duck_rows(compare.duck(SF), q.ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_covers_its_table(spark, name):
    found = q.QUERIES[name](spark, SF)
    if name.startswith("op1_"):
        ids = q.table(spark, SF, "conversations").select("conv_id").distinct().count() + 1
        assert found.count() == found.select("conv_id").distinct().count() == ids
    elif name.startswith("op10_"):
        texts = q.table(spark, SF, "documents")
        held = texts.filter(F.col("text").rlike("MIT License|CC BY-NC 4|Apache License|General Public License"))
        assert {r[0] for r in found.select("doc_id").collect()} == {r[0] for r in held.select("doc_id").collect()}
    elif name.startswith("op11_"):
        assert found.select("page_id").distinct().count() == q.table(spark, SF, "pages").count()
    elif name.startswith("op13_"):
        ids = q.table(spark, SF, "conversations").select("conv_id").distinct().count()
        assert found.filter("depth = 0").first()["n_convs"] == ids
    else:
        assert found.select("doc_id").distinct().count() == q.table(spark, SF, "documents").count()


def reread(spark, df, folder):
    df.write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage is held against plain loops over the rows that it was given."""
    from test_llm_nearcopies import alike, groups, slow_wide
    from test_llm_simhash import slow_simhash

    docs = q.table(spark, SF, "documents")
    columns = docs.columns
    given = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = reread(spark, stage(spark, docs, SF), tmp_path / str(k))
        given[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, SF, "labels").collect()}
    before, after = given["quality"]
    kept = {r["doc_id"] for r in after}
    right = sum((r["doc_id"] in kept) == (labels[r["doc_id"]] == 1) for r in before if r["doc_id"] in labels)
    assert right >= 0.97 * sum(r["doc_id"] in labels for r in before)
    before, after = given["exact copies"]
    largest = {}
    for r in before:
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())
    before, after = given["near copies"]
    fps = {r["doc_id"]: (slow_simhash(r["text"]), slow_wide(r["text"])) for r in before}
    label = groups(
        fps, lambda a, b: (fps[a][0] ^ fps[b][0]).bit_count() <= 4 or alike(fps[a][1], fps[b][1])
    )
    lowest = {low: low for low in label.values()}
    assert sorted(r["doc_id"] for r in after) == sorted(lowest.values())
    before, after = given["mixing"]
    words = sum(len(r["text"].split()) for r in before)
    assert abs(sum(len(r["text"].split()) for r in after) - 1.5 * words) < 0.03 * words + 500
    before, after = given["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    filled = {}
    for r in after:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))]
        assert sum(p[1] for p in parts) <= 1024


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_awkward_rows(spark, name, stage):
    docs = edges.documents(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
    ids = {r["doc_id"] for r in rows}
    if name == "exact copies":
        texts = [r["text"] or "" for r in rows]
        assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})
        assert 10 in ids and 5 not in ids and 6 in ids and 1 not in ids
    if name == "near copies":
        assert 5 in ids and 10 not in ids and 2 in ids and 3 not in ids
    if name == "packing":
        assert len(ids) == len({r["doc_id"] for r in docs.collect()})
    assert stage(spark, edges.empty(spark), SF).count() == 0


def test_run_is_the_stages_in_order(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact copies", "near copies", "mixing", "packing"]
