import hashlib

import compare
import duckdb
import edges
import numpy as np
import pytest

from factfade.llm import exact, queries


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    seed, table, slot = exact.build_hash(keys)
    assert sorted(slot.tolist()) == list(range(n))
    strangers = np.random.default_rng(n + 1).integers(0, 256, (100, 32), dtype=np.uint8)
    where, owned = exact.slots(strangers, seed, table)
    assert ((where[owned] >= 0) & (where[owned] < max(n, 1))).all()


def brute(rows):
    groups = {}
    for doc_id, text in set(rows):
        groups.setdefault(text or "", set()).add((doc_id, hashlib.sha256((text or "").encode()).hexdigest()))
    out = []
    for members in groups.values():
        ids = {i for i, _ in members}
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, d) for i, d in members]
    return sorted(set(out), key=str)


def test_against_brute_force(spark):
    docs = edges.documents(spark, extra=[(k, f"text {k % 7}") for k in range(20, 60)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = exact.deduplicate(*exact.split_by_age(docs))
    got = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_members_of_the_history_are_marked(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["historical"]) for r in exact.deduplicate(old, new).collect()}
    assert got == {1: (3, 2, True), 3: (3, 2, True), 2: (2, 1, True), 4: (5, 2, False), 5: (5, 2, False)}


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_KEYS", 40)
    docs = spark.createDataFrame([(k, f"t{k % 300}") for k in range(900)], "doc_id long, text string")
    got = exact.deduplicate(*exact.split_by_age(docs)).collect()
    assert len(got) == 900 and {r["group_size"] for r in got} == {3}
    assert all(r["keep_id"] == 600 + r["doc_id"] % 300 for r in got)


def test_empty_sides(spark):
    none, some = edges.empty(spark), edges.documents(spark)
    n = some.select("doc_id", "text").distinct().count()
    assert exact.deduplicate(none, none).count() == 0
    assert exact.deduplicate(some, none).count() == exact.deduplicate(none, some).count() == n


def test_query_equals_its_sql_on_repeated_rows_and_missing_ids(spark, tmp_path):
    extra = [(None, "a row without an id"), (None, None), (6, None), (7, "word"), (7, "word")]
    docs = edges.documents(spark, extra=extra, clash=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = compare.spark_rows(queries.op3_exact_dedup(spark, str(tmp_path)))
    assert len(got[1]) == docs.count()
    assert compare.difference(got, compare.duck_rows(con, queries.OP3_SQL)) is None
