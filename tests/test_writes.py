import pytest
from build import NOW, ago, ent, facts, memory, obs, table, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factfade.model import Write
from factfade.operators import cleanup, integrity, views, writes
from factfade.sources import shape, store
from factfade.streaming.ingest import ingest_stream


def test_known_names_are_found_in_any_case_and_revived(spark):
    mem = memory(spark, entities=[ent(1, "Zara", entity_type="person", deleted_at=NOW), ent(2, "Tom")],
                 observations=[obs(1, 1, "old", deleted_at=NOW)])
    write = writes.remember_batch(
        mem, facts(spark, ("ZARA", "new"), {"entity": "tom", "observation": "x", "entity_type": "cat"},
                   ("New", "y"), ("new", "y")), NOW)
    assert sorted(values(write.memory.entities, "id", "name", "entity_type", "deleted_at")) == [
        (1, "Zara", "person", None), (2, "Tom", "cat", None), (3, "New", None, None)]
    assert sorted(values(write.result, "seq", "entity_id", "obs_id", "inserted")) == [
        (0, 1, 2, True), (1, 2, 3, True), (2, 3, 4, True), (3, 3, 4, False)]


def test_duplicates_of_hidden_rows_are_new(spark):
    mem = memory(
        spark, entities=[ent(1, "A")], events=[{"id": 1, "label": "e", "expires_at": ago(days=1)}],
        observations=[obs(1, 1, "ended", event_id=1), obs(2, 1, "hidden", superseded_by=3), obs(3, 1, "seen")])
    write = writes.remember_batch(
        mem, facts(spark, ("a", "ended"), ("a", "hidden"), ("a", "seen")), NOW)
    assert sorted(values(write.result, "seq", "obs_id", "inserted")) == [
        (0, 4, True), (1, 5, True), (2, 3, False)]


def test_one_bad_fact_keeps_its_batch_out(spark):
    mem = memory(spark, events=[{"id": 1, "label": "e", "expires_at": ago(days=1)}])
    batch = facts(
        spark, {"batch_id": 1, "entity": "A", "observation": "fine"},
        {"batch_id": 1, "entity": "B", "observation": "  "},
        {"batch_id": 2, "entity": "C", "observation": "x", "confidence": float("nan")},
        {"batch_id": 3, "entity": "D", "observation": "x", "event_id": 1},
        {"batch_id": 4, "entity": "E", "observation": "x", "event_id": -7})
    write = writes.remember_batch(mem, batch, NOW)
    assert values(write.result, "seq") == [(4,)]
    assert values(write.memory.entities, "name") == [("E",)]
    reasons = sorted(values(writes.rejected_facts(mem, batch, NOW), "batch_id", "field"))
    assert reasons == [(1, "facts[1].observation"), (2, "facts[2].confidence"), (3, "facts[3].event_id")]


def test_a_row_keeps_the_type_of_its_time(spark):
    mem = memory(spark, entities=[ent(1, "A", entity_type="first")])
    write = writes.remember_batch(mem, facts(
        spark, ("A", "1"), {"entity": "A", "observation": "2", "entity_type": "second"}, ("A", "3")), NOW)
    assert sorted(values(write.appended["observations"], "content", "entity_type")) == [
        ("1", "first"), ("2", "second"), ("3", "second")]


def test_events_with_facts(spark):
    mem = memory(spark)
    events = spark.createDataFrame(
        [(1, "launch", None), (2, " ", None), (3, "bad end", "soon"), (4, "over", "2020-01-01 00:00:00"),
         (5, "over but empty", "2020-01-01 00:00:00")], "event_no long, label string, expires_at string"
    ).select("event_no", "label", F.lit("2026-01-01").alias("event_date"), F.lit("").alias("event_type"),
             F.lit(None).cast("string").alias("context"), "expires_at")
    attached = facts(spark, *[{"batch_id": i, "entity": "A", "observation": f"{i}"} for i in (1, 2, 3, 4)])
    write = writes.remember_event(mem, events, attached.withColumnRenamed("batch_id", "event_no"), NOW)
    assert sorted(values(write.result, "event_no", "event_id", "observations_attached")) == [(1, 1, 1), (5, 2, 0)]
    assert values(write.appended["observations"], "event_id", "content") == [(1, "1")]


def edges(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "seq long, from string, to string, relation_type string, context string")


def test_relations_are_written_once_and_need_two_ends(spark):
    mem = memory(spark)
    write = writes.relate(mem, edges(
        spark, ("A", "B", "knows", "first"), ("a", "b", "knows", "second"), ("X", " x ", "is", None),
        ("B", "A", "knows", ""), ("A", "", "knows", None)), NOW)
    assert sorted(values(write.result, "seq", "created")) == [(0, True), (1, False), (3, True)]
    assert sorted(values(write.memory.relations, "id", "from_entity_id", "to_entity_id", "context")) == [
        (1, 1, 2, "first"), (2, 2, 1, None)]
    assert write.memory.entities.count() == 2


def test_forget_and_revive_an_entity(spark):
    mem = memory(
        spark, entities=[ent(1, "Z"), ent(2, "Y")], observations=[obs(1, 1, "x"), obs(2, 2, "y")],
        relations=[{"id": 1, "from_entity_id": 1, "to_entity_id": 2, "relation_type": "knows"}],
        embeddings=[{"observation_id": 1, "provider": "p", "endpoint_key": "k", "model_id": "m",
                     "dimensions": 1, "embedding": [1.0]}])
    names = spark.createDataFrame([("z",), ("nobody",)], "name string")
    write = writes.forget_entities(mem, names, NOW)
    assert sorted(values(write.result, "name", "deleted")) == [("nobody", False), ("z", True)]
    assert write.memory.relations.count() == 0 and write.memory.embeddings.count() == 0
    again = writes.remember_batch(write.memory, facts(spark, ("Z", "back")), NOW).memory
    graph = views.entity_graph(spark.createDataFrame([("Z",)], "name string"), again, NOW, 12)
    assert values(graph, "section", "content") == [("observation", "back")]
    assert values(writes.forget_entities(write.memory, names.limit(1), NOW).result, "deleted") == [(False,)]


def test_forget_rows(spark):
    mem = memory(
        spark, entities=[ent(1, "A"), ent(2, "Gone", deleted_at=NOW)],
        observations=[obs(1, 1, "x", superseded_by=9), obs(2, 1, "y", deleted_at=OLDER), obs(3, 2, "left over")])
    write = writes.forget_observations(mem, spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), NOW)
    assert sorted(values(write.result, "id", "deleted")) == [(1, True), (2, False), (3, False), (4, False)]
    assert sorted(values(write.memory.observations, "id", "deleted_at")) == [(1, NOW), (2, OLDER), (3, NOW)]


OLDER = ago(days=3)


def copies(spark, **more):
    return memory(
        spark, entities=[ent(1, "A"), ent(2, "B")],
        observations=[obs(1, 1, "same", created_at=ago(hours=2)), obs(2, 1, "same", created_at=ago(hours=1)),
                      obs(3, 2, "same"), obs(4, 1, "else", created_at=ago(days=45)), *more.pop("also", [])], **more)


def test_the_newest_copy_is_kept(spark):
    proposal = cleanup.propose_duplicates(copies(spark), NOW)
    assert values(proposal.groups, "entity_name", "target_id", "source_count") == [("A", 2, 1)]
    assert values(proposal.sources, "source_id") == [(1,)]


def test_texts_are_not_dealt_by_entity(spark, monkeypatch, capsys):
    """Digests are taken before any join: one entity may hold most of the texts."""
    seen, write = {}, cleanup.materialize

    def noted(df, label, **more):
        capsys.readouterr()
        df.explain("extended")
        seen[label] = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
        return write(df, label, **more)

    monkeypatch.setattr(cleanup, "materialize", noted)
    cleanup.propose_duplicates(copies(spark), NOW)
    lines = seen["digests"].splitlines()
    joins = [k for k, line in enumerate(lines) if "Join " in line]
    assert joins and all(k > max(joins) for k, line in enumerate(lines) if "sha2(" in line)
    assert any("sha2(" in line for line in lines)


def test_old_copies_of_recent_entities_count(spark):
    mem = copies(spark, also=[obs(5, 1, "same", created_at=ago(days=400))])
    proposal = cleanup.propose_duplicates(mem, NOW, since_days=1)
    assert sorted(values(proposal.sources, "source_id")) == [(1,), (5,)]


def test_proposals_look_at_the_given_instant(spark):
    mem = memory(
        spark, entities=[ent(1, "A")], events=[{"id": 1, "label": "e", "expires_at": ago(minutes=90)}],
        observations=[obs(i, 1, "same", event_id=1, created_at=ago(hours=5)) for i in (1, 2)])
    assert cleanup.propose_duplicates(mem, ago(hours=2)).groups.count() == 1
    assert cleanup.propose_duplicates(mem, NOW).groups.count() == 0


def test_too_many_entities(spark):
    with pytest.raises(ValueError):
        cleanup.entity_signals(copies(spark), NOW, max_entities=0)


def state(mem):
    return sorted(values(mem.observations, *mem.observations.columns), key=lambda r: r[0])


def test_apply_then_rollback_restores_every_row(spark):
    mem = copies(spark)
    applied = cleanup.apply_duplicates(mem, NOW).memory
    assert [r[0] for r in values(applied.observations.filter("superseded_by = 2"), "id")] == [1]
    undone = cleanup.rollback_run(applied, 1, ago(hours=-1)).memory
    assert state(undone) == state(mem)
    assert values(undone.runs.orderBy("id"), "id", "mode", "supersessions_applied") == [
        (1, "apply", 1), (2, "rollback", 1)]
    with pytest.raises(cleanup.CleanupRefused):
        cleanup.rollback_run(undone, 1, NOW)
    with pytest.raises(cleanup.CleanupRefused):
        cleanup.rollback_run(applied, 1, NOW, scope="other")
    with pytest.raises(cleanup.CleanupRefused):
        cleanup.rollback_run(applied, 7, NOW)


@pytest.mark.parametrize("change, reason", [
    ({"rationale": "mine"}, "rationale"), ({"content_snapshot": "other"}, "target content"),
    ({"similarity": 0.5}, "similarity"), ({"entity_id": None}, "no entity")])
def test_tampered_decisions_are_refused(spark, change, reason):
    applied = cleanup.apply_duplicates(copies(spark), NOW).memory
    decisions = applied.decisions
    for name, value in change.items():
        decisions = decisions.withColumn(name, F.lit(value).cast(decisions.schema[name].dataType))
    with pytest.raises(cleanup.CleanupRefused) as error:
        cleanup.rollback_run(applied.with_tables(decisions=decisions), 1, NOW)
    assert reason in {r[0] for r in values(error.value.violations, "reason")}


def test_tampered_sources_and_stale_proposals_are_refused(spark):
    mem = copies(spark)
    applied = cleanup.apply_duplicates(mem, NOW).memory
    extra = applied.decision_sources.unionByName(
        spark.createDataFrame([(1, 3)], "decision_id long, source_obs_id long"))
    with pytest.raises(cleanup.CleanupRefused):
        cleanup.rollback_run(applied.with_tables(decision_sources=extra), 1, NOW)
    proposal = cleanup.propose_duplicates(mem, NOW)
    changed = writes.forget_observations(mem, spark.createDataFrame([(1,)], "id long"), NOW).memory
    with pytest.raises(cleanup.CleanupRefused):
        cleanup.apply_duplicates(changed, NOW, proposal=proposal)


def test_orphans_are_found(spark):
    mem = memory(spark, entities=[ent(1, "A"), ent(2, "a")], observations=[obs(1, 999999, "x")])
    assert sorted(values(integrity.integrity_violations(mem), "rule", "id")) == [
        ("duplicate_name", 2), ("orphan_entity", 1)]


def test_store_versions_batches_and_conflicts(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(store.StoreError):
        store.load_memory(spark, root)
    assert store.publish(spark, root, "global", memory(spark, entities=[ent(1, "A")])) == 1
    write = writes.remember_batch(store.load_memory(spark, root), facts(spark, ("A", "x")), NOW)
    assert store.publish(spark, root, "global", write, expected=1, batch="b1") == 2
    assert store.publish(spark, root, "global", write, batch="b1") == 2
    with pytest.raises(store.StoreError):
        store.publish(spark, root, "global", write, expected=1)
    loaded = store.load_memory(spark, root)
    assert values(loaded.observations, "id", "content") == [(1, "x")]
    with pytest.raises(store.StoreError):
        store.load_memory(spark, root, "/some/project")
    with pytest.raises(store.StoreError):
        store.snapshot_export(loaded, root, NOW, source=root)


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    store.publish(spark, root, "global", memory(spark))
    rows = facts(spark, ("A", "x"), ("A", "x"), ("B", "y"))
    rows.write.parquet(source)
    for attempt in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        # A fresh checkpoint is what a lost one looks like: facts come again.
        ingest_stream(stream, root, str(tmp_path / f"checkpoint{attempt}"), NOW).awaitTermination()
    assert sorted(values(store.load_memory(spark, root).observations, "id", "content")) == [(1, "x"), (2, "y")]


def test_a_failed_publish_can_be_repeated(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    mem = memory(spark, entities=[ent(1, "A")])
    calls, shaped = [], store._shaped

    def breaking(df, table):
        calls.append(table)
        if len(calls) == 3:
            raise OSError("disk")
        return shaped(df, table)

    monkeypatch.setattr(store, "_shaped", breaking)
    with pytest.raises(OSError):
        store.publish(spark, root, "global", mem)
    with pytest.raises(store.StoreError):
        store.load_memory(spark, root)
    assert store.publish(spark, root, "global", mem) == 1
    assert values(store.load_memory(spark, root).entities, "id") == [(1,)]
    for _ in range(2):
        assert store.snapshot_export(mem, str(tmp_path / "copy"), NOW).count() > 0


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    root = str(tmp_path)
    present = store.read_manifest(spark, root, "global")
    one = store.Manifest(present.version + 1, {"entities": ["entities/a"]}, {})
    assert store._commit(spark, root, "global", one) == 1
    with pytest.raises(store.StoreError):
        store._commit(spark, root, "global", store.Manifest(1, {"entities": ["entities/b"]}, {}))
    assert store.read_manifest(spark, root, "global") == one
    assert [n for n in store._manifests(spark, root, "global").names() if "draft" in n] == []


def test_the_manifest_stays_small_over_many_batches(spark, tmp_path):
    root = str(tmp_path)
    store.publish(spark, root, "global", memory(spark))
    none = store.load_memory(spark, root)
    for k in range(200):
        change = Write(memory=none, result=none.entities)
        store.publish(spark, root, "global", change, batch=f"stream#{k}")
    manifest = store.read_manifest(spark, root, "global")
    assert manifest.version == 201 and manifest.batches == {"stream": 199}
    assert store.publish(spark, root, "global", change, batch="stream#5") == 201
    for k in range(4):
        grown = Write(memory=none, result=none.entities, appended={"entities": memory(spark, entities=[ent(k, f"E{k}")]).entities})
        store.publish(spark, root, "global", grown, batch=f"stream#{200 + k}")
    assert store.compact(spark, root, most=3) == 206 == store.compact(spark, root, most=3)
    assert len(store.read_manifest(spark, root, "global").tables["entities"]) == 1
    assert sorted(values(store.load_memory(spark, root).entities, "id")) == [(k,) for k in range(4)]


@pytest.mark.parametrize("name", ["usage_stream", "ingest_stream"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    from factfade.plans import all_queries

    source = "/root/testdata/sf0.001"
    for table in ("events", "conversations", "documents"):
        df = spark.read.parquet(f"{source}/{table}.parquet")
        df.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    query = all_queries()[name]
    assert query(spark, str(tmp_path)).count() == query(spark, source).count() > 0


def test_old_tables_are_brought_up(spark):
    old = spark.createDataFrame([(1, "A")], "id long, name string")
    new = shape.conform_schema(old, "entities", NOW)
    assert values(new, "id", "entity_type", "created_at", "updated_at") == [(1, None, NOW, NOW)]
    stamps = spark.createDataFrame([(1, OLDER)], "version int, applied_at timestamp_ntz")
    after = shape.stamp_versions(stamps, NOW, log=True)
    assert sorted(values(after, "version", "applied_at")) == [(1, OLDER), (2, NOW), (3, NOW)]


def test_paths(spark):
    cases = {"": "global", "/abs/x": "/abs/x", "~": "/home/me", "~/a//b/": "/home/me/a/b",
             "a/../b": "/home/me/b", "../../..": "/", "~x": "/home/me/~x"}
    df = spark.createDataFrame([(c,) for c in cases], "project string")
    assert dict(values(shape.route_scope(df, "/home/me"), "project", "scope")) == cases


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aAbB"), st.sampled_from(["x", "y", "z"]),
                          st.sampled_from([None, "k1", "k2"])), min_size=1, max_size=12))
def test_batches_equal_writing_one_by_one(spark, rows):
    entities, types, stored, want = {}, {}, {}, []
    for name, content, kind in rows:
        key = entities.setdefault(name.lower(), len(entities) + 1)
        types[key] = kind or types.get(key)
        new = (key, content) not in stored
        if new:
            stored[key, content] = (len(stored) + 1, types[key])
        want.append((len(want), key, stored[key, content][0], new))
    write = writes.remember_batch(
        memory(spark),
        facts(spark, *[{"entity": n, "observation": c, "entity_type": k} for n, c, k in rows]), NOW)
    assert sorted(values(write.result, "seq", "entity_id", "obs_id", "inserted")) == want
    assert sorted(values(write.appended["observations"], "id", "entity_type")) == sorted(stored.values())


def test_hints_read_entities_that_are_worked_out_once(spark, monkeypatch):
    seen = []
    real = writes.conflict_hints

    def watched(owned, mem, *rest):
        seen.append(mem.entities._jdf.queryExecution().optimizedPlan().toString())
        return real(owned, mem, *rest)

    monkeypatch.setattr(writes, "conflict_hints", watched)
    mem = memory(spark, entities=[ent(1, "A")], observations=[obs(1, 1, "some old words")])
    writes.remember(mem, facts(spark, ("a", "some new words"), ("B", "y")), NOW, 12)
    assert len(seen) == 1 and "Join" not in seen[0] and "Window" not in seen[0]
