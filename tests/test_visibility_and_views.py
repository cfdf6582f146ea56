from build import NOW, ago, ent, memory, obs, values
from pyspark.sql import functions as F

from factfade.operators import visibility, views
from factfade.operators.ordering import number_rows, with_previous


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "event_id long")


def test_an_event_ends_at_its_expiry(spark):
    mem = memory(spark, events=[
        {"id": 1, "label": "open"}, {"id": 2, "label": "now", "expires_at": NOW},
        {"id": 3, "label": "later", "expires_at": ago(seconds=-1)},
    ])
    assert sorted(values(visibility.active_events(mem.events, NOW), "id")) == [(1,), (3,)]


def test_hidden_rows_stay_hidden_everywhere(spark):
    mem = memory(
        spark,
        entities=[ent(1, "A"), ent(2, "Gone", deleted_at=NOW)],
        events=[{"id": 5, "label": "e", "event_date": "2026-01-01"},
                {"id": 6, "label": "ended", "expires_at": ago(days=1)}],
        observations=[
            obs(1, 1, "superseded", event_id=5, superseded_by=2), obs(2, 1, "active", event_id=5),
            obs(3, 1, "deleted", deleted_at=NOW), obs(4, 1, "ended", event_id=6),
            obs(5, 1, "dangling", event_id=99), obs(6, 2, "owner gone"), obs(7, 1, "plain"),
            # The target of this one is deleted: neither is visible.
            obs(8, 1, "orphaned", superseded_by=3),
        ],
    )
    live = {r[0] for r in values(visibility.live_observations(mem, NOW), "id")}
    assert live == {2, 7}
    assert values(views.event_counts(mem, NOW), "id", "observation_count") == [(5, 1)]
    assert values(views.full_event(ids(spark, 5, 6), mem, NOW, 12), "event_id", "id") == [(5, 2)]
    assert values(views.event_observations(ids(spark, 5, 6), mem, NOW, 12), "id") == [(2,)]
    request = spark.createDataFrame([(1, i, i) for i in range(9)], "req_id int, pos int, id long")
    assert values(views.observations_by_id(request, mem, NOW, 12), "id") == [(2,), (7,)]
    assert values(views.observation_totals(mem, NOW), "*") == [(8, 1, 2, 3)]


def test_labels_match_literally(spark):
    labels = ["rain at 7% today", "rain at 70 today", "blue_door key", "blue door key",
              r"left\right turn", "left/right turn"]
    mem = memory(spark, events=[{"id": i, "label": t} for i, t in enumerate(labels)])
    for text, want in (("7%", 0), ("BLUE_door", 2), ("left\\right", 4)):
        found = visibility.event_filters(mem.events, query=text)
        assert values(found, "id") == [(want,)]


def test_dates_compare_as_text_and_missing_dates_drop_out(spark):
    mem = memory(spark, events=[
        {"id": 1, "label": "a", "event_date": "2025-04-01"},
        {"id": 2, "label": "b", "event_date": "2025-04-01T10:00"}, {"id": 3, "label": "c"},
    ])
    assert values(views.event_counts(mem, NOW, date_to="2025-04-01"), "id") == [(1,)]
    assert values(views.event_counts(mem, NOW), "id") == [(2,), (1,), (3,)]


def test_entities_without_facts_or_edges_are_not_listed(spark):
    mem = memory(
        spark,
        entities=[ent(1, "Bare"), ent(2, "Edge", updated_at=NOW), ent(3, "Other")],
        relations=[{"id": 1, "from_entity_id": 2, "to_entity_id": 3, "relation_type": "knows"}],
    )
    assert values(views.list_entities(mem, NOW), "name", "observation_count") == [
        ("Edge", 0), ("Other", 0)]
    names = spark.createDataFrame([("bare",), ("edge",)], "name string")
    graph = views.entity_graph(names, mem, NOW, 12)
    assert values(graph, "entity_name", "section", "other_name") == [("Edge", "outgoing", "Other")]


def test_requests_keep_order_and_first_position(spark):
    mem = memory(spark, entities=[ent(1, "A")],
                 observations=[obs(1, 1, "x", deleted_at=NOW), obs(2, 1, "y"), obs(3, 1, "z")])
    request = spark.createDataFrame(
        [(1, 0, 3), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, -5)], "req_id int, pos int, id long")
    found = views.observations_by_id(request, mem, NOW, 12)
    assert values(found, "id") == [(3,), (2,)]
    assert values(views.request_totals(request, found), "requested", "total") == [(3, 2)]


def test_numbers_are_dense_and_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = sorted(values(number_rows(df, [F.desc("v")], "n"), "n", "v"))
    assert rows == [(i + 1, 999 - i) for i in range(1000)]


def test_previous_values_cross_slices(spark):
    rows = [("a", i, f"v{i}" if i % 3 == 0 else None) for i in range(20)] + [("b", 5, "x"), ("b", 17, None)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = values(with_previous(df, ["k"], F.floor(F.col("t") / 4), ["t"], F.col("v")), "k", "t", "previous")
    for k, t, previous in got:
        earlier = [v for kk, tt, v in rows if kk == k and tt < t and v is not None]
        assert previous == (earlier[-1] if earlier else None)
