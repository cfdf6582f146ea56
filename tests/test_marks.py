from datetime import timedelta

from build import NOW, ent, memory, obs, table
from pyspark.sql import functions as F

from factfade.operators import cleanup, search, writes
from factfade.operators.marks import Marks

LATER = NOW + timedelta(hours=1)


def store(spark, n=400):
    rows = [obs(k, 1 + k % 3, f"text {k % 150}") for k in range(1, n + 1)]
    rows[4]["deleted_at"] = NOW - timedelta(days=1)
    rows[6] |= {"access_count": 7, "last_accessed": NOW - timedelta(days=2)}
    mem = memory(
        spark, entities=[ent(1, "A"), ent(2, "B"), ent(3, "C", deleted_at=NOW)], observations=rows
    )
    vectors = [{"observation_id": k} for k in range(1, n + 1, 2)]
    return mem.with_tables(embeddings=table(spark, "embeddings", vectors))


def ids(spark, *some):
    return spark.createDataFrame([(k,) for k in some], "id long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_marks_give_what_rewriting_gives(spark, tmp_path):
    mem = plain = store(spark)
    marks = Marks.create(spark, str(tmp_path / "marks"))
    assert rows(marks.observations(mem.observations)) == rows(mem.observations)

    returned = ids(spark, 1, 1, 4, 5, 7, 2, 9999)
    marks.touch(mem, returned, NOW, 1)
    plain = plain.with_tables(observations=search.touch(plain, returned, NOW))

    asked = ids(spark, 1, 1, 2, 3, 5, 8888)  # 2: its entity is deleted, 5: deleted before
    told = marks.forget_observations(mem, asked, NOW, 2)
    write = writes.forget_observations(plain, asked, NOW)
    plain = write.memory
    assert rows(told) == rows(write.result)

    done = cleanup.apply_duplicates(plain, LATER)
    marks.supersede(cleanup.apply_duplicates(marks.memory(mem), LATER), LATER, 3)
    plain = done.memory

    more = ids(spark, 1, 4, 7, 400, 399, 399)  # 1: forgotten, 4 and 7: superseded
    marks.touch(mem, more, LATER, 4)
    plain = plain.with_tables(observations=search.touch(plain, more, LATER))

    after = marks.memory(mem)
    assert after.observations.schema == mem.observations.schema
    assert rows(after.observations) == rows(plain.observations)
    assert rows(after.embeddings.select("observation_id")) == rows(plain.embeddings.select("observation_id"))


def test_a_batch_again_leaves_the_same_state(spark, tmp_path):
    mem = store(spark)
    marks = Marks.create(spark, str(tmp_path / "marks"))
    marks.touch(mem, ids(spark, 1, 4), NOW, 1)
    told = rows(marks.forget_observations(mem, ids(spark, 1, 3), LATER, 2))
    state = rows(marks.observations(mem.observations))
    assert rows(marks.forget_observations(mem, ids(spark, 1, 3), LATER, 2)) == told
    marks.touch(mem, ids(spark, 1, 4), NOW, 1)
    assert rows(marks.observations(mem.observations)) == state


def test_only_the_marked_rows_are_written(spark, tmp_path):
    mem = store(spark)
    marks = Marks.create(spark, str(tmp_path / "marks"))
    marks.touch(mem, ids(spark, 1, 1, 4, 7, 3), NOW, 1)
    marks.forget_observations(mem, ids(spark, 10, 13), NOW, 2)
    assert marks.table("accesses").count() == 4 and marks.table("supersessions").count() == 0
    assert marks.table("removals").count() == 2
    read = marks.table("accesses", before=1)
    assert read.count() == 0 and "batch" in read.columns
    assert marks.observations(mem.observations.filter(F.lit(False))).count() == 0
    marks.touch(mem, ids(spark), NOW, 3)
    assert marks.table("accesses").count() == 4
