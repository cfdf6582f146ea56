import math

from build import NOW, ago, values
from pyspark.sql import functions as F

from factfade.functions import privacy, scoring, text, times, vectors
from factfade.session import configure


def one(spark, column, **inputs):
    cells = [F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cells).select(column.alias("r")).first()["r"]


def decay(spark, created_at, confidence=0.9, access=3, half_life=12):
    df = spark.createDataFrame([(created_at,)], "t timestamp_ntz")
    column = scoring.decayed_confidence(F.col("t"), F.lit(confidence), F.lit(access), half_life, NOW)
    return df.select(column.alias("r")).first()["r"]


def test_decay(spark):
    assert math.isclose(decay(spark, ago(weeks=8)), 0.9 * 0.5 ** (8 / 36), rel_tol=1e-12)
    assert decay(spark, ago(weeks=-1)) == 0.9
    assert decay(spark, None) == 0.9
    assert decay(spark, ago(weeks=8), half_life=0) == decay(spark, ago(weeks=8))
    assert decay(spark, ago(weeks=8), half_life=-1) == 0.9


def test_position_may_pass_the_last_place(spark):
    score = lambda p, n: one(spark, scoring.fts_position_score(F.lit(p), F.lit(n)))
    assert (score(0, 1), score(0, 3), score(2, 3), score(4, 3)) == (1.0, 1.0, 0.0, -1.0)


def test_snippets_count_characters(spark):
    cut = one(spark, text.compact_snippet(F.col("c")), c="a" * 200)
    assert len(cut["content"]) == 120 and cut["content"].endswith("…") and cut["truncated"]
    whole = one(spark, text.compact_snippet(F.col("c")), c="é" * 120)
    assert whole["content"] == "é" * 120 and not whole["truncated"]
    assert one(spark, text.truncate_ellipsis(F.col("c"), 5), c="abcdefgh") == "ab..."
    assert one(spark, text.truncate_ellipsis(F.col("c"), 0), c="abc") == ""


def test_terms_and_tokens(spark):
    assert one(spark, text.query_terms(F.col("c")), c=' say “hi”  "" 100/min ') == ["say", "hi", "100/min"]
    assert one(spark, text.raw_terms(F.col("c")), c=' say "" x y ') == ["say", '""', "x", "y"]
    assert one(spark, text.tokens(F.col("c")), c="Café, naïve 100/min Straße") == [
        "cafe", "naive", "100", "min", "straße"]
    assert one(spark, text.tokens(F.col("c")), c="Plain 100/min_x") == ["plain", "100", "min", "x"]
    assert one(spark, text.ascii_lower(F.col("c")), c="ÀBÇ") == "ÀbÇ"


def test_timestamps(spark):
    good = {
        "2026-01-02": "2026-01-02 00:00:00", "2026-01-02T03:04:05Z": "2026-01-02 03:04:05",
        "2026-01-02T03:04:05+02:30": "2026-01-02 00:34:05", "2026-01-02 03:04:05.5": "2026-01-02 03:04:05.5",
    }
    for written, want in good.items():
        got = one(spark, times.parse_timestamp(F.col("c")).cast("string"), c=written)
        assert got == want, written
    for written in ("2026", "2026-01-02 03:04", "2026-02-30", "soon", "2026-01-02 03:04:05Z", ""):
        assert one(spark, times.parse_timestamp(F.col("c")), c=written) is None, written
    assert one(spark, times.parse_expiry(F.col("c")), c="2026-01-02") is None
    assert one(spark, times.parse_expiry(F.col("c")).cast("string"), c=" 2026-01-02T03:04:05.9Z ") == "2026-01-02 03:04:05"


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.99, 0.01]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]),
         ([float("nan"), 1.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    got = [r[0] for r in values(df.select(vectors.cosine_similarity(F.col("a"), F.col("b")).alias("s")), "s")]
    assert math.isclose(got[0], 0.99 / math.hypot(0.99, 0.01), rel_tol=1e-6)
    assert got[1:] == [None] * 4


def test_summaries_hold_no_content(spark):
    args = '{"observation":"%s","facts":[1,2,3],"entity":{"a":1},"query":"secret","n":1.5}' % ("x" * 51)
    assert one(spark, privacy.sanitize_args(F.col("c")), c=args) == (
        '{"entity":"<redacted object>","facts":"<3 facts>","n":1.5,"observation":"<51 chars>","query":"secret"}')
    strict = one(spark, privacy.sanitize_args(F.col("c"), True), c=args)
    assert '"query":"sha256:' in strict and "secret" not in strict
    assert one(spark, privacy.sanitize_args(F.col("c")), c="no json") is None
    configure(spark)  # of a repeated key the last value counts
    twice, last = '{"entity":"a","entity":"b"}', '{"entity":"b"}'
    assert one(spark, privacy.sanitize_args(F.col("c")), c=last) == last
    assert one(spark, privacy.sanitize_args(F.col("c")), c=twice) == last
    result = '{"results":[{"a":1}],"total_facts":1,"found":null,"note":"secret","events":3}'
    assert one(spark, privacy.summarize_result(F.col("c")), c=result) == (
        '{"entity_groups":1,"found":null,"total_facts":1}')
    assert one(spark, privacy.hash_identifier(F.col("c")), c="") == ""
