"""Similar observations by embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.functions import vectors
from factfade.operators import classes, similarity
from factfade.plans import inputs
from factfade.plans.cleaning import _SIGNALS
from factfade.plans.inputs import AS_OF
from factfade.plans.oracle_views import NOW, memory, only
from factfade.plans.registry import num, query, ts

THRESHOLD = 0.30
KEY = similarity.CacheKey("local", "http://localhost/v1", "model-a", 64)
MAX_OBS, MAX_PAIRS = 40, 25  # below the sizes of the labels, so that both bounds cut


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as observations of their label."""
    return inputs.embeddings(spark, sf_dir).select(
        F.col("observation_id").alias("obs_id"), "entity_id", "entity_name",
        F.lit("label").alias("entity_type"),
        F.concat(F.lit("vector "), F.col("observation_id").cast("string")).alias("content"),
        "embedding", "created_at",
    )


_KEPT = """,
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, obs_id DESC) AS age
         FROM m_embeddings) a WHERE age <= {n})"""


def _pairs(n: int) -> str:
    return only("m_embeddings") + _KEPT.format(n=n) + f""",
unit AS (SELECT obs_id, entity_id, entity_name, age, CAST(embedding AS DOUBLE[]) AS v FROM kept),
pair AS (
  SELECT t.entity_id, t.entity_name, t.obs_id AS target_obs_id, s.obs_id AS source_obs_id,
         list_inner_product(t.v, s.v) / (sqrt(list_inner_product(t.v, t.v)) * sqrt(list_inner_product(s.v, s.v))) AS similarity
  FROM unit t JOIN unit s ON s.entity_id = t.entity_id AND t.age < s.age),
good AS (SELECT * FROM pair WHERE similarity >= {THRESHOLD}),
best AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY similarity DESC, target_obs_id DESC, source_obs_id DESC) AS rn,
         count(*) OVER (PARTITION BY entity_id) AS pairs_found FROM good)"""


_A, _B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
_COSINE = (
    f"list_inner_product({_A}, {_B}) / "
    f"(sqrt(list_inner_product({_A}, {_A})) * sqrt(list_inner_product({_B}, {_B})))"
)


@query(
    "cosine_similarity",
    f"""
SELECT a.vec_id, b.vec_id AS next_id, {num(_COSINE)} AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one."""
    e = inputs.table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(
        "vec_id", (F.col("vec_id") + 1).alias("next_id"),
        vectors.cosine_similarity(F.col("embedding"), F.col("other")).alias("similarity"),
    )


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.embeddings(spark, sf_dir).filter("cached").select(
        "observation_id", "provider", "endpoint_key", "model_id", "dimensions", "embedding", "created_at"
    )


@query("embedding_hits", only("m_embeddings") + "SELECT obs_id, entity_id, embedding[1]::DOUBLE AS first FROM m_embeddings WHERE cached")
def embedding_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).drop("embedding")
    hits = similarity.embedding_hits(rows, _cache(spark, sf_dir), KEY)
    return hits.select("obs_id", "entity_id", F.col("embedding")[0].cast("double").alias("first"))


@query("embedding_misses", only("m_embeddings") + "SELECT obs_id, entity_id FROM m_embeddings WHERE NOT cached")
def embedding_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).drop("embedding")
    return similarity.embedding_misses(rows, _cache(spark, sf_dir), KEY).select("obs_id", "entity_id")


@query(
    "newest_per_entity_cap",
    only("m_embeddings") + _KEPT.format(n=MAX_OBS) + f"""
SELECT k.obs_id, k.entity_id, k.age, c.active, least(c.active, {MAX_OBS}) AS considered,
       greatest(c.active - {MAX_OBS}, 0) AS omitted
FROM kept k JOIN (SELECT entity_id, count(*) AS active FROM m_embeddings GROUP BY entity_id) c ON c.entity_id = k.entity_id""",
)
def newest_per_entity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, counts = similarity.cap_newest(_rows(spark, sf_dir), MAX_OBS)
    return kept.select("obs_id", "entity_id", "age").join(counts.drop("entity_name"), "entity_id")


@query(
    "same_entity_pairs",
    _pairs(200) + f"SELECT target_obs_id, source_obs_id, {num('similarity')} AS similarity FROM good",
)
def same_entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = similarity.cap_newest(_rows(spark, sf_dir))
    return similarity.same_entity_pairs(kept, THRESHOLD).select(
        "target_obs_id", "source_obs_id", "similarity"
    )


@query(
    "candidate_cap_per_entity",
    _pairs(200) + f"""
SELECT entity_id, target_obs_id, source_obs_id, {num('similarity')} AS similarity, pairs_found
FROM best WHERE rn <= 5""",
)
def candidate_cap_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = similarity.cap_newest(_rows(spark, sf_dir))
    pairs = similarity.same_entity_pairs(kept, THRESHOLD)
    return similarity.cap_pairs(pairs, 5).drop("entity_name")


@query(
    "semantic_candidates",
    _pairs(200) + f"""
SELECT entity_id, entity_name, 'label' AS entity_type, target_obs_id, source_obs_id, {num('similarity')} AS similarity,
       pairs_found, concat('vector ', target_obs_id) AS target_content, concat('vector ', source_obs_id) AS source_content,
       {ts('t.created_at')} AS target_created_at, {ts('s.created_at')} AS source_created_at
FROM best JOIN (SELECT obs_id, created_at FROM m_embeddings) t ON t.obs_id = target_obs_id
JOIN (SELECT obs_id, created_at FROM m_embeddings) s ON s.obs_id = source_obs_id WHERE rn <= 100""",
)
def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.semantic_candidates(_rows(spark, sf_dir), THRESHOLD)


@query(
    "entity_limits",
    _pairs(MAX_OBS).replace(f"similarity >= {THRESHOLD}", "similarity >= 0.15") + f"""
SELECT * FROM (
  SELECT c.entity_id, c.entity_name, c.active, least(c.active, {MAX_OBS}) AS considered,
         greatest(c.active - {MAX_OBS}, 0) AS omitted, least(coalesce(p.n, 0), {MAX_PAIRS}) AS pairs_returned,
         greatest(coalesce(p.n, 0) - {MAX_PAIRS}, 0) AS pairs_omitted
  FROM (SELECT entity_id, entity_name, count(*) AS active FROM m_embeddings GROUP BY entity_id, entity_name) c
  LEFT JOIN (SELECT entity_id, count(*) AS n FROM good GROUP BY entity_id) p ON p.entity_id = c.entity_id) x
WHERE omitted > 0 OR pairs_omitted > 0""",
)
def entity_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    _, counts = similarity.cap_newest(rows, MAX_OBS)
    return similarity.entity_limits(
        counts, similarity.semantic_candidates(rows, 0.15, MAX_OBS, MAX_PAIRS)
    )


# Components by walking from every row to all it reaches.
_COMPONENTS = _pairs(200).replace("WITH ", "WITH RECURSIVE ", 1) + """,
edge AS (SELECT entity_id, entity_name, target_obs_id AS a, source_obs_id AS b, similarity FROM best WHERE rn <= 100),
both_ways AS (SELECT entity_id, a, b FROM edge UNION SELECT entity_id, b, a FROM edge),
reach AS (SELECT entity_id, a AS start, a AS seen FROM both_ways
          UNION SELECT r.entity_id, r.start, e.b FROM reach r JOIN both_ways e ON e.entity_id = r.entity_id AND e.a = r.seen),
label AS (SELECT entity_id, start AS node, min(seen) AS label FROM reach GROUP BY entity_id, start),
clu AS (
  SELECT l.entity_id, l.label, min(e.entity_name) AS entity_name, count(*) AS pairs, max(similarity) AS max_sim,
         avg(similarity) AS avg_sim,
         arg_max(concat('vector ', e.a, ' / vector ', e.b), similarity) AS hint
  FROM edge e JOIN label l ON l.entity_id = e.entity_id AND l.node = e.a GROUP BY l.entity_id, l.label),
num AS (SELECT *, row_number() OVER (ORDER BY max_sim DESC, avg_sim DESC, entity_name, label) AS cluster FROM clu)"""


@query(
    "semantic_clusters",
    _COMPONENTS + f"""
SELECT cluster, entity_name, (SELECT count(*) FROM label l WHERE l.entity_id = num.entity_id AND l.label = num.label) AS n_obs,
       pairs, {num('max_sim')} AS max_sim, {num('avg_sim')} AS avg_sim, hint FROM num""",
)
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = similarity.semantic_clusters(
        similarity.semantic_candidates(_rows(spark, sf_dir), THRESHOLD)
    )
    return clusters


@query(
    "cluster_stats",
    _COMPONENTS + f"""
SELECT cluster, pairs, {num('max_sim')} AS max_sim, {num('avg_sim')} AS avg_sim,
       (SELECT count(*) FROM label l WHERE l.entity_id = num.entity_id AND l.label = num.label) AS n_obs,
       label AS first_obs_id FROM num""",
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = similarity.semantic_candidates(_rows(spark, sf_dir), THRESHOLD)
    _, members = similarity.semantic_clusters(candidates)
    return similarity.cluster_stats(candidates, members)


@query(
    "cluster_members",
    _COMPONENTS + """
SELECT num.cluster, l.node AS obs_id FROM num JOIN label l ON l.entity_id = num.entity_id AND l.label = num.label""",
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = similarity.semantic_clusters(
        similarity.semantic_candidates(_rows(spark, sf_dir), THRESHOLD)
    )
    return members


@query(
    "cluster_hint",
    """
WITH c AS (SELECT conv_id, turn, trim(text, E' \\n\\t\\r') AS t FROM conversations)
SELECT a.conv_id, a.turn, concat(CASE WHEN length(a.t) > 48 THEN concat(substr(a.t, 1, 45), '...') ELSE a.t END, ' / ',
  CASE WHEN length(b.t) > 48 THEN concat(substr(b.t, 1, 45), '...') ELSE b.t END) AS hint
FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def cluster_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints for each turn and the one after it."""
    c = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", similarity.cluster_hint(F.col("text"), F.col("other")).alias("hint")
    )


@query(
    "semantic_selection",
    memory("lang") + _SIGNALS + f"""
SELECT l.id AS obs_id, l.entity_id, e.name AS entity_name, l.entity_type, l.content, l.source,
       {num('l.confidence')} AS confidence, l.event_id, {ts('l.created_at')} AS created_at
FROM liv l JOIN sig ON sig.entity_id = l.entity_id JOIN ent e ON e.id = l.entity_id""",
)
def semantic_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.semantic_selection(inputs.lang_memory(spark, sf_dir), AS_OF)


@query(
    "decode_vectors",
    f"""
SELECT vec_id, CASE vec_id % 5 WHEN 3 THEN 'invalid length' WHEN 4 THEN 'dimension mismatch' END AS reason,
       CASE WHEN vec_id % 5 < 3 THEN {num('list_sum(CAST(embedding AS DOUBLE[]))')} END AS total FROM embeddings""",
)
def decode_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as bytes and read back; some bytes are cut off."""
    e = inputs.table(spark, sf_dir, "embeddings")
    encoded = similarity.encode_vectors(e.select("vec_id", "embedding"))
    kind = F.col("vec_id") % 5
    cut = F.when(kind == 3, F.substring("blob", 1, 7)).when(kind == 4, F.substring("blob", 1, 8))
    good, bad = similarity.decode_vectors(
        encoded.withColumn("blob", F.coalesce(cut, F.col("blob"))), 64
    )
    total = F.aggregate(
        F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    return good.select("vec_id", F.lit(None).cast("string").alias("reason"), total.alias("total")).unionByName(
        bad.select("vec_id", "reason", F.lit(None).cast("double").alias("total"))
    )


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A toy embedder: how often each of eight letters occurs, and a constant."""
    return [[float(t.count(c)) for c in "aeinorst"] + [1.0] for t in texts]


_LETTERS = "[" + ", ".join(
    f"CAST(length(content) - length(replace(content, '{c}', '')) AS DOUBLE)" for c in "aeinorst"
) + ", 1.0]"


@query(
    "embed_missing",
    f"""
SELECT obs_id, list_sum(v) AS total, v[1] AS first FROM (
  SELECT conv_id * 100 + turn AS obs_id, {_LETTERS.replace('content', 'text')} AS v FROM conversations) x""",
)
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    misses = inputs.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("obs_id"), F.col("text").alias("content")
    )
    made = similarity.embed_missing(misses, letter_counts, 9)
    total = F.aggregate(
        F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    return made.select(
        "obs_id", total.alias("total"), F.col("embedding")[0].cast("double").alias("first")
    )


@query(
    "upsert_embeddings",
    f"""
SELECT vec_id + 1 AS observation_id, CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS first,
       {ts(f"CASE WHEN vec_id % 2 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '1' HOUR * CAST(vec_id % 500 AS INT) ELSE {NOW} END")} AS created_at
FROM embeddings WHERE vec_id % 2 = 1 OR vec_id % 3 = 0""",
)
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors are cached; every third is written, with its sign turned."""
    e = inputs.table(spark, sf_dir, "embeddings")
    new = e.filter(F.col("vec_id") % 3 == 0).select(
        (F.col("vec_id") + 1).alias("obs_id"), F.transform("embedding", lambda x: -x).alias("embedding")
    )
    after = similarity.upsert_embeddings(_cache(spark, sf_dir), new, KEY, AS_OF)
    return after.select(
        "observation_id", F.col("embedding")[0].cast("double").alias("first"), "created_at"
    )


_REPORT_THRESHOLD = 0.999

_REPORT = memory("lang") + _SIGNALS + f""",
kept AS (SELECT * FROM (
  SELECT l.id, l.entity_id, e.name AS entity_name, l.content, row_number() OVER (PARTITION BY l.entity_id ORDER BY l.created_at DESC, l.id DESC) AS age
  FROM liv l JOIN sig ON sig.entity_id = l.entity_id JOIN ent e ON e.id = l.entity_id) a WHERE age <= 200),
unit AS (SELECT *, {_LETTERS} AS v FROM kept),
pair AS (SELECT t.entity_id, t.entity_name, t.id AS target_obs_id, s.id AS source_obs_id,
    list_inner_product(t.v, s.v) / (sqrt(list_inner_product(t.v, t.v)) * sqrt(list_inner_product(s.v, s.v))) AS similarity
  FROM unit t JOIN unit s ON s.entity_id = t.entity_id AND t.age < s.age AND s.content <> t.content),
best AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS pairs_found,
   row_number() OVER (PARTITION BY entity_id ORDER BY round(similarity, 12) DESC, target_obs_id DESC, source_obs_id DESC) AS rn
  FROM pair WHERE similarity >= {_REPORT_THRESHOLD})"""


@query(
    "semantic_report",
    _REPORT + f"""
SELECT entity_name, count(*) AS pairs, max(pairs_found) AS pairs_found, {num('max(similarity)')} AS max_sim,
       {num('min(similarity)')} AS min_sim FROM best WHERE rn <= 100 GROUP BY entity_name""",
)
def semantic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, embedded by counting letters."""
    from factfade.schemas import TABLES

    cache = inputs.configure(spark).createDataFrame([], TABLES["embeddings"])
    mem = inputs.lang_memory(spark, sf_dir).with_tables(embeddings=cache)
    report = similarity.semantic_report(
        mem, letter_counts, similarity.CacheKey("local", "letters", "count", 9), AS_OF,
        threshold=_REPORT_THRESHOLD,
    )
    return report["candidates"].groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("pairs_found").alias("pairs_found"),
        F.max("similarity").alias("max_sim"), F.min("similarity").alias("min_sim"),
    )


# Classes by walking from every row to all it reaches, over all rows of an entity.
_CLASSES = """
both_ways AS (SELECT entity_id, a, b FROM edge UNION SELECT entity_id, b, a FROM edge),
reach AS (SELECT entity_id, a AS start, a AS seen FROM both_ways
          UNION SELECT r.entity_id, r.start, e.b FROM reach r JOIN both_ways e ON e.entity_id = r.entity_id AND e.a = r.seen),
label AS (SELECT entity_id, start AS obs_id, min(seen) AS class_id, count(*) AS n_obs FROM reach GROUP BY entity_id, start)"""

_ALL_PAIRS = only("m_embeddings").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
unit AS (SELECT obs_id, entity_id, entity_name, CAST(embedding AS DOUBLE[]) AS v FROM m_embeddings),
edge AS (
  SELECT t.entity_id, t.obs_id AS a, s.obs_id AS b FROM unit t JOIN unit s
  ON s.entity_id = t.entity_id AND t.obs_id < s.obs_id
  WHERE list_inner_product(t.v, s.v) / (sqrt(list_inner_product(t.v, t.v)) * sqrt(list_inner_product(s.v, s.v))) >= {THRESHOLD}),"""


@query(
    "semantic_classes",
    _ALL_PAIRS + _CLASSES + """
SELECT l.entity_id, u.entity_name, l.obs_id, l.class_id, l.n_obs FROM label l JOIN unit u ON u.obs_id = l.obs_id""",
)
def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of each label, without the bounds of the candidates."""
    return classes.semantic_classes(_rows(spark, sf_dir), THRESHOLD)


_REPORT_ALL = memory("lang").replace("WITH ", "WITH RECURSIVE ", 1) + _SIGNALS + f""",
unit AS (
  SELECT l.id, l.entity_id, e.name AS entity_name, l.content, {_LETTERS.replace('content', 'l.content')} AS v
  FROM liv l JOIN sig ON sig.entity_id = l.entity_id JOIN ent e ON e.id = l.entity_id),
edge AS (
  SELECT t.entity_id, t.id AS a, s.id AS b FROM unit t JOIN unit s
  ON s.entity_id = t.entity_id AND t.id < s.id AND s.content <> t.content
  WHERE list_inner_product(t.v, s.v) / (sqrt(list_inner_product(t.v, t.v)) * sqrt(list_inner_product(s.v, s.v))) >= {_REPORT_THRESHOLD}),"""


@query(
    "semantic_report_classes",
    _REPORT_ALL + _CLASSES + """
SELECT u.entity_name, l.obs_id, l.class_id, l.n_obs FROM label l JOIN unit u ON u.id = l.obs_id""",
)
def semantic_report_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language, embedded by counting letters."""
    from factfade.schemas import TABLES

    cache = inputs.configure(spark).createDataFrame([], TABLES["embeddings"])
    mem = inputs.lang_memory(spark, sf_dir).with_tables(embeddings=cache)
    report = similarity.semantic_report_classes(
        mem, letter_counts, similarity.CacheKey("local", "letters", "count", 9), AS_OF,
        threshold=_REPORT_THRESHOLD,
    )
    return report["classes"].select("entity_name", "obs_id", "class_id", "n_obs")
