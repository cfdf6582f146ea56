"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); all but the last give back rows with the
columns of ``documents``.  NULL texts count as empty and NULL ids as ids of their own;
repeated rows, empty tables and further columns are fine in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.llm import queries as q
from factfade.llm.exact import deduplicate, split_by_age
from factfade.llm.mixing import mix
from factfade.llm.nearcopies import near_copies
from factfade.llm.packing import pack_documents
from factfade.llm.quality import QualityModel
from factfade.llm.simhash import removed
from factfade.session import configure, materialize

LEAST_QUALITY = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = QualityModel.fit(docs, q.table(spark, sf_dir, "labels"))
    score = _free(docs, "_score")
    return model.score(docs, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id."""
    found = materialize(deduplicate(*split_by_age(docs)), "exact-groups")
    digest, away_id, away_digest = (_free(docs, c) for c in ("_digest", "_away_id", "_away_digest"))
    away = found.filter(~F.col("kept")).select(
        F.col("doc_id").alias(away_id), F.col("text_sha256").alias(away_digest)
    )
    rows = docs.withColumn(digest, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    if found.count() < docs.count():  # a row that is repeated whole stays once
        rows = rows.dropDuplicates(["doc_id", digest])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(away_id)) & (
        F.col(digest) == F.col(away_digest)
    )
    return rows.join(away, same, "left_anti").drop(digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Links are those of op7 (4 of 64 bits over four-word shingles) and an estimated Jaccard
    similarity of 0.8 over five-word shingles (SimHash of 512 bits).
    """
    away_id, away_hash = _free(docs, "_away_id"), _free(docs, "_away_hash")
    away = materialize(removed(near_copies(docs)), "near-copies").select(
        F.col("doc_id").alias(away_id), F.col("text_hash").alias(away_hash)
    )
    text_hash = F.xxhash64(docs["text"].cast("string"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(away_id)) & (
        text_hash == F.col(away_hash)
    )
    return docs.join(away, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mix(docs).documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens."""
    return pack_documents(docs, q.vocabulary("byte_bpe_50k.json"), end_id=2, room=1024)


STAGES = [
    ("quality", keep_quality),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, hashes over shingles and token ids are nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
