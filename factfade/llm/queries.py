"""The registered queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factfade.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted and read back."""
    from factfade.llm.chat import format_windows, read_back

    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text",
    )
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    windows = format_windows(rows.unionByName(more), vocabulary("byte_bpe_50k.json"))
    return read_back(windows)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    from factfade.llm.spotsigs import compare_edits

    return compare_edits(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with the document that stays; the lower half of the ids is the history.

    ``kept`` is NULL for a row without doc_id, as in the SQL.
    """
    from factfade.llm.exact import deduplicate, split_by_age

    history, arriving = split_by_age(table(spark, sf_dir, "documents"))
    return deduplicate(history, arriving, every_row=True).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as Simple-8b files and read back."""
    from factfade.llm.simple8b import documents_of, write_ids

    docs = table(spark, sf_dir, "documents")
    return documents_of(write_ids(docs, vocabulary("word_bpe_49k.json"), end_id=2))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside the held-out quarter."""
    from factfade.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    from factfade.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).taken()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents and the component of each."""
    from factfade.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside the held-out fifth."""
    from factfade.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    from factfade.llm.packing import pack_documents

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, room=1024)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in all documents."""
    from factfade.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the address of every page."""
    from factfade.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that hold together best."""
    from factfade.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM pieces
), grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM cut
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM cut
  UNION ALL
  SELECT lang, 3,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM cut
), f AS (
  SELECT lang, phrase, words, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), longer AS (
  SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10
), inside AS (
  SELECT lang, phrase, max(a) AS in_longer FROM (
    SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM longer WHERE words = 3
    UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM longer WHERE words = 3)
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM longer c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.in_longer IS NULL OR 100 * i.in_longer < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM kept
  UNION ALL
  SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE words = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest WHERE nth = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared beginnings of all conversations, each rebuilt on the first of its hundred."""
    from factfade.llm.prefixtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_windows, op2_spotsigs, op3_exact_dedup, op4_token_ids, op5_toxicity, op6_mixing,
        op7_simhash, op8_quality, op9_packing, op10_license_scan, op11_url_filter, op12_phrases,
        op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op12_phrases": OP12_SQL}
