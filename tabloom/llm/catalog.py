"""Registered queries of this subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tabloom.llm import bpe, brown, chat, davidson, ngram_join, ordinal, polytope, posting, raking, secret_scan, subvectors, suffix_levels, token_counts
from tabloom.llm.batches import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_ranks() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def byte_bpe(spark, d):
    return bpe.encode_texts(table(spark, d, "documents"), *byte_ranks())


#: Turns that the marked template is said to look back over: far more than it does.
CHAT_WINDOW = 32


def with_planted(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one whose texts hold the template's own control strings."""
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


@query(
    "op5_chat_format",
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS text_chars,
    length(role) + length(role) - length(replace(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', ''), chr(10), '')) AS role_chars
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(4 + role_chars + 2 + text_chars + 9) AS bigint) AS formatted_chars,
  false AS rewrites
FROM sized GROUP BY conv_id
""",
)
def chat_format(spark, d):
    return chat.format_conversations(with_planted(spark, table(spark, d, "conversations")), window=CHAT_WINDOW)


@query("op6_secret_scan")
def secrets(spark, d):
    return secret_scan.scan_texts(table(spark, d, "documents"))


@query("op7_token_counts")
def tokens(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 not toxic, 1 toxic, 2 toxic in a document of low quality."""
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return labels.select(F.col("doc_id").alias("key"), grade.alias("grade"))


@query("op4_toxicity_ordinal")
def toxicity(spark, d):
    docs = table(spark, d, "documents")
    return ordinal.score_texts(docs, ordinal.fit(docs, severity_grades(table(spark, d, "labels"))))


MIX_DIMS = ("source", "lang", "topic")


def with_topic(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mix_tokens", raking.words()).withColumn("topic", raking.form())


@query(
    "op9_mix_sources",
    """
WITH docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n,
    length(text) - length(replace(text, '|', '')) AS marks, length(text) - length(replace(text, chr(10), '')) AS lines
  FROM docs
), topics AS (
  SELECT doc_id, source, lang, n, CASE WHEN marks * 4 > n THEN 'table' WHEN lines * 8 > n THEN 'lines' WHEN n < 60 THEN 'note'
    WHEN n < 800 THEN 'article' ELSE 'book' END AS topic
  FROM counted
), cells AS MATERIALIZED (SELECT source, lang, topic, sum(n) AS tokens FROM topics GROUP BY ALL),
levels AS (
  SELECT 'source' AS dim, source AS level, sum(tokens) AS t FROM cells GROUP BY ALL
  UNION ALL SELECT 'lang', lang, sum(tokens) FROM cells GROUP BY ALL
  UNION ALL SELECT 'topic', topic, sum(tokens) FROM cells GROUP BY ALL
), aims AS MATERIALIZED (
  SELECT dim, level, pow(t::DOUBLE, 0.7) / sum(pow(t::DOUBLE, 0.7)) OVER (PARTITION BY dim) * (SELECT sum(tokens) FROM cells) AS aim
  FROM levels WHERE t > 0
),
"""
    + raking.sweep_sql(MIX_DIMS, 24)
    + """
SELECT doc_id, source, lang, topic, cast(n AS bigint) AS n_tokens, round(factor, 6) AS weight,
  round(least(1.0, factor / (SELECT max(factor) FROM raked WHERE tokens > 0)), 6) AS probability,
  cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '') || ':mix'), 1, 13) AS bigint) / 4503599627370496.0
    < least(1.0, factor / (SELECT max(factor) FROM raked WHERE tokens > 0)) AS kept
FROM topics JOIN raked USING (source, lang, topic)
""",
)
def mix_sources(spark, d):
    docs = with_topic(table(spark, d, "documents")).select("doc_id", "source", "lang", "topic", "mix_tokens")
    mixed = raking.mix(docs, MIX_DIMS, tokens="mix_tokens")
    level = [F.coalesce(c, F.lit("(none)")).alias(c) for c in MIX_DIMS]
    return mixed.select(
        "doc_id", *level, F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"),
    )


@query("op1_brown_scoring")
def brown_scoring(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return brown.score_texts(docs, held_out)


@query("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark, d):
    return ngram_join.join(table(spark, d, "documents"))


@query("op2_embedding_near_dedup")
def embedding_near_dedup(spark, d):
    return polytope.link(table(spark, d, "embeddings"))


@query("op8_posting_lists")
def posting_lists(spark, d):
    return posting.search(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query("op11_centroid_clustering", subvectors.cluster_sql())
def centroid_clustering(spark, d):
    return subvectors.cluster(table(spark, d, "embeddings"))


@query("op13_embedding_whitening")
def embedding_whitening(spark, d):
    return davidson.whiten(table(spark, d, "embeddings"))


@query("op12_suffix_array_dedup", suffix_levels.SQL)
def suffix_array_dedup(spark, d):
    return suffix_levels.summary(suffix_levels.deduplicate(table(spark, d, "documents")))
