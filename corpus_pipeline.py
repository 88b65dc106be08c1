"""A corpus from documents: toxic ones go, near copies go, secrets are masked, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the
last return the columns of documents. ``run`` writes each stage as Parquet into the shared folder and
reads it again for the next one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.storage import staged
from tabloom.llm import bpe, catalog, ngram_join, ordinal, raking, secret_scan

#: Targets are the corpus's own shares to this power, as in op9_mix_sources: the largest levels give way to the small ones.
MIX_POWER = 0.7


#: Columns that stages read. Others are carried along.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage):
    """A stage that meets further columns under names which cannot clash with its own, and gives them back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in OWN else f"~{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


@carrying
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    grades = catalog.severity_grades(catalog.table(spark, sf_dir, "labels"))
    return ordinal.without_rejected(docs, ordinal.fit(docs, grades))


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.deduplicate(docs)


@carrying
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and lengths set anew."""
    masked = secret_scan.redact(docs)
    length = F.coalesce(F.length("text").cast(masked.schema["n_chars"].dataType), F.col("n_chars"))
    return masked.withColumn("n_chars", length)


@carrying
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities raked to the targets of source, language and topic."""
    measured = docs.withColumn("mix_tokens", raking.words()).withColumn("mix_topic", raking.form())
    mixed = raking.mix(measured, ("source", "lang", "mix_topic"), tokens="mix_tokens", power=MIX_POWER)
    return mixed.where("mix_kept").select(*[mixed[c] for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.encode_texts(docs, *catalog.byte_ranks())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: SQL cannot fit the model or hash and encode the texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
