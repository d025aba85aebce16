"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import langid, mixing, packing, secrets, simhash
from roadloom.llm.common import held_out, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told stay, with the predicted one as their lang; those without a letter go."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~held_out("doc_id")))
    known = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    return secrets.redacted(docs.select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identified_language),
    ("near_duplicates", one_of_near_duplicates),
    ("secrets", without_secrets),
    ("mixture", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: No SQL: language identification, SimHash and byte-level BPE have no equivalent in it.
ORACLE_SQL = None
