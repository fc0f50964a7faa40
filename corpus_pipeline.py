"""A pipeline over `documents`: quality, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it
as Parquet in the shared folder and reads it back as the next stage's docs.
All stages but the last keep the columns of documents.

Empty tables pass through all stages; null texts are judged by the operators'
own rules: they have no letters, so that the language stage drops them.  Columns
of any name pass through as they are; of rows that repeat a document one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, languages, minhash, packing, quality
from tidemill.llm.storage import staged
from tidemill.llm.textkit import crc_mod

QUALITY_CUT = 0.7
#: by how much the mean probability of a document's best language is over chance: with four languages it must have
#: as much as the others together
LANGUAGE_MARGIN = 0.25


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least QUALITY_CUT stay."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    return quality.scored(docs, model, out_col="__tidemill_score").where(F.col("__tidemill_score") >= QUALITY_CUT).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned stay; unclear ones and those without letters go."""
    network = languages.train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    found = languages.identified(docs, network, lang_out="__tidemill_pred", score_out="__tidemill_score")
    cut = 1 / max(2, len(network.languages) if network else 0) + LANGUAGE_MARGIN
    return found.where((F.col("__tidemill_pred") != languages.UND) & (F.col("__tidemill_score") >= cut)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins."""
    return packing.packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
