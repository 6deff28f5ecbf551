"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives the next one's documents; all but the last keep the
columns of ``documents``. ``run`` writes what a stage returns as Parquet to the shared folder and reads
it again, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from focuslake.llm import decontaminate, jaccard, queries, tokens
from focuslake.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    scored = queries.toxicity_scores(spark, docs, sf_dir)
    return scored.where(~F.col("is_toxic")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of copies and near copies."""
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = decontaminate.mark_leaks(docs, queries.table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target mixture of sources, languages and topics."""
    return queries.mix_documents(docs).where("selected").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as files of token ids: place, length and digest of every document in them."""
    return tokens.digest(tokens.store_ids(docs, queries.tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

# A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = shared_folder(spark, "pipeline"), queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
