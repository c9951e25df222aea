"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Every stage is one operator of ``sojourn.llm``; its result is written as Parquet in the shared folder and read again.

Null texts have no letters, so the first stage rejects them, as it does empty ones. Rows that repeat are one document from the second
stage on. Rows with a null id stay unless they are near copies of one with an id. Texts of any length are read whole, extra columns are carried,
whatever their names, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import decontaminate, languages, packing, similar, substrings
from sojourn.llm.queries import tokenizer_path
from sojourn.llm.stages import fresh
from sojourn.operators.staging import staged_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the rows outside the held-out fold."""
    train = docs.filter(F.col("doc_id").isNotNull() & ~languages.holdout(F.col("doc_id"), 5, 0))
    name = fresh("found", docs)
    found = languages.identify(docs, languages.learn(train), out=name)
    return found.filter(F.col(f"{name}.lang") != languages.UNKNOWN).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return similar.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document of smaller id holds; those left empty go."""
    return substrings.without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    name = fresh("match", docs)
    found = decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=name)
    return found.filter(~F.col(f"{name}.contaminated")).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages),
          ("benchmark decontamination", decontamination), ("packing", sequences)]

#: The stages learn a model and call a tokenizer, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged_table(stage(spark, docs, sf_dir))
    return docs
