"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes what its predecessor kept, stored as Parquet, and returns the columns of
``documents``; the last returns the packed pieces. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmeter.llm import decontaminate, packing, simhash, substrings, toxicity
from postmeter.llm.queries import remainder
from postmeter.llm.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. Learns from the labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(5) != 0)
    return toxicity.without_toxic(docs, toxicity.train(docs, labels, "toxic"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash class stays, one with the smallest doc_id."""
    return simhash.one_per_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters that earlier documents hold in runs of 50 bytes go, and documents of which nothing is left.

    ``n_chars`` follows the text.
    """
    return substrings.without_repeats(docs, length="n_chars")


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each judged for itself."""
    return decontaminate.without_contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", near_copies),
    ("substrings", repeated_passages),
    ("decontamination", contaminated),
    ("packing", packed),
]

#: Dictionary training, XXH64 with a seed and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir))
    return docs
