"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage gets the documents that the one before kept and returns the documents it keeps, with the columns of documents;
the last returns packed pieces. run() writes what each stage returns to the shared folder and reads it again.

Null and empty texts go at the first stage (no words), as do texts of under 20 words. A text of nothing but boilerplate is
empty from the second stage on and is packed as its end id. Repeated rows are one row from the third stage on; of rows with
one id but different texts each is a document. Very long texts are whole at each stage. Empty tables give empty tables.
Columns of documents beside those that are used pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import boilerplate, decontaminate, jaccard, packing, rules
from quillspark.session import write_shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v2 of the rule ledger."""
    return rules.keep(docs, "v2")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; lines that only copies of a document spread are none. n_chars follows the text."""
    from pyspark.sql import functions as F

    cleaned = boilerplate.clean(docs, unlike=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cleaned.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies: shingles of five words, Jaccard 0.8 or more."""
    return jaccard.representatives(docs, rule=jaccard.Rule(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Packing depends on a tokenizer, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
