"""BM25 over many questions at once. Only terms that some question holds are looked at beyond their document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import lexical_tokens

K1, B = 1.5, 0.75


def tokenized(chunks: DataFrame, chunk_id: str, text: Column, tokens: Callable[[Column], Column] = lexical_tokens) -> DataFrame:
    return chunks.select(F.col(chunk_id).alias("chunk_id"), tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return docs.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(1.0))).alias("avgdl"))


def _terms(docs: DataFrame) -> DataFrame:
    """chunk_id, dl, term: the terms of each chunk, and a mark, the empty term, that stands for the chunk itself."""
    return docs.select("chunk_id", "dl", F.explode(F.concat(F.array(F.lit("")), F.coalesce("tokens", F.array().cast("array<string>")))).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """chunk_id, dl, term, tf of all terms and marks: the index that scores() can be given. docs: see tokenized()."""
    return _terms(docs).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def scores(docs: DataFrame, queries: DataFrame, query_id: str, question: Column, tokens: Callable[[Column], Column] = lexical_tokens, pair_weight: float = 0.25, index: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score for every pair that shares a term. docs: see tokenized(); with an index of them they aren't read."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(question))).alias("term"))
    wanted = asked.select("term").unionByName(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    # Dealt by chunk, the counts of terms and, if the questions' terms are small enough to be broadcast, the sums need no other
    # exchange; the statistics come from the same one by the marks, so that texts are tokenised once.
    rows = (_terms(docs).withColumn("tf", F.lit(1).cast("long")) if index is None else index).join(wanted, "term", "left_semi").repartition("chunk_id")
    held = rows.groupBy("chunk_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    mark = F.col("term") == ""
    total, length = F.sum(F.when(mark, F.col("tf"))), F.sum(F.when(mark, F.col("tf") * F.col("dl")))
    counted = held.agg(F.coalesce(total, F.lit(0)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(length, F.sum(F.when(mark & F.col("dl").isNotNull(), F.col("tf")))), F.lit(1.0))).alias("avgdl"))
    frequency = held.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n").cast("double")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weight = F.when(F.col("term").startswith("ko:"), F.lit(pair_weight)).otherwise(F.lit(1.0))
    weighed = frequency.crossJoin(F.broadcast(counted)).withColumn("w", weight * idf)  # the statistics are one row
    return asked.join(weighed, "term").join(held, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * part), 6).alias("score"))


def top(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each question, by score, then id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
