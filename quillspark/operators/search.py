"""Hybrid search: temporal tiers, supported candidates, reranking with reasons, anchoring, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import temporal_phases

TIERS = ("match", "neutral", "mismatch", "non_positive", "inactive")


def temporal_tiers(scored: DataFrame, limit: int = 40) -> DataFrame:
    """query_id, chunk_id, tier, rank: among the best `limit`, chunks of the one phase that the question names come first.

    scored: query_id, question, chunk_id, text, score.
    """
    raw = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    asked, held = temporal_phases(F.col("question")), temporal_phases(F.col("text"))
    tier = (
        F.when(F.size(asked) != 1, "inactive")
        .when(F.col("score") <= 0, "non_positive")
        .when(F.array_contains(held, asked[0]), "match")
        .when(F.size(held) == 0, "neutral")
        .otherwise("mismatch")
    )
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    top = scored.withColumn("raw", raw).filter(F.col("raw") <= limit).withColumn("tier", tier)
    return top.select("query_id", "chunk_id", "tier", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "raw")).cast("long").alias("rank"))


def reranked(candidates: DataFrame, limit: int = 6, minimum: float = 0.38) -> DataFrame:
    """candidates with a reason and a score. candidates: query_id, chunk_id, fusion, similarity, coverage, focus, supported, substantive, compatible, signature.

    Rejected rows keep their reason; of equal signatures only the first is selected.
    """
    score = F.round(F.col("fusion") + 0.045 * F.col("coverage") + 0.04 * F.col("focus") + 0.008 * F.greatest(F.lit(0.0), F.col("similarity")), 9)
    reason = (
        F.when(~F.col("substantive"), "heading_only_or_short_body")
        .when(~F.col("compatible"), "incompatible_topic")
        .when(~F.col("supported") & (F.col("similarity") < max(minimum, 0.55)), "below_unsupported_dense_threshold")
        .otherwise("scored")
    )
    rows = candidates.withColumn("rerank_score", score).withColumn("reason", reason)
    scored = F.col("reason") == "scored"
    first = F.row_number().over(Window.partitionBy("query_id", "signature", scored).orderBy(F.desc("rerank_score"), "chunk_id"))
    rows = rows.withColumn("copy", first)
    place = F.row_number().over(Window.partitionBy("query_id", scored & (F.col("copy") == 1)).orderBy(F.desc("rerank_score"), "chunk_id"))
    chosen = scored & (F.col("copy") == 1) & (F.col("place") <= limit)
    rows = rows.withColumn("place", place)
    return rows.select("query_id", "chunk_id", "rerank_score", F.when(chosen, "selected").when(scored, "rank_limit_or_duplicate").otherwise(F.col("reason")).alias("reason"), F.when(chosen, F.col("place").cast("long")).alias("rank"))


def anchored(ranked: DataFrame, limit: int = 8, groups: int = 4) -> DataFrame:
    """query_id, chunk_id, position: the best hit of each of the first `groups` documents, then the rest. ranked: query_id, document, chunk_id, rank."""
    best = ranked.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "document").orderBy("rank")))
    leaders = Window.partitionBy("query_id", F.col("own") == 1).orderBy("rank")
    lead = (F.col("own") == 1) & (F.row_number().over(leaders) <= groups)
    placed = best.withColumn("lead", lead).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lead"), "rank")).cast("long"))
    return placed.filter(F.col("position") <= limit).select("query_id", "document", "chunk_id", "position")


def weighted_fusion(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """The older fusion: reciprocal ranks, those of the lexical list doubled."""
    rows = dense.select("query_id", "chunk_id", (1.0 / (60 + F.col("rank"))).alias("s")).unionByName(lexical.select("query_id", "chunk_id", (2.0 / (60 + F.col("rank"))).alias("s")))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"))
