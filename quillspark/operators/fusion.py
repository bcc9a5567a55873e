"""Rank fusion and reranking of candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, chunk_id, score = sum of 1 / (k + rank) over the rankings (query_id, chunk_id, rank)."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "chunk_id", "rank") for r in rankings])
    return every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def rerank_variants(candidates: DataFrame) -> DataFrame:
    """strategy, query_id, chunk_id, new_rank. candidates: query_id, chunk_id, rank, score, first_rank, second_rank, current_rank, overlap.

    Windows of three keep their place; inside them the key of the strategy decides, then the rank before.
    """
    window = F.floor((F.col("rank") - 1) / 3)
    both = F.col("first_rank").isNotNull() & F.col("second_rank").isNotNull()
    best = F.least(F.coalesce("first_rank", F.lit(99)), F.coalesce("second_rank", F.lit(99)))
    origin = F.round(F.col("score") + 0.05 * (F.coalesce(1 / (60 + F.col("first_rank")), F.lit(0.0)) + F.coalesce(1 / (60 + F.col("second_rank")), F.lit(0.0))) + F.when(both, 0.0005).otherwise(0.0), 9)
    zero = F.lit(0.0)
    keys = {
        "no_reranker": (zero, zero, zero),
        "normalized_input": (window, -F.col("overlap"), zero),
        "candidate_aware": (window, F.when(both, 0.0).otherwise(1.0), best),
        "rank_preserving": (window, F.col("current_rank"), zero),
        "top_n_rerank": (F.when(F.col("rank") <= 5, 0.0).otherwise(1.0), F.when(F.col("rank") <= 5, F.col("current_rank")).otherwise(0), zero),
        "origin_feature": (-origin, zero, zero),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), *[k.cast("double").alias(f"k{i}") for i, k in enumerate(own)]) for name, own in keys.items()])).alias("s")
    each = candidates.select("query_id", "chunk_id", "rank", rows).select("query_id", "chunk_id", "rank", "s.*")
    order = Window.partitionBy("strategy", "query_id").orderBy("k0", "k1", "k2", "rank")
    return each.select("strategy", "query_id", "chunk_id", F.row_number().over(order).alias("new_rank"))


def selective_decision(signals: DataFrame) -> DataFrame:
    """use_dense, weak and reasons. signals: query_id, top, second, overlap, kind, phase, follow_up, exact."""
    gap = F.when(F.col("top") != 0, (F.col("top") - F.col("second")) / F.greatest(F.abs("top"), F.lit(1e-9))).otherwise(0.0)
    weak = F.array_compact(F.array(F.when(F.col("top") < 3.0, F.lit("low_top_score")), F.when(gap < 0.10, F.lit("weak_score_gap")), F.when(F.col("overlap") < 0.45, F.lit("low_lexical_overlap"))))
    intent = F.col("kind").isin("procedure", "summary", "synthesis", "comparison") | (F.col("phase") != "") | F.col("follow_up")
    use = ~F.col("exact") & (F.col("follow_up") | (intent & (F.size(weak) > 0)) | (F.size(weak) >= 2))
    reasons = F.when(F.col("exact"), F.array(F.lit("exact_lexical_priority"))).when(~use, F.array(F.lit("bm25_confident"))).otherwise(F.concat(weak, F.array_compact(F.array(F.when(intent, F.lit("semantic_intent")), F.when(F.col("follow_up"), F.lit("follow_up"))))))
    return signals.select("query_id", use.alias("use_dense"), F.size(weak).alias("n_weak"), F.array_join(reasons, ",").alias("reasons"))
