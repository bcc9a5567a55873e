"""Metrics of ranked results, their aggregates and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
NAMES = tuple([f"hit_at_{k}" for k in CUTOFFS] + ["mrr"] + [f"recall_at_{k}" for k in CUTOFFS] + [f"precision_at_{k}" for k in CUTOFFS])


def ranked_metrics(ranking: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hit, recall, precision and reciprocal rank of each question with gold.

    Precision divides by what was returned within the cutoff. ranking: keys, chunk_id, rank; gold: query_id, chunk_id.
    """
    total = gold.groupBy("query_id").agg(F.count("*").alias("gold_n"))
    extra = [k for k in keys if k != "query_id"]
    marked = ranking.join(gold.withColumn("is_gold", F.lit(1)), ["query_id", "chunk_id"], "left")
    at = lambda k: F.col("rank") <= k
    grouped = marked.groupBy(*keys).agg(
        *[F.count_if(at(k) & F.col("is_gold").isNotNull()).alias(f"m{k}") for k in CUTOFFS],
        *[F.count_if(at(k)).alias(f"r{k}") for k in CUTOFFS],
        F.min(F.when(F.col("is_gold").isNotNull(), F.col("rank"))).alias("first"),
    )
    asked = total if not extra else total.crossJoin(F.broadcast(ranking.select(*extra).distinct()))  # a few engines
    joined = asked.join(grouped, list(keys), "left")
    m = lambda k: F.coalesce(F.col(f"m{k}"), F.lit(0))
    out = [(m(k) > 0).cast("double").alias(f"hit_at_{k}") for k in CUTOFFS]
    out.append(F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))
    out += [F.round(m(k) / F.col("gold_n"), 6).alias(f"recall_at_{k}") for k in CUTOFFS]
    out += [F.round(F.coalesce(m(k) / F.nullif(F.col(f"r{k}"), F.lit(0)), F.lit(0.0)), 6).alias(f"precision_at_{k}") for k in CUTOFFS]
    return joined.select(*keys, *out)


def long_rows(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, k, rank, chunk_id, is_gold: the ranking once for each cutoff."""
    marked = ranking.join(gold.withColumn("g", F.lit(True)), ["query_id", "chunk_id"], "left")
    cut = marked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in CUTOFFS]))).filter(F.col("rank") <= F.col("k"))
    return cut.select("query_id", "k", "rank", "chunk_id", F.coalesce("g", F.lit(False)).alias("is_gold"))


def aggregate(metrics: DataFrame, group: str) -> DataFrame:
    """Means over all and by group, in one pass; the row over all has group 'overall'."""
    means = [F.round(F.avg(n), 6).alias(n) for n in NAMES]
    rolled = metrics.rollup(group).agg(F.grouping(group).alias("g"), F.count("*").alias("cases"), *means)
    return rolled.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(group)).alias(group), "cases", *NAMES)


def failure_category(metrics: DataFrame) -> DataFrame:
    """metrics with gold_n, outside_n (gold that isn't in the corpus)."""
    category = (
        F.when(F.col("gold_n") == F.col("outside_n"), "gold_not_in_corpus")
        .when(F.col("outside_n") > 0, "gold_partially_outside_corpus")
        .when(F.col("hit_at_10") == 0, "no_gold_hit_top_10")
        .when(F.col("hit_at_1") == 0, "gold_below_rank_1")
        .otherwise("none")
    )
    return metrics.withColumn("failure_category", category)


def distribution(values: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, least, median, 95th percentile (linear) and most, by key."""
    v = F.col(value)
    return values.groupBy(key).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("minimum"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.max(v).alias("maximum"))


def p95_variants(values: DataFrame, key: str, value: str) -> DataFrame:
    """Three readings of the 95th percentile: linear; the element at int((n-1) * .95 + .999999); that at int(n * .95) - 1."""
    order = Window.partitionBy(key).orderBy(value)
    numbered = values.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    up = F.floor((F.col("n") - 1) * F.lit(0.95) + F.lit(0.999999))
    down = F.greatest(F.floor(F.col("n") * F.lit(0.95)) - 1, F.lit(0))
    return numbered.groupBy(key).agg(F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95_linear"), F.max(F.when(F.col("i") == up, F.col(value))).alias("p95_up"), F.max(F.when(F.col("i") == down, F.col(value))).alias("p95_down"))


ORDER = ("hit_at_10", "mrr", "recall_at_10", "precision_at_10")


def winners(metrics: DataFrame) -> DataFrame:
    """query_id, winners, complete_tie: engines with the best (hit, mrr, recall, precision), compared in this order. metrics: engine, query_id, ..."""
    key = F.struct(*ORDER)
    best = metrics.withColumn("key", key).withColumn("top", F.max(key).over(Window.partitionBy("query_id")))
    return best.groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("key") == F.col("top"), F.col("engine")))), ",").alias("winners"),
        (F.count_distinct(*ORDER) == 1).alias("complete_tie"),
    )


def unions(frames: dict[str, DataFrame], name: str = "engine") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in frames.items()])
