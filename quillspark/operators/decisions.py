"""Rules that turn summaries into verdicts, queues and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.metrics import ORDER

ENGINES = ("bm25", "minimal", "rrf")
CORE = ("hit_at_5", "hit_at_10", "mrr", "recall_at_10")


def _wide(every: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return every.groupBy("query_id").agg(*[F.max(F.when(F.col("engine") == e, F.col(m))).alias(f"{e}_{m}") for e in ENGINES for m in names])


def priority_groups(every: DataFrame) -> DataFrame:
    """Which groups of interest each case belongs to."""
    p = _wide(every, ORDER)
    key = lambda e: F.struct(*[F.col(f"{e}_{m}").alias(m) for m in ORDER])
    same = lambda m: (F.col(f"bm25_{m}") == F.col(f"minimal_{m}")) & (F.col(f"bm25_{m}") == F.col(f"rrf_{m}"))
    hit = lambda e: F.col(f"{e}_hit_at_10")
    return p.select(
        "query_id",
        ((hit("minimal") == 1) & (hit("bm25") == 0) & (hit("rrf") == 0)).alias("only_minimal"),
        (key("bm25") > key("rrf")).alias("bm25_over_rrf"),
        (F.col("rrf_mrr") > F.col("minimal_mrr")).alias("rrf_mrr_over_minimal"),
        (hit("bm25") + hit("minimal") + hit("rrf") == 0).alias("all_failed"),
        (same("hit_at_10") & (~same("recall_at_10") | ~same("precision_at_10"))).alias("same_hit"),
    )


def before_after(every: DataFrame, before: str, after: str) -> DataFrame:
    means = every.groupBy("engine").agg(*[F.avg(m).alias(m) for m in ORDER]).unpivot("engine", list(ORDER), "metric", "v")
    b, a = means.filter(F.col("engine") == before), means.filter(F.col("engine") == after)
    joined = b.select("metric", F.col("v").alias("b")).join(a.select("metric", F.col("v").alias("a")), "metric")
    delta = F.round(F.col("a") - F.col("b"), 6)
    return joined.select("metric", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), delta.alias("delta"), (delta < 0).alias("regression"))


def core_scores(every: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.avg(m) for m in CORE])
    return every.groupBy("engine").agg(F.round(total / len(CORE), 9).alias("core"))


def select_strategy(scores: DataFrame, simplest_first: list[str]) -> DataFrame:
    """The engine with the best core score; the simpler one of equals."""
    simple = reduce(lambda c, x: c.when(F.col("engine") == x[1], -x[0]), list(enumerate(simplest_first))[1:], F.when(F.col("engine") == simplest_first[0], 0))
    return scores.agg(F.max_by(F.struct("engine", "core"), F.struct("core", simple)).alias("x")).select(F.col("x.engine").alias("selected"), F.round("x.core", 6).alias("core"))


def fairness_verdict(summaries: DataFrame) -> DataFrame:
    """A to D from four core metrics of minimal BM25, current BM25 and vectors."""
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c), 9)
    wins = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x > y), lambda z: z))
    c = summaries.select("case_id", mean("minimal").alias("m"), mean("current").alias("b"), mean("vec").alias("v"), wins("minimal", "vec").alias("mw"), wins("vec", "current").alias("vw"))
    gap = lambda x, y: F.round(F.col(x) - F.col(y), 9)
    code = (
        F.when((gap("v", "b") >= 0.05) & (F.col("vw") >= 3), "D")
        .when((gap("m", "v") >= 0.05) & (F.col("mw") >= 3), "A")
        .when(F.col("v") >= F.round(F.col("b") - 0.05, 9), "C")
        .when((gap("b", "m") >= 0.05) & (F.col("m") <= F.round(F.col("v") + 0.03, 9)), "B")
        .when(F.col("m") > F.col("v"), "A")
        .otherwise("B")
    )
    return c.select("case_id", code.alias("code"))


def complementary(every: DataFrame, one: str, two: str, metric: str) -> DataFrame:
    p = every.groupBy("query_id").agg(F.max(F.when(F.col("engine") == one, F.col(metric))).alias("a"), F.max(F.when(F.col("engine") == two, F.col(metric))).alias("b"))
    a, b = F.col("a") > F.col("b"), F.col("b") > F.col("a")
    return p.agg((F.bool_or(a) & F.bool_or(b)).alias("complementary"), F.count_if(a).alias("first_only"), F.count_if(b).alias("second_only"))


def case_contract(cases: DataFrame) -> DataFrame:
    answer = F.col("behavior") == "answer"
    fits = (F.col("want_kind") == F.col("kind")) | ((F.col("want_kind") == "summary") & F.col("kind").isin("fact", "synthesis"))
    reasons = F.array_compact(
        F.array(
            F.when(answer & ~F.col("answered"), F.lit("missing_answer")),
            F.when(~answer & F.col("answered"), F.lit("unexpected_answer")),
            F.when(~fits, F.lit("intent")),
            F.when(F.col("want_evidence") != F.col("evidence"), F.lit("evidence_type")),
        )
    )
    return cases.select("case_id", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def queue() -> Column:
    return F.when(F.col("known").isNull(), "needs_label").when(F.col("toxic") == 1, "safety_review").when(F.col("quality") == 0, "quality_review").otherwise("ready")


def readiness() -> Column:
    return F.when(F.col("unsafe") * 10 > F.col("n"), "blocked").when(F.col("waiting") * 10 > F.col("n") * 7, "needs_review").when(F.col("waiting") > 0, "conditionally_ready").otherwise("ready")


def dataset_contract(documents: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """rule, violations."""
    ids = documents.select("doc_id")
    rules = {
        "duplicate_document_ids": ids.groupBy("doc_id").count().filter("count > 1"),
        "labels_without_document": labels.join(ids, "doc_id", "left_anti"),
        "quality_out_of_range": labels.filter(~F.col("quality").isin(0, 1)),
        "toxic_out_of_range": labels.filter(~F.col("toxic").isin(0, 1)),
        "length_drift": documents.filter(F.col("n_chars") != F.length("text")),
        "duplicate_questions": questions.groupBy("text").count().filter("count > 1"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()])
