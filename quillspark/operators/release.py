"""Whether an engine may be released: cases against their contracts and gold, rankings under one frozen gold, queues and ladders.

Null flags and counts are false and 0, null ids, quotes and notes are empty. Repeated rows of cases give repeated rows, but for
local_evaluation, where a source that is expected twice counts twice. Ties and order don't matter; empty tables give empty results
or, in summaries, a row of zero cases. Columns of other names are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import clean
from quillspark.operators import metrics

# Kinds of questions that stand for an expected one; any other stands for itself.
COMPATIBLE = {
    "purpose": ("purpose", "fact"),
    "procedure": ("procedure", "cautions"),
    "preparation": ("preparation", "materials", "fact", "procedure"),
    "cautions": ("cautions", "fact"),
    "monitoring": ("cautions", "fact", "preparation"),
    "adverse_reaction": ("cautions", "fact", "procedure", "summary"),
    "product_specific": ("fact", "summary", "comparison", "preparation", "procedure", "cautions"),
    "fact_specific": ("fact", "preparation", "cautions"),
    "comparison": ("comparison",),
    "summary": ("summary",),
    "out_of_scope": ("fact", "summary", "procedure", "cautions"),
}
# What may help a case that waits, by why it waits.
LAYERS = {
    "image_human_review_required": "image_human_review",
    "ambiguous_question": "human_question_clarification",
    "table_structure_or_mapping": "table_row_mapping_or_human_confirmation",
    "retrieval_miss": "retrieval_or_query_planning",
    "insufficient_candidate_evidence": "candidate_generation_or_human_confirmation",
    "other": "human_final_decision",
}
# What stands in the way of a release.
CORE, IMAGE, LIVE = "CORE_REGRESSION", "TF027_HUMAN_REVIEW_OR_EXPLICIT_V1_SCOPE_EXCLUSION", "LIVE_RAGAS_OR_EXPLICIT_NO_EXTERNAL_PROVIDER_DECISION"


def _true(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) > 0


def compatible_intent(expected: Column, actual: Column) -> Column:
    out = expected == actual
    for kind, others in COMPATIBLE.items():
        out = F.when(expected == kind, actual.isin(*others)).otherwise(out)
    return _true(out)


def uat_contract(cases: DataFrame) -> DataFrame:
    """case_id, passed, reasons (array, in order).

    cases: case_id, expected_behavior (answer, abstain, pending_human_review), expected_intent, intent, domain, route_status,
    pre_supported, post_supported, structured_supported, n_selected, n_structured, provider_calls, vision_calls.
    """
    behavior = F.coalesce("expected_behavior", F.lit(""))
    answer, abstain, pending = (behavior == b for b in ("answer", "abstain", "pending_human_review"))
    structured, inside = _true("structured_supported"), _true(F.col("domain") == "hospital")
    rules = (
        (_some("provider_calls"), "unexpected_provider_call"),
        (_some("vision_calls"), "unexpected_vision_call"),
        (abstain & inside, "out_of_scope_domain_mismatch"),
        (abstain & (_true("pre_supported") | _true("post_supported") | _some("n_selected")), "unsafe_out_of_scope_admission"),
        (pending & ~_true(F.col("route_status") == "pending_image_review"), "image_review_gate_missing"),
        (pending & _some("n_selected"), "unapproved_image_evidence_selected"),
        (answer & ~inside, "hospital_domain_mismatch"),
        (answer & ~compatible_intent(F.col("expected_intent"), F.col("intent")), "intent_mismatch"),
        (answer & ~_true("pre_supported") & ~structured, "pre_budget_not_supported"),
        (answer & ~_true("post_supported") & ~structured, "post_budget_not_supported"),
        (answer & ~_some("n_selected") & ~_some("n_structured"), "missing_selected_evidence"),
        (~(answer | abstain | pending), "unknown_expected_behavior"),
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))
    return cases.select("case_id", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def gold_match(labels: DataFrame) -> DataFrame:
    """case_id, candidate_match, aggregate_match, eligible: whether what was found meets a label; null where the label doesn't tell.

    labels: case_id, expected_abstain, safely_abstained, eligible (booleans), gold_ids, selected_ids (arrays).
    """
    ids = lambda c: F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))
    found = F.when(F.size(ids("gold_ids")) > 0, F.arrays_overlap(ids("gold_ids"), ids("selected_ids")))
    match = F.when(_true("expected_abstain"), _true("safely_abstained")).otherwise(found)
    return labels.select("case_id", match.alias("candidate_match"), F.when(_true("eligible"), match).alias("aggregate_match"), _true("eligible").alias("eligible"))


def local_evaluation(cases: DataFrame, expected: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, expected, matched, passed, retrieved, seconds: a source is matched by a hit of its name, its page and its quote, if told.

    cases: query_id, seconds; expected: query_id, name, page, quote; hits: query_id, name, page, text. A case that expects no source
    passes if nothing is retrieved.
    """
    wanted = expected.groupBy("query_id", "name", "page", F.coalesce(clean(F.col("quote")), F.lit("")).alias("quote")).agg(F.count("*").alias("n"))
    got = hits.select("query_id", "name", F.col("page").alias("hit_page"), F.coalesce(clean(F.col("text")), F.lit("")).alias("hit_text"), F.lit(True).alias("hit"))
    fits = _true("hit") & (F.col("page").isNull() | _true(F.col("page") == F.col("hit_page"))) & F.contains("hit_text", "quote")
    each = wanted.join(got, ["query_id", "name"], "left").groupBy("query_id", "name", "page", "quote", "n").agg(F.bool_or(_true(fits)).alias("ok"))
    sums = each.groupBy("query_id").agg(F.sum("n").alias("expected"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("matched"))
    count = hits.groupBy("query_id").agg(F.count("*").alias("retrieved"))
    rows = cases.select("query_id", "seconds").join(sums, "query_id", "left").join(count, "query_id", "left").fillna(0, ["expected", "matched", "retrieved"])
    passed = F.when(F.col("expected") > 0, F.col("matched") == F.col("expected")).otherwise(F.col("retrieved") == 0)
    return rows.select("query_id", "expected", "matched", passed.alias("passed"), "retrieved", "seconds")


def local_summary(rows: DataFrame) -> DataFrame:
    """cases, passed, recall, median_seconds, p95_seconds of a local evaluation; the last three are null if there is nothing to tell."""
    recall = F.try_divide(F.sum("matched"), F.sum("expected"))
    return rows.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), recall.alias("recall"), F.median("seconds").alias("median_seconds"), F.percentile("seconds", F.lit(0.95)).alias("p95_seconds"))


def fixed_rankings(cases: DataFrame, gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """strategy, subset (all, table), problem, cases, and the mean of each metric over eligible cases.

    cases: query_id, evidence_type, eligible; gold: query_id, chunk_id; rankings: strategy, query_id, rank, chunk_id, of which the
    first ten count. A strategy that doesn't rank just the given cases (case_coverage_drift) or ranks an id twice
    (invalid_ranked_ids) has that problem and no figures.
    """
    top = rankings.filter(F.col("rank") <= 10).select("strategy", "query_id", "rank", "chunk_id")
    own = cases.select("query_id", F.coalesce("evidence_type", F.lit("text")).alias("evidence_type"), F.coalesce("eligible", F.lit(True)).alias("eligible"))
    each = top.groupBy("strategy", "query_id").agg((F.count_distinct("chunk_id") < F.count("*")).alias("twice"))
    known = own.select("query_id", F.lit(True).alias("known"))
    total = own.agg(F.count_distinct("query_id").alias("total"))
    state = each.join(known.distinct(), "query_id", "left").groupBy("strategy").agg(F.bool_or("twice").alias("twice"), F.count_if("known").alias("met"), F.count_if(F.col("known").isNull()).alias("foreign"))
    drift = (F.col("met") < F.col("total")) | (F.col("foreign") > 0)
    state = state.join(F.broadcast(total)).select("strategy", F.when(drift, "case_coverage_drift").when(F.col("twice"), "invalid_ranked_ids").alias("problem"))  # one row
    scored = metrics.ranked_metrics(top, gold, ("strategy", "query_id")).join(own.filter("eligible"), "query_id")
    table = F.col("evidence_type").isin("table", "mixed")
    subsets = F.explode(F.when(table, F.array(F.lit("all"), F.lit("table"))).otherwise(F.array(F.lit("all"))))
    means = scored.withColumn("subset", subsets).groupBy("strategy", "subset").agg(F.count("*").alias("cases"), *[F.avg(n).alias(n) for n in metrics.NAMES])
    rows = state.withColumn("subset", F.explode(F.array(F.lit("all"), F.lit("table")))).join(means, ["strategy", "subset"], "left")
    sound = F.col("problem").isNull()
    return rows.select("strategy", "subset", "problem", F.when(sound, F.coalesce("cases", F.lit(0))).otherwise(0).cast("long").alias("cases"), *[F.when(sound, F.col(n)).alias(n) for n in metrics.NAMES])


def deferred(cases: DataFrame) -> DataFrame:
    """case_id, category, layer, evidence_status: why a case waits, what may help it, and whether there is anything to review.

    cases: case_id, evidence_type, note, image_required, table_required, n_primary, n_acceptable, n_chunks, n_rows.
    """
    note = F.lower(F.coalesce("note", F.lit("")))
    kind = F.coalesce("evidence_type", F.lit(""))
    category = (
        F.when(_true("image_required") | kind.startswith("image"), "image_human_review_required")
        .when(F.contains(note, F.lit("모호")) | F.contains(note, F.lit("ambiguous")), "ambiguous_question")
        .when(_true("table_required") | (kind == "table"), "table_structure_or_mapping")
        .when(~_some("n_chunks"), "retrieval_miss")
        .when(~_some("n_primary"), "insufficient_candidate_evidence")
        .otherwise("other")
    )
    rows = cases.withColumn("category", category)
    layer = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[F.col("category")]
    some = _some("n_primary") | _some("n_acceptable") | _some("n_chunks") | _some("n_rows")
    return rows.select("case_id", "category", layer.alias("layer"), F.when(some, "candidate_present_not_final_gold").otherwise("not_found_in_current_candidates").alias("evidence_status"))


def _ladder(core: Column, image: Column, live: Column) -> Column:
    return (
        F.when(~core, "NOT_READY")
        .when(~image & ~live, "READY_EXCEPT_IMAGE_AND_LIVE_RAGAS")
        .when(~image, "READY_EXCEPT_IMAGE_HUMAN_REVIEW")
        .when(~live, "READY_EXCEPT_LIVE_RAGAS")
        .otherwise("READY")
    )


def ladders(states: DataFrame, key: str) -> DataFrame:
    """key, release_status, blockers, final_status, provider_status, version.

    states: key and the flags core_passed, image_approved, image_excluded, live_completed, provider_disabled, transfer_approved,
    provider_verified, critical_regression. A release may close images and live runs by a decision, the final status only by approval.
    """
    core, approved, transfer = _true("core_passed"), _true("image_approved"), _true("transfer_approved")
    image, live = approved | _true("image_excluded"), _true("live_completed") | _true("provider_disabled")
    blockers = F.array_compact(F.array(F.when(~core, F.lit(CORE)), F.when(~image, F.lit(IMAGE)), F.when(~live, F.lit(LIVE))))
    version = F.when(_true("critical_regression") | ~core, "v0.9").when(_true("provider_verified") & approved, "v1.0").otherwise("v1.0-rc1")
    provider = F.when(transfer, "READY_FOR_APPROVED_LIVE_SUBSET").otherwise("BLOCKED_BY_EXTERNAL_TRANSFER_APPROVAL")
    return states.select(key, _ladder(core, image, live).alias("release_status"), blockers.alias("blockers"), _ladder(core, approved, transfer).alias("final_status"), provider.alias("provider_status"), version.alias("version"))
