"""Contracts, gold, frozen rankings, queues and ladders over the given tables. What a case expects comes from its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import release
from quillspark.plans import questions as P
from quillspark.queries import plan
from quillspark.queries.common import SQL_GOLD, bm25_top, gold, planted, sql_bm25, table
from quillspark.queries.metrics import THREE, bm25_minimal_top, fused_top

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _columns(df, columns: dict[str, str]):
    return df.select(*[F.expr(v).alias(k) for k, v in columns.items()])


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


# Sources are named by where they come from; a page is a document's number of five. Every seventh question expects a wrong page, every
# third any page, every second a quote. The tables hold no times: the length of a question stands for them.
_PAGE = "CASE WHEN query_id % 3 = 0 THEN NULL WHEN query_id % 7 = 0 THEN 9 ELSE doc_id % 5 END"
_QUOTE = "CASE WHEN query_id % 2 = 0 THEN substring(text, 10, 40) END"
_LOCAL = f"""WITH {sql_bm25()}, {SQL_GOLD},
want AS (SELECT query_id, source AS name, {_PAGE} AS page, coalesce(trim(regexp_replace({_QUOTE}, '\\s+', ' ', 'g')), '') AS quote FROM gold JOIN documents ON doc_id = chunk_id),
hit AS (SELECT query_id, source AS name, doc_id % 5 AS page, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM bm_top JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
m AS (SELECT w.query_id, EXISTS (SELECT 1 FROM hit WHERE hit.query_id = w.query_id AND hit.name = w.name AND (w.page IS NULL OR hit.page = w.page) AND contains(hit.text, w.quote)) AS ok FROM want w),
r AS (SELECT item_id AS query_id, length(text) / 1000::DOUBLE AS seconds, (SELECT count(*) FROM m WHERE m.query_id = item_id) AS expected, (SELECT count(*) FROM m WHERE m.query_id = item_id AND ok) AS matched, (SELECT count(*) FROM hit WHERE hit.query_id = item_id) AS retrieved FROM benchmark),
rows_ AS (SELECT query_id, expected, matched, CASE WHEN expected > 0 THEN matched = expected ELSE retrieved = 0 END AS passed, retrieved, seconds FROM r)"""


def _local(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    of = lambda df: df.withColumnRenamed("chunk_id", "doc_id").join(docs, "doc_id")
    expected = _columns(of(gold(spark, sf)), {"query_id": "query_id", "name": "source", "page": _PAGE, "quote": _QUOTE})
    hits = _columns(of(bm25_top(spark, sf, 5)), {"query_id": "query_id", "name": "source", "page": "doc_id % 5", "text": "text"})
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.length("text") / 1000).alias("seconds"))
    return release.local_evaluation(cases, expected, hits)


@query("m18_local_cases", f"{_LOCAL} SELECT query_id, expected, matched, passed, retrieved, round(seconds, 6) AS seconds FROM rows_")
def m18_cases(spark, sf):
    return _local(spark, sf).withColumn("seconds", F.round("seconds", 6))


@query(
    "m18_local_summary",
    f"{_LOCAL} SELECT count(*) AS cases, count(*) FILTER (passed) AS passed, round(sum(matched) / sum(expected), 6)::DOUBLE AS recall, round(quantile_cont(seconds, 0.5), 6) AS median_seconds, round(quantile_cont(seconds, 0.95), 6) AS p95_seconds FROM rows_",
)
def m18_summary(spark, sf):
    return release.local_summary(_local(spark, sf)).select("cases", "passed", *[F.round(c, 6).alias(c) for c in ("recall", "median_seconds", "p95_seconds")])


# Every turn of the conversations with a question planted: its own kind and domain, and what else a run would have told.
_EXPECTED = "CASE id % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate([*release.COMPATIBLE, "fact"])) + " END"
_CASE = {
    "case_id": "id",
    "expected_behavior": "CASE WHEN id % 23 = 0 THEN 'later' WHEN id % 5 = 3 THEN 'abstain' WHEN id % 5 = 4 THEN 'pending_human_review' ELSE 'answer' END",
    "expected_intent": _EXPECTED,
    "intent": "intent",
    "domain": "domain",
    "route_status": "CASE WHEN id % 7 < 4 THEN 'pending_image_review' ELSE 'ready' END",
    "pre_supported": "id % 6 <> 0",
    "post_supported": "id % 8 <> 0",
    "structured_supported": "CASE WHEN id % 9 = 0 THEN true END",
    "n_selected": "CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END",
    "n_structured": "CASE WHEN id % 4 = 0 THEN NULL ELSE id % 2 END",
    "provider_calls": "CASE WHEN id % 31 = 0 THEN 1 ELSE 0 END",
    "vision_calls": "CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END",
}
_FITS = "CASE expected_intent " + " ".join(f"WHEN '{k}' THEN intent IN {str(v) if len(v) > 1 else f'({v[0]!r})'}" for k, v in release.COMPATIBLE.items()) + " ELSE intent = expected_intent END"


@query(
    "m19_uat_contract",
    f"""WITH k AS ({plan.ORACLES['p02_intent']}), d AS ({plan.ORACLES['p03_domain']}), c AS (SELECT {_sql(_CASE)} FROM (SELECT id, kind AS intent, domain FROM k JOIN d USING (id))),
f AS (SELECT *, expected_behavior = 'answer' AS ans, expected_behavior = 'abstain' AS abst, expected_behavior = 'pending_human_review' AS pend, coalesce(structured_supported, false) AS st, {_FITS} AS fits FROM c),
r AS (SELECT case_id, concat_ws(',', CASE WHEN provider_calls > 0 THEN 'unexpected_provider_call' END, CASE WHEN vision_calls > 0 THEN 'unexpected_vision_call' END,
 CASE WHEN abst AND domain = 'hospital' THEN 'out_of_scope_domain_mismatch' END, CASE WHEN abst AND (pre_supported OR post_supported OR n_selected > 0) THEN 'unsafe_out_of_scope_admission' END,
 CASE WHEN pend AND route_status <> 'pending_image_review' THEN 'image_review_gate_missing' END, CASE WHEN pend AND n_selected > 0 THEN 'unapproved_image_evidence_selected' END,
 CASE WHEN ans AND domain <> 'hospital' THEN 'hospital_domain_mismatch' END, CASE WHEN ans AND NOT fits THEN 'intent_mismatch' END, CASE WHEN ans AND NOT (pre_supported OR st) THEN 'pre_budget_not_supported' END,
 CASE WHEN ans AND NOT (post_supported OR st) THEN 'post_budget_not_supported' END, CASE WHEN ans AND n_selected + coalesce(n_structured, 0) = 0 THEN 'missing_selected_evidence' END, CASE WHEN NOT (ans OR abst OR pend) THEN 'unknown_expected_behavior' END) AS reasons FROM f)
SELECT case_id, reasons = '' AS passed, reasons FROM r""",
)
def m19_contract(spark, sf):
    q = planted(spark, sf, plan.ASK).select("id", P.classify(F.col("q")).alias("intent"), plan.domain(F.col("q")).alias("domain"))
    return release.uat_contract(_columns(q, _CASE)).withColumn("reasons", F.array_join("reasons", ","))


# What an item's label expects; every tenth has no gold of its own, every third expects that nothing is told.
_ABSTAIN, _SAFE, _ELIGIBLE = "query_id % 3 = 2", "query_id % 2 = 0", "query_id % 5 <> 1"


@query(
    "m20_gold_labels",
    f"""WITH {sql_bm25()}, {SQL_GOLD}, x AS (SELECT item_id AS query_id, (SELECT count(*) FROM gold WHERE gold.query_id = item_id) AS n, EXISTS (SELECT 1 FROM gold JOIN bm_top USING (query_id, chunk_id) WHERE query_id = item_id AND rank <= 5) AS hit FROM benchmark),
m AS (SELECT query_id, {_ELIGIBLE} AS eligible, CASE WHEN {_ABSTAIN} THEN {_SAFE} WHEN n > 0 AND query_id % 10 <> 0 THEN hit END AS match FROM x) SELECT query_id AS case_id, match AS candidate_match, CASE WHEN eligible THEN match END AS aggregate_match, eligible FROM m""",
)
def m20_labels(spark, sf):
    ids = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias(name))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    rows = items.join(ids(gold(spark, sf), "gold_ids"), "query_id", "left").join(ids(bm25_top(spark, sf, 5), "selected_ids"), "query_id", "left")
    return release.gold_match(_columns(rows, {"case_id": "query_id", "expected_abstain": _ABSTAIN, "safely_abstained": _SAFE, "eligible": _ELIGIBLE, "gold_ids": "CASE WHEN query_id % 10 <> 0 THEN gold_ids END", "selected_ids": "selected_ids"}))


# Two strategies are planted: one leaves out every seventh question, one ranks its first document twice.
_KIND = "CASE query_id % 4 WHEN 1 THEN 'table' WHEN 2 THEN 'mixed' WHEN 3 THEN 'text' END"
_COUNTED = "query_id % 5 <> 4"


@query(
    "m21_frozen_rankings",
    f"""{THREE}, c AS (SELECT DISTINCT query_id, {_KIND} AS kind, {_COUNTED} AS counted FROM gold),
one AS (SELECT every.*, kind FROM every JOIN c USING (query_id) WHERE counted),
e AS (SELECT engine AS strategy, * FROM one UNION ALL SELECT 'partial', * FROM one WHERE engine = 'rrf' UNION ALL SELECT 'repeated', * FROM one WHERE engine = 'bm25'),
ok AS (SELECT strategy, CASE strategy WHEN 'partial' THEN CASE WHEN EXISTS (SELECT 1 FROM gold WHERE query_id % 7 = 0) THEN 'case_coverage_drift' ELSE '' END WHEN 'repeated' THEN 'invalid_ranked_ids' ELSE '' END AS problem FROM (VALUES ('bm25'), ('minimal'), ('rrf'), ('partial'), ('repeated')) t(strategy)),
s AS (SELECT unnest(['all', 'table']) AS subset)
SELECT ok.strategy, s.subset, problem, count(e.query_id)::BIGINT AS cases, round(avg(mrr), 6) AS mrr, round(avg(hit_at_10), 6) AS hit_at_10, round(avg(recall_at_5), 6) AS recall_at_5 FROM ok CROSS JOIN s LEFT JOIN e ON problem = '' AND e.strategy = ok.strategy AND (s.subset = 'all' OR kind IN ('table', 'mixed')) GROUP BY ALL""",
)
def m21_frozen(spark, sf):
    own = gold(spark, sf)
    cases = _columns(own.select("query_id").distinct(), {"query_id": "query_id", "evidence_type": _KIND, "eligible": _COUNTED})
    bm25, fused = bm25_top(spark, sf), fused_top(spark, sf)
    first = bm25.filter("rank = 1").withColumn("rank", F.lit(10))
    given = {"bm25": bm25, "minimal": bm25_minimal_top(spark, sf), "rrf": fused, "partial": fused.filter("query_id % 7 <> 0"), "repeated": bm25.filter("rank < 10").unionByName(first, allowMissingColumns=True)}
    ranked = None
    for name, df in given.items():
        one = df.join(cases.select("query_id"), "query_id", "left_semi").select(F.lit(name).alias("strategy"), "query_id", "rank", "chunk_id")
        ranked = one if ranked is None else ranked.unionByName(one)
    rows = release.fixed_rankings(cases, own, ranked)
    return rows.select("strategy", "subset", F.coalesce("problem", F.lit("")).alias("problem"), "cases", *[F.round(c, 6).alias(c) for c in ("mrr", "hit_at_10", "recall_at_5")])


_WAITS = {
    "case_id": "doc_id",
    "evidence_type": "CASE doc_id % 9 WHEN 0 THEN 'image_pending' WHEN 1 THEN 'table' WHEN 2 THEN NULL ELSE 'text' END",
    "note": "CASE doc_id % 11 WHEN 0 THEN 'An AMBIGUOUS question' WHEN 1 THEN '질문이 모호함' WHEN 2 THEN NULL ELSE text END",
    "image_required": "doc_id % 17 = 0",
    "table_required": "CASE WHEN doc_id % 13 = 0 THEN true END",
    "n_primary": "coalesce(quality, 0)",
    "n_acceptable": "toxic",
    "n_chunks": "length(text) % 4",
    "n_rows": "CASE WHEN length(text) % 3 = 0 THEN 1 END",
}
_CATEGORY = """CASE WHEN image_required OR starts_with(coalesce(evidence_type, ''), 'image') THEN 'image_human_review_required' WHEN contains(lower(coalesce(note, '')), '모호') OR contains(lower(coalesce(note, '')), 'ambiguous') THEN 'ambiguous_question'
 WHEN coalesce(table_required, false) OR evidence_type = 'table' THEN 'table_structure_or_mapping' WHEN n_chunks = 0 THEN 'retrieval_miss' WHEN n_primary = 0 THEN 'insufficient_candidate_evidence' ELSE 'other' END"""
_SQL_WAITS = f"""WITH w AS (SELECT {_sql(_WAITS)} FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT *, {_CATEGORY} AS category FROM w),
z AS (SELECT case_id, category, CASE category {' '.join(f"WHEN '{c}' THEN '{v}'" for c, v in release.LAYERS.items())} END AS layer, CASE WHEN n_primary > 0 OR coalesce(n_acceptable, 0) > 0 OR n_chunks > 0 OR coalesce(n_rows, 0) > 0 THEN 'candidate_present_not_final_gold' ELSE 'not_found_in_current_candidates' END AS evidence_status FROM k)"""


def _waiting(spark, sf):
    return release.deferred(_columns(table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left"), _WAITS))


@query("m22_deferred_cases", f"{_SQL_WAITS} SELECT * FROM z")
def m22_cases(spark, sf):
    return _waiting(spark, sf)


@query("m22_deferred_counts", f"{_SQL_WAITS} SELECT category, layer, evidence_status, count(*) AS n FROM z GROUP BY ALL")
def m22_counts(spark, sf):
    return _waiting(spark, sf).groupBy("category", "layer", "evidence_status").agg(F.count("*").alias("n"))


# A case of release for each source and language: what its labels tell, and decisions by its number of documents.
_STATE = {
    "unit": "concat(source, '/', lang)",
    "core_passed": "bad * 3 < n",
    "image_approved": "total % 3 = 0",
    "image_excluded": "total % 4 = 1",
    "live_completed": "CASE WHEN total % 5 < 2 THEN true END",
    "provider_disabled": "total % 7 = 0",
    "transfer_approved": "total % 2 = 0",
    "provider_verified": "total % 3 <> 1",
    "critical_regression": "toxic_n > 3",
}
_COUNTS = {"n": "count(quality)", "bad": "coalesce(sum(1 - quality), 0)", "toxic_n": "coalesce(sum(toxic), 0)", "total": "sum(length(text))"}
_RUNG = lambda image, live: f"CASE WHEN NOT core_passed THEN 'NOT_READY' WHEN NOT {image} AND NOT {live} THEN 'READY_EXCEPT_IMAGE_AND_LIVE_RAGAS' WHEN NOT {image} THEN 'READY_EXCEPT_IMAGE_HUMAN_REVIEW' WHEN NOT {live} THEN 'READY_EXCEPT_LIVE_RAGAS' ELSE 'READY' END"


@query(
    "m23_ladders",
    f"""WITH g AS (SELECT source, lang, {_sql(_COUNTS)} FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2), s AS (SELECT {_sql(_STATE)} FROM g),
x AS (SELECT *, image_approved OR image_excluded AS image, coalesce(live_completed, false) OR provider_disabled AS live FROM s)
SELECT unit, {_RUNG('image', 'live')} AS release_status, concat_ws(',', CASE WHEN NOT core_passed THEN '{release.CORE}' END, CASE WHEN NOT image THEN '{release.IMAGE}' END, CASE WHEN NOT live THEN '{release.LIVE}' END) AS blockers, {_RUNG('image_approved', 'transfer_approved')} AS final_status,
CASE WHEN transfer_approved THEN 'READY_FOR_APPROVED_LIVE_SUBSET' ELSE 'BLOCKED_BY_EXTERNAL_TRANSFER_APPROVAL' END AS provider_status, CASE WHEN critical_regression OR NOT core_passed THEN 'v0.9' WHEN provider_verified AND image_approved THEN 'v1.0' ELSE 'v1.0-rc1' END AS version FROM x""",
)
def m23_ladders(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    g = docs.groupBy("source", "lang").agg(*[F.expr(v).alias(k) for k, v in _COUNTS.items()])
    return release.ladders(_columns(g, _STATE), "unit").withColumn("blockers", F.array_join("blockers", ","))
