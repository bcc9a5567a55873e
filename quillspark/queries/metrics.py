"""Evaluation queries: metrics of ranked results, their aggregates, comparisons and decisions."""

from __future__ import annotations


from pyspark.sql import functions as F

from quillspark.operators import decisions, metrics
from quillspark.queries.common import MINIMAL, SQL_GOLD, bm25_minimal_top, bm25_top, gold, literal, sql_bm25, sql_metrics, table, values
from quillspark.queries.retrieval import SQL_RRF, fused_top

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


N = ", ".join(metrics.NAMES)
MET = f"WITH {sql_bm25()}, {SQL_GOLD}, {sql_metrics('bm_top')}"
THREE = f"WITH {SQL_RRF}, {SQL_GOLD}, {sql_metrics('bm_top', 'm1')}, {sql_metrics('mi_top', 'm2')}, {sql_metrics('rr_top', 'm3')}, every AS (SELECT 'bm25' AS engine, * FROM m1 UNION ALL SELECT 'minimal', * FROM m2 UNION ALL SELECT 'rrf', * FROM m3)"


def bm25_metrics(spark, sf):
    return metrics.ranked_metrics(bm25_top(spark, sf), gold(spark, sf))


def three_metrics(spark, sf):
    rankings = {"bm25": bm25_top(spark, sf), "minimal": bm25_minimal_top(spark, sf), "rrf": fused_top(spark, sf)}
    return metrics.unions({k: metrics.ranked_metrics(r, gold(spark, sf)) for k, r in rankings.items()})


@query("m01_metrics", f"{MET} SELECT query_id AS item_id, {N} FROM met")
def m01(spark, sf):
    return bm25_metrics(spark, sf).withColumnRenamed("query_id", "item_id")


@query(
    "m02_context_scores",
    f"{MET} SELECT g.query_id AS item_id, round(count(t.chunk_id) / (SELECT count(*) FROM bm_top x WHERE x.query_id = g.query_id), 6)::DOUBLE AS context_precision, round(count(t.chunk_id) / count(*), 6)::DOUBLE AS context_recall FROM gold g LEFT JOIN bm_top t ON t.query_id = g.query_id AND t.chunk_id = g.chunk_id GROUP BY g.query_id",
)
def m02(spark, sf):
    found = bm25_top(spark, sf).groupBy("query_id").agg(F.collect_set("chunk_id").alias("got"))  # ten ids each
    want = gold(spark, sf).groupBy("query_id").agg(F.collect_set("chunk_id").alias("want"))
    both = F.size(F.array_intersect("got", "want"))
    return want.join(found, "query_id").select(F.col("query_id").alias("item_id"), F.round(both / F.size("got"), 6).alias("context_precision"), F.round(both / F.size("want"), 6).alias("context_recall"))


_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in metrics.NAMES)
_TYPE = "CASE item_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'procedure' ELSE 'summary' END"


def _typed(df, key="query_id"):
    return df.withColumn("question_type", F.when(F.col(key) % 3 == 0, "fact").when(F.col(key) % 3 == 1, "procedure").otherwise("summary"))


@query("m03_aggregate", f"{MET}, t AS (SELECT {_TYPE.replace('item_id', 'query_id')} AS question_type, * FROM met) SELECT CASE WHEN grouping(question_type) = 1 THEN 'overall' ELSE question_type END AS question_type, count(*) AS cases, {_MEANS} FROM t GROUP BY GROUPING SETS ((), (question_type))")
def m03(spark, sf):
    return metrics.aggregate(_typed(bm25_metrics(spark, sf)), "question_type")


# Gold is the union of primary and acceptable ids; a question without results scores zero throughout.
_M04 = [(1, "a", "primary"), (1, "b", "acceptable"), (1, "a", "acceptable"), (2, "c", "primary"), (3, "d", "primary"), (3, "e", "acceptable")]
_M04R = [(1, "b", 1), (1, "x", 2), (1, "a", 3), (2, "y", 1), (2, "z", 2)]


@query("m04_union_gold", f"WITH g0 AS {values(_M04, 'query_id, chunk_id, kind')}, gold AS (SELECT DISTINCT query_id, chunk_id FROM g0), rk AS {values(_M04R, 'query_id, chunk_id, rank')}, {sql_metrics('rk')} SELECT query_id::BIGINT AS query_id, {N} FROM met")
def m04(spark, sf):
    own = literal(spark, _M04, "query_id long, chunk_id string, kind string").select("query_id", "chunk_id").distinct()
    return metrics.ranked_metrics(literal(spark, _M04R, "query_id long, chunk_id string, rank int"), own)


@query(
    "m05_failure_category",
    f"""{MET}, o AS (SELECT query_id, count(*) AS gold_n, count(*) FILTER (lang <> 'en') AS outside_n FROM gold JOIN documents ON doc_id = chunk_id GROUP BY 1)
SELECT query_id AS item_id, CASE WHEN gold_n = outside_n THEN 'gold_not_in_corpus' WHEN outside_n > 0 THEN 'gold_partially_outside_corpus' WHEN hit_at_10 = 0 THEN 'no_gold_hit_top_10' WHEN hit_at_1 = 0 THEN 'gold_below_rank_1' ELSE 'none' END AS failure_category FROM met JOIN o USING (query_id)""",
)
def m05(spark, sf):
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    outside = gold(spark, sf).join(lang, "chunk_id").groupBy("query_id").agg(F.count("*").alias("gold_n"), F.count_if(F.col("lang") != "en").alias("outside_n"))  # a corpus of English documents only
    return metrics.failure_category(bm25_metrics(spark, sf).join(outside, "query_id")).select(F.col("query_id").alias("item_id"), "failure_category")


@query(
    "m06_failure_histogram",
    f"""{MET}, f AS (SELECT query_id, CASE WHEN hit_at_10 = 0 THEN 'no_gold_hit_top_10' WHEN hit_at_1 = 0 THEN 'gold_below_rank_1' ELSE 'none' END AS failure_category FROM met)
SELECT failure_category, count(*) AS n, string_agg(query_id::VARCHAR, ',' ORDER BY query_id) AS case_ids FROM f GROUP BY 1""",
)
def m06(spark, sf):
    f = metrics.failure_category(bm25_metrics(spark, sf).select("*", F.lit(1).alias("gold_n"), F.lit(0).alias("outside_n")))
    return f.groupBy("failure_category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("case_ids"))


@query("m07_long_rows", f"WITH {sql_bm25()}, {SQL_GOLD} SELECT t.query_id AS item_id, k::BIGINT AS k, rank, t.chunk_id AS doc_id, g.chunk_id IS NOT NULL AS is_gold FROM bm_top t LEFT JOIN gold g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id, (VALUES (1), (3), (5), (10)) c(k) WHERE rank <= k")
def m07(spark, sf):
    rows = metrics.long_rows(bm25_top(spark, sf), gold(spark, sf))
    return rows.select(F.col("query_id").alias("item_id"), F.col("k").cast("long"), F.col("rank").cast("long"), F.col("chunk_id").alias("doc_id"), "is_gold")


_TWO = f"WITH {sql_bm25()}, {sql_bm25('mi', MINIMAL)}, v AS (SELECT 'bm25' AS engine, score FROM bm_top UNION ALL SELECT 'minimal', score FROM mi_top)"


def _two_scores(spark, sf):
    return metrics.unions({"bm25": bm25_top(spark, sf), "minimal": bm25_minimal_top(spark, sf)}).select("engine", "score")


@query("m08_distribution", f"{_TWO} SELECT engine, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS minimum, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.95), 6) AS p95, max(score) AS maximum FROM v GROUP BY 1")
def m08(spark, sf):
    return metrics.distribution(_two_scores(spark, sf), "engine", "score")


@query(
    "m09_p95_variants",
    f"""{_TWO}, l AS (SELECT engine, list(score ORDER BY score) AS s, round(quantile_cont(score, 0.95), 6) AS p95_linear FROM v GROUP BY 1)
SELECT engine, p95_linear, s[1 + floor((len(s) - 1) * 0.95::DOUBLE + 0.999999)::BIGINT] AS p95_up, s[1 + greatest(floor(len(s) * 0.95::DOUBLE)::BIGINT - 1, 0)] AS p95_down FROM l""",
)
def m09(spark, sf):
    return metrics.p95_variants(_two_scores(spark, sf), "engine", "score")


@query(
    "m10_negative_diagnostics",
    f"""WITH {sql_bm25()}, {SQL_GOLD}, t AS (SELECT b.item_id, b.item_id IN (SELECT query_id FROM gold) AS positive, max(score) FILTER (rank = 1) AS top, count(rank) AS n FROM benchmark b LEFT JOIN bm_top ON query_id = b.item_id GROUP BY 1)
SELECT count(*) FILTER (positive AND n > 0) AS positive_n, count(*) FILTER (NOT positive AND n > 0) AS negative_n, round(avg(top) FILTER (positive), 6) AS pos_mean, round(avg(top) FILTER (NOT positive), 6) AS neg_mean,
round(avg(top) FILTER (positive) - avg(top) FILTER (NOT positive), 6) AS separation, round(avg(n) FILTER (NOT positive), 6) AS neg_returned FROM t""",
)
def m10(spark, sf):
    answered = gold(spark, sf).select("query_id").distinct().withColumn("positive", F.lit(True))
    top = bm25_top(spark, sf).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.count("*").alias("n"))
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(answered, "query_id", "left").join(top, "query_id", "left").select(F.coalesce("positive", F.lit(False)).alias("p"), "top", F.coalesce("n", F.lit(0)).alias("n"))
    pos, neg = F.avg(F.when(F.col("p"), F.col("top"))), F.avg(F.when(~F.col("p"), F.col("top")))
    return t.agg(F.count_if(F.col("p") & (F.col("n") > 0)).alias("positive_n"), F.count_if(~F.col("p") & (F.col("n") > 0)).alias("negative_n"), F.round(pos, 6).alias("pos_mean"), F.round(neg, 6).alias("neg_mean"), F.round(pos - neg, 6).alias("separation"), F.round(F.avg(F.when(~F.col("p"), F.col("n"))), 6).alias("neg_returned"))


@query("m11_engine_summary", f"{THREE} SELECT engine, count(*) AS cases, {_MEANS} FROM every GROUP BY 1")
def m11(spark, sf):
    return three_metrics(spark, sf).groupBy("engine").agg(F.count("*").alias("cases"), *[F.round(F.avg(n), 6).alias(n) for n in metrics.NAMES])


_KEY = "(hit_at_10, mrr, recall_at_10, precision_at_10)"


@query(
    "m12_winners",
    f"""{THREE}, k AS (SELECT engine, query_id, row(hit_at_10, mrr, recall_at_10, precision_at_10) AS key FROM every), b AS (SELECT query_id, max(key) AS best, count(DISTINCT key) = 1 AS complete_tie FROM k GROUP BY 1)
SELECT query_id AS item_id, string_agg(engine, ',' ORDER BY engine) FILTER (key = best) AS winners, any_value(complete_tie) AS complete_tie FROM k JOIN b USING (query_id) GROUP BY 1""",
)
def m12(spark, sf):
    return metrics.winners(three_metrics(spark, sf)).withColumnRenamed("query_id", "item_id")


@query(
    "m13_priority_groups",
    f"""{THREE}, p AS (SELECT query_id, {', '.join(f"max({m}) FILTER (engine = '{e}') AS {e}_{m}" for e in ('bm25', 'minimal', 'rrf') for m in metrics.ORDER)} FROM every GROUP BY 1)
SELECT query_id AS item_id, minimal_hit_at_10 = 1 AND bm25_hit_at_10 = 0 AND rrf_hit_at_10 = 0 AS only_minimal, row(bm25_hit_at_10, bm25_mrr, bm25_recall_at_10, bm25_precision_at_10) > row(rrf_hit_at_10, rrf_mrr, rrf_recall_at_10, rrf_precision_at_10) AS bm25_over_rrf,
rrf_mrr > minimal_mrr AS rrf_mrr_over_minimal, bm25_hit_at_10 + minimal_hit_at_10 + rrf_hit_at_10 = 0 AS all_failed,
bm25_hit_at_10 = minimal_hit_at_10 AND bm25_hit_at_10 = rrf_hit_at_10 AND (NOT (bm25_recall_at_10 = minimal_recall_at_10 AND bm25_recall_at_10 = rrf_recall_at_10) OR NOT (bm25_precision_at_10 = minimal_precision_at_10 AND bm25_precision_at_10 = rrf_precision_at_10)) AS same_hit FROM p""",
)
def m13(spark, sf):
    return decisions.priority_groups(three_metrics(spark, sf)).withColumnRenamed("query_id", "item_id")


@query(
    "m14_before_after",
    f"""{THREE}, m AS (SELECT engine, avg(hit_at_10) AS hit_at_10, avg(mrr) AS mrr, avg(recall_at_10) AS recall_at_10, avg(precision_at_10) AS precision_at_10 FROM every GROUP BY 1), u AS (UNPIVOT m ON hit_at_10, mrr, recall_at_10, precision_at_10 INTO NAME metric VALUE v)
SELECT metric, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta, round(a.v - b.v, 6) < 0 AS regression FROM u b JOIN u a USING (metric) WHERE b.engine = 'minimal' AND a.engine = 'bm25'""",
)
def m14(spark, sf):
    return decisions.before_after(three_metrics(spark, sf), "minimal", "bm25")


@query(
    "m15_strategy",
    f"""{THREE}, c AS (SELECT engine, round((avg(hit_at_5) + avg(hit_at_10) + avg(mrr) + avg(recall_at_10)) / 4, 9) AS core FROM every GROUP BY 1)
SELECT engine AS selected, round(core, 6) AS core FROM c ORDER BY c.core DESC, CASE engine WHEN 'bm25' THEN 0 WHEN 'minimal' THEN 1 ELSE 2 END LIMIT 1""",
)
def m15(spark, sf):
    return decisions.select_strategy(decisions.core_scores(three_metrics(spark, sf)), ["bm25", "minimal", "rrf"])


# Verdicts of fixed rules over our own summaries: minimal BM25, current BM25 and vectors; four core metrics each.
_M16 = [
    (1, [0.5, 0.5, 0.5, 0.5], [0.5, 0.5, 0.5, 0.5], [0.6, 0.6, 0.6, 0.5]),
    (2, [0.7, 0.7, 0.7, 0.6], [0.72, 0.7, 0.7, 0.6], [0.5, 0.5, 0.5, 0.6]),
    (3, [0.5, 0.5, 0.5, 0.5], [0.6, 0.6, 0.6, 0.6], [0.58, 0.6, 0.6, 0.55]),
    (4, [0.5, 0.5, 0.5, 0.5], [0.7, 0.7, 0.7, 0.7], [0.5, 0.5, 0.5, 0.5]),
    (5, [0.62, 0.6, 0.6, 0.6], [0.66, 0.66, 0.66, 0.66], [0.58, 0.58, 0.58, 0.6]),
]


@query(
    "m16_verdict",
    f"""WITH s AS {values(_M16, 'case_id, minimal, current, vec')}, c AS (SELECT *, round(list_avg(minimal), 9) AS m, round(list_avg(current), 9) AS b, round(list_avg(vec), 9) AS v,
len(list_filter([1, 2, 3, 4], lambda i: minimal[i] > vec[i])) AS mw, len(list_filter([1, 2, 3, 4], lambda i: vec[i] > current[i])) AS vw FROM s)
SELECT case_id::BIGINT AS case_id, CASE WHEN round(v - b, 9) >= 0.05 AND vw >= 3 THEN 'D' WHEN round(m - v, 9) >= 0.05 AND mw >= 3 THEN 'A' WHEN v >= round(b - 0.05, 9) THEN 'C' WHEN round(b - m, 9) >= 0.05 AND m <= round(v + 0.03, 9) THEN 'B' WHEN m > v THEN 'A' ELSE 'B' END AS code FROM c""",
)
def m16(spark, sf):
    return decisions.fairness_verdict(literal(spark, _M16, "case_id long, minimal array<double>, current array<double>, vec array<double>"))


@query("m17_complementary", f"{THREE}, p AS (SELECT query_id, max(hit_at_1) FILTER (engine = 'bm25') AS a, max(hit_at_1) FILTER (engine = 'rrf') AS b FROM every GROUP BY 1) SELECT bool_or(a > b) AND bool_or(b > a) AS complementary, count(*) FILTER (a > b) AS first_only, count(*) FILTER (b > a) AS second_only FROM p")
def m17(spark, sf):
    return decisions.complementary(three_metrics(spark, sf), "bm25", "rrf", "hit_at_1")


@query(
    "m18_local_evaluation",
    f"""WITH {sql_bm25()}, {SQL_GOLD}, x AS (SELECT b.item_id, count(DISTINCT g.chunk_id) AS want, count(DISTINCT g.chunk_id) FILTER (t.rank <= 5) AS got FROM benchmark b LEFT JOIN gold g ON g.query_id = b.item_id LEFT JOIN bm_top t ON t.query_id = g.query_id AND t.chunk_id = g.chunk_id GROUP BY 1)
SELECT count(*) FILTER (want > 0) AS cases, count(*) FILTER (want > 0 AND got = want) AS passed, round(sum(got) / sum(want), 6)::DOUBLE AS recall, round(median(got) FILTER (want > 0), 6)::DOUBLE AS median_found FROM x""",
)
def m18(spark, sf):
    top = bm25_top(spark, sf).filter("rank <= 5").select("query_id", "chunk_id", F.lit(1).alias("hit"))
    x = gold(spark, sf).join(top, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("want"), F.count("hit").alias("got"))
    return x.agg(F.count("*").alias("cases"), F.count_if(F.col("got") == F.col("want")).alias("passed"), F.round(F.sum("got") / F.sum("want"), 6).alias("recall"), F.round(F.median("got"), 6).alias("median_found"))


# What a case expects and what happened.
_M19 = [
    (1, "answer", "procedure", "procedure", True, "text", "text"),
    (2, "answer", "summary", "fact", True, "text", "text"),
    (3, "answer", "fact", "fact", False, "text", "table"),
    (4, "abstain", "fact", "fact", True, "text", "text"),
    (5, "abstain", "fact", "fact", False, "text", "text"),
    (6, "pending", "fact", "procedure", False, "image", "image"),
]


@query(
    "m19_case_contract",
    f"""WITH c AS {values(_M19, 'case_id, behavior, want_kind, kind, answered, want_evidence, evidence')}
SELECT case_id::BIGINT AS case_id, r = '' AS passed, r AS reasons FROM (SELECT case_id, concat_ws(',', CASE WHEN behavior = 'answer' AND NOT answered THEN 'missing_answer' END, CASE WHEN behavior <> 'answer' AND answered THEN 'unexpected_answer' END,
CASE WHEN NOT (want_kind = kind OR (want_kind = 'summary' AND kind IN ('fact', 'synthesis'))) THEN 'intent' END, CASE WHEN want_evidence <> evidence THEN 'evidence_type' END) AS r FROM c)""",
)
def m19(spark, sf):
    return decisions.case_contract(literal(spark, _M19, "case_id long, behavior string, want_kind string, kind string, answered boolean, want_evidence string, evidence string"))


_M20 = [(1, ["a", "b"], ["b"], False, True), (2, ["a"], ["c"], False, True), (3, [], [], True, True), (4, ["a"], [], True, True), (5, ["a"], ["a"], False, False)]


@query(
    "m20_gold_match",
    f"WITH c AS {values(_M20, 'case_id, found, gold, abstain, labelled')} SELECT case_id::BIGINT AS case_id, labelled AS eligible, CASE WHEN NOT labelled THEN NULL WHEN abstain THEN len(found) = 0 ELSE list_has_any(found, gold) END AS gold_match FROM c",
)
def m20(spark, sf):
    c = literal(spark, _M20, "case_id long, found array<string>, gold array<string>, abstain boolean, labelled boolean")
    return c.select("case_id", F.col("labelled").alias("eligible"), F.when(F.col("labelled"), F.when(F.col("abstain"), F.size("found") == 0).otherwise(F.arrays_overlap("found", "gold"))).alias("gold_match"))


@query("m21_strategies_by_type", f"{THREE} SELECT engine, {_TYPE.replace('item_id', 'query_id')} AS question_type, count(*) AS cases, round(avg(mrr), 6) AS mrr, round(avg(hit_at_10), 6) AS hit_at_10 FROM every GROUP BY ALL")
def m21(spark, sf):
    return _typed(three_metrics(spark, sf)).groupBy("engine", "question_type").agg(F.count("*").alias("cases"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("hit_at_10"), 6).alias("hit_at_10"))


# Documents whose labels say why they wait: no label, toxic, low quality, or nothing.
_QUEUE = "CASE WHEN l.doc_id IS NULL THEN 'needs_label' WHEN toxic = 1 THEN 'safety_review' WHEN quality = 0 THEN 'quality_review' ELSE 'ready' END"


@query("m22_deferred_queue", f"SELECT lang, {_QUEUE} AS queue, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def m22(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    return joined.groupBy("lang", decisions.queue().alias("queue")).agg(F.count("*").alias("n"))


@query(
    "m23_readiness",
    f"""WITH q AS (SELECT source, count(*) AS n, count(*) FILTER (q <> 'ready') AS waiting, count(*) FILTER (q = 'safety_review') AS unsafe FROM (SELECT source, {_QUEUE} AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1)
SELECT source, n, waiting, unsafe, CASE WHEN unsafe * 10 > n THEN 'blocked' WHEN waiting * 10 > n * 7 THEN 'needs_review' WHEN waiting > 0 THEN 'conditionally_ready' ELSE 'ready' END AS status FROM q""",
)
def m23(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    q = joined.withColumn("q", decisions.queue()).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("q") != "ready").alias("waiting"), F.count_if(F.col("q") == "safety_review").alias("unsafe"))
    return q.withColumn("status", decisions.readiness())


@query(
    "m24_dataset_contract",
    """WITH l AS (SELECT * FROM labels), d AS (SELECT doc_id, count(*) AS c FROM documents GROUP BY 1)
SELECT 'duplicate_document_ids' AS rule, count(*) AS violations FROM d WHERE c > 1 UNION ALL SELECT 'labels_without_document', count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)
UNION ALL SELECT 'quality_out_of_range', count(*) FROM l WHERE quality NOT IN (0, 1) UNION ALL SELECT 'toxic_out_of_range', count(*) FROM l WHERE toxic NOT IN (0, 1)
UNION ALL SELECT 'length_drift', count(*) FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'duplicate_questions', count(*) FROM (SELECT text FROM benchmark GROUP BY text HAVING count(*) > 1)""",
)
def m24(spark, sf):
    return decisions.dataset_contract(table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "benchmark"))


@query("m25_review_progress", "SELECT count(*) AS total, count(l.doc_id) AS reviewed, count(*) FILTER (quality = 1 AND toxic = 0) AS approved, count(*) FILTER (quality = 0 OR toxic = 1) AS rejected, count(*) - count(l.doc_id) AS remaining FROM documents LEFT JOIN labels l USING (doc_id)")
def m25(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("known").alias("reviewed"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("approved"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("rejected"), (F.count("*") - F.count("known")).alias("remaining"))


@query("m26_gold_manifest", f"WITH {SQL_GOLD} SELECT chunk_id AS doc_id, count(*) AS owners, string_agg(query_id::VARCHAR, ',' ORDER BY query_id) AS items, count(*) > 1 AS shared FROM gold GROUP BY 1")
def m26(spark, sf):
    return gold(spark, sf).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("owners"), F.array_join(F.transform(F.sort_array(F.collect_list("query_id")), lambda x: x.cast("string")), ",").alias("items"), (F.count("*") > 1).alias("shared"))


@query("m27_hit_summary", f"WITH {sql_bm25()}, {SQL_GOLD} SELECT t.query_id AS item_id, min(rank) FILTER (g.chunk_id IS NOT NULL) AS first_gold_rank, bool_or(g.chunk_id IS NOT NULL AND rank <= 1) AS in_1, bool_or(g.chunk_id IS NOT NULL AND rank <= 3) AS in_3, bool_or(g.chunk_id IS NOT NULL AND rank <= 5) AS in_5, bool_or(g.chunk_id IS NOT NULL) AS in_10 FROM bm_top t LEFT JOIN gold g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id GROUP BY 1")
def m27(spark, sf):
    j = bm25_top(spark, sf).join(gold(spark, sf).withColumn("g", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn("hit", F.col("g").isNotNull())
    within = lambda k: F.bool_or(F.col("hit") & (F.col("rank") <= k)).alias(f"in_{k}")
    return j.groupBy(F.col("query_id").alias("item_id")).agg(F.min(F.when(F.col("hit"), F.col("rank").cast("long"))).alias("first_gold_rank"), within(1), within(3), within(5), within(10))


@query("m29_inventory", "SELECT count(DISTINCT source) AS documents, count(*) AS pages, sum(len(string_split(text, chr(10))))::BIGINT AS chunks, max(doc_id) AS latest, count(*) FILTER (text = '') AS pending FROM documents")
def m29(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count_distinct("source").alias("documents"), F.count("*").alias("pages"), F.sum(F.size(F.split("text", "\n"))).alias("chunks"), F.max("doc_id").alias("latest"), F.count_if(F.col("text") == "").alias("pending"))


@query("m30_scorecard", f"{MET} SELECT 'id_context_precision' AS metric, 'measured' AS status, round(avg(precision_at_10), 4) AS value FROM met UNION ALL SELECT 'id_context_recall', 'measured', round(avg(recall_at_10), 4) FROM met UNION ALL SELECT unnest(['faithfulness', 'answer_relevancy']), 'pending', NULL")
def m30(spark, sf):
    m = bm25_metrics(spark, sf).agg(F.round(F.avg("precision_at_10"), 4).alias("p"), F.round(F.avg("recall_at_10"), 4).alias("r"))
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("measured" if c else "pending").alias("status"), (F.col(c) if c else F.lit(None).cast("double")).alias("value")) for n, c in (("id_context_precision", "p"), ("id_context_recall", "r"), ("faithfulness", None), ("answer_relevancy", None))])
    return m.select(F.explode(rows).alias("x")).select("x.*")


