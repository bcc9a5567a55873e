"""Hybrid search queries and the remaining joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions.text import clean
from quillspark.operators import bm25, search
from quillspark.queries.common import MINIMAL, SQL_GOLD, bm25_minimal_top, bm25_top, gold, hit_documents, literal, planted, sql_bm25, sql_planted, table

from quillspark.queries.metrics import MET, THREE, bm25_metrics, three_metrics
from quillspark.queries.plan import _KIND
from quillspark.queries.retrieval import _OVERLAP, SQL_RRF, fused_top, overlaps

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_TEMPORAL = [
    (1, "시술 전 확인 사항", 11, "시술 전에 동의서를 확인한다", 3.0), (1, "시술 전 확인 사항", 12, "시술 후 관찰한다", 5.0), (1, "시술 전 확인 사항", 13, "손 위생을 지킨다", 4.0), (1, "시술 전 확인 사항", 14, "시술 전 금식", 0.0),
    (2, "관리 방법", 21, "시술 후 관찰한다", 1.0), (2, "관리 방법", 22, "손 위생", 2.0),
]


@query("r06_temporal_tiers")
def r06(spark, sf):
    return search.temporal_tiers(literal(spark, _TEMPORAL, "query_id long, question string, chunk_id long, text string, score double"))


def candidates(spark, sf):
    fused = fused_top(spark, sf).select("query_id", "chunk_id", F.col("score").alias("fusion"))
    d = hit_documents(spark, sf, fused).select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    rows = fused.join(overlaps(spark, sf, fused), ["query_id", "chunk_id"]).join(d, "chunk_id")
    return rows.select(
        "query_id", "chunk_id", "fusion", F.col("overlap").alias("similarity"), F.col("overlap").alias("coverage"), F.lit(0.0).alias("focus"), (F.col("overlap") >= 0.3).alias("supported"),
        (F.length(clean(F.col("text"))) >= 8).alias("substantive"), (F.col("lang") != "es").alias("compatible"), F.sha2(clean(F.col("text")), 256).alias("signature"),
    )


_CAND = f"""WITH {SQL_RRF}, {_OVERLAP.replace('RANKING', 'rr_top')}, c AS (SELECT r.query_id, r.chunk_id, overlap, round(r.score + 0.045 * overlap + 0.008 * greatest(0.0, overlap), 9) AS s, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 8 AS sub, lang <> 'es' AS com, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sig FROM rr_top r JOIN overlap o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id JOIN documents ON doc_id = r.chunk_id),
x AS (SELECT *, CASE WHEN NOT sub THEN 'heading_only_or_short_body' WHEN NOT com THEN 'incompatible_topic' WHEN overlap < 0.3 AND overlap < 0.55 THEN 'below_unsupported_dense_threshold' ELSE 'scored' END AS r FROM c),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, sig, r = 'scored' ORDER BY s DESC, chunk_id) AS cp FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id, r = 'scored' AND cp = 1 ORDER BY s DESC, chunk_id) AS pl FROM y),
w AS (SELECT query_id, chunk_id, s, CASE WHEN r = 'scored' AND cp = 1 AND pl <= 6 THEN 'selected' WHEN r = 'scored' THEN 'rank_limit_or_duplicate' ELSE r END AS reason, CASE WHEN r = 'scored' AND cp = 1 AND pl <= 6 THEN pl END AS rank FROM z)"""


@query("f03_rerank", f"{_CAND} SELECT query_id AS item_id, chunk_id AS doc_id, rank, s AS rerank_score FROM w WHERE reason = 'selected'")
def f03(spark, sf):
    return search.reranked(candidates(spark, sf)).filter("reason = 'selected'").select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank", "rerank_score")


@query("f05_decision_trace", f"{_CAND} SELECT query_id AS item_id, chunk_id AS doc_id, reason FROM w")
def f05(spark, sf):
    return search.reranked(candidates(spark, sf)).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "reason")


_ANCHORED = f"WITH {sql_bm25()}, b AS (SELECT t.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS own FROM bm_top t JOIN documents ON doc_id = chunk_id), l AS (SELECT *, own = 1 AND row_number() OVER (PARTITION BY query_id, own = 1 ORDER BY rank) <= 4 AS lead FROM b) SELECT query_id AS item_id, source, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, rank) AS position FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, rank) <= 8"


@query("f04_anchored", _ANCHORED)
def f04(spark, sf):
    top = bm25_top(spark, sf)
    d = hit_documents(spark, sf, top).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"))
    return search.anchored(top.join(d, "chunk_id")).select(F.col("query_id").alias("item_id"), F.col("document").alias("source"), F.col("chunk_id").alias("doc_id"), "position")


@query("f07_weighted_fusion", f"WITH {sql_bm25()}, {sql_bm25('mi', MINIMAL)} SELECT query_id AS item_id, chunk_id AS doc_id, round(sum(w / (60 + rank)), 9)::DOUBLE AS score FROM (SELECT query_id, chunk_id, rank, 1.0::DOUBLE AS w FROM mi_top UNION ALL SELECT query_id, chunk_id, rank, 2.0 FROM bm_top) GROUP BY ALL")
def f07(spark, sf):
    return search.weighted_fusion(bm25_minimal_top(spark, sf), bm25_top(spark, sf)).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score")


@query("f08_hybrid_search", f"{_CAND} SELECT w.query_id AS item_id, w.chunk_id AS doc_id, w.rank, length(d.text) AS n_chars FROM w JOIN documents d ON doc_id = chunk_id WHERE reason = 'selected'")
def f08(spark, sf):
    hits = search.reranked(candidates(spark, sf)).filter("reason = 'selected'")
    d = hit_documents(spark, sf, fused_top(spark, sf)).select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("n_chars"))
    return hits.join(d, "chunk_id").select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank", "n_chars")


# The variant in which a candidate of the second list alone has similarity 0.
@query("f09_zero_similarity", f"WITH {SQL_RRF}, {_OVERLAP.replace('RANKING', 'rr_top')} SELECT r.query_id AS item_id, r.chunk_id AS doc_id, CASE WHEN b.chunk_id IS NULL THEN 0 ELSE overlap END::DOUBLE AS similarity FROM rr_top r JOIN overlap o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id LEFT JOIN bm_top b ON b.query_id = r.query_id AND b.chunk_id = r.chunk_id")
def f09(spark, sf):
    fused = fused_top(spark, sf)
    first = bm25_top(spark, sf).select("query_id", "chunk_id", F.lit(True).alias("in_first"))
    rows = fused.join(overlaps(spark, sf, fused), ["query_id", "chunk_id"]).join(first, ["query_id", "chunk_id"], "left")
    return rows.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.when(F.col("in_first"), F.col("overlap")).otherwise(0.0).alias("similarity"))


@query("f14_review_candidates", f"WITH {sql_bm25()} SELECT query_id AS item_id, rank, chunk_id AS doc_id, 'bm25' AS method, 'pending' AS status, round(score, 4) AS score FROM bm_top WHERE rank <= 5")
def f14(spark, sf):
    return bm25_top(spark, sf, 5).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long"), F.col("chunk_id").alias("doc_id"), F.lit("bm25").alias("method"), F.lit("pending").alias("status"), (F.floor(F.col("score") * 1e4 + 0.5) / 1e4).alias("score"))


@query("f15_representatives", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def f15(spark, sf):
    order = Window.partitionBy("lang").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("r", F.row_number().over(order)).filter("r <= 3").drop("r")


# Joins.


@query("j05_scored_pairs", "SELECT q.vec_id AS q_id, count(*) AS n, round(max(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])), 6) AS best FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings d WHERE d.vec_id <> q.vec_id GROUP BY 1")
def j05(spark, sf):
    from quillspark.operators import vectors
    from quillspark.queries.retrieval import _asked, _vectors

    best = vectors.top(_vectors(spark, sf), _asked(spark, sf), 2).filter("query_id <> chunk_id").groupBy(F.col("query_id").alias("q_id")).agg(F.max("score").alias("best"))
    return best.crossJoin(F.broadcast(_vectors(spark, sf).agg((F.count("*") - 1).alias("n")))).select("q_id", "n", "best")  # one row: all vectors but the question itself


@query("j07_term_in_text", "WITH t AS (SELECT unnest(['license', 'idiot', 'token', 'the']) AS term) SELECT term, count(*) AS docs FROM t, documents WHERE contains(regexp_replace(lower(text), '\\s+', '', 'g'), term) GROUP BY 1")
def j07(spark, sf):
    low = F.regexp_replace(F.lower("text"), r"\s+", "")
    terms = F.filter(F.array(*[F.lit(t) for t in ("license", "idiot", "token", "the")]), lambda t: F.contains(low, t))
    return table(spark, sf, "documents").select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


@query("j11_gold_flags", f"WITH {sql_bm25()}, {SQL_GOLD} SELECT t.query_id AS item_id, t.rank, g.chunk_id IS NOT NULL AS is_gold FROM bm_top t LEFT JOIN gold g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id")
def j11(spark, sf):
    j = bm25_top(spark, sf).join(gold(spark, sf).withColumn("g", F.lit(True)), ["query_id", "chunk_id"], "left")
    return j.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long"), F.coalesce("g", F.lit(False)).alias("is_gold"))


@query("j13_engines_by_case", f"{THREE} SELECT query_id AS item_id, max(mrr) FILTER (engine = 'bm25') AS bm25, max(mrr) FILTER (engine = 'minimal') AS minimal, max(mrr) FILTER (engine = 'rrf') AS rrf FROM every GROUP BY 1")
def j13(spark, sf):
    return three_metrics(spark, sf).groupBy(F.col("query_id").alias("item_id")).pivot("engine", ["bm25", "minimal", "rrf"]).agg(F.max("mrr"))


@query("j16_containment", "WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20], s) AS covered FROM o")
def j16(spark, sf):
    allowed = F.array(*[F.lit(i).cast("long") for i in range(1, 21)])
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.size(F.array_except(F.collect_set(F.col("l_suppkey").cast("long")), allowed)) == 0).alias("covered"))


@query("j17_top10_overlap", f"WITH {sql_bm25()}, {sql_bm25('mi', MINIMAL)} SELECT b.query_id AS item_id, count(m.chunk_id) AS overlap_n FROM bm_top b LEFT JOIN mi_top m ON m.query_id = b.query_id AND m.chunk_id = b.chunk_id GROUP BY 1")
def j17(spark, sf):
    m = bm25_minimal_top(spark, sf).select("query_id", "chunk_id", F.lit(1).alias("m"))
    return bm25_top(spark, sf).join(m, ["query_id", "chunk_id"], "left").groupBy(F.col("query_id").alias("item_id")).agg(F.count("m").alias("overlap_n"))


@query(
    "j18_success_difference",
    f"""WITH {SQL_RRF}, {SQL_GOLD.strip()}, a AS (SELECT DISTINCT query_id FROM bm_top JOIN gold USING (query_id, chunk_id) WHERE rank > 1), b AS (SELECT DISTINCT query_id FROM mi_top JOIN gold USING (query_id, chunk_id) WHERE rank = 1)
SELECT query_id AS item_id, 'later_ones' AS only_by FROM a WHERE query_id NOT IN (SELECT query_id FROM b) UNION ALL SELECT query_id, 'first_one' FROM b WHERE query_id NOT IN (SELECT query_id FROM a)""",
)
def j18(spark, sf):
    right = gold(spark, sf)
    a = bm25_top(spark, sf).filter("rank > 1").join(right, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    b = bm25_minimal_top(spark, sf).filter("rank = 1").join(right, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    one = a.join(b, "query_id", "left_anti").select(F.col("query_id").alias("item_id"), F.lit("later_ones").alias("only_by"))
    return one.unionByName(b.join(a, "query_id", "left_anti").select(F.col("query_id").alias("item_id"), F.lit("first_one").alias("only_by")))


@query("j20_text_reuse", "WITH o AS (SELECT sha256(text) AS h, min(doc_id) AS old FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY 1) SELECT doc_id, old AS reuse_of FROM documents LEFT JOIN o ON o.h = sha256(text) WHERE source NOT IN ('src0', 'src1', 'src2')")
def j20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    known = F.col("source").isin("src0", "src1", "src2")
    old = d.filter(known).groupBy("h").agg(F.min("doc_id").alias("reuse_of"))
    return d.filter(~known).join(old, "h", "left").select("doc_id", "reuse_of")


# Evidence that builds on hits.


@query("e03_heading_context", "SELECT doc_id, regexp_matches(string_split(text, chr(10))[1], '^[A-Z]') AND length(string_split(text, chr(10))[1]) <= 40 AS heading FROM documents")
def e03(spark, sf):
    first = F.split("text", "\n")[0]
    return table(spark, sf, "documents").select("doc_id", (first.rlike("^[A-Z]") & (F.length(first) <= 40)).alias("heading"))


@query("e06_admission", f"{MET} SELECT b.item_id, CASE WHEN length(text) > 400 THEN 'clarification' WHEN m.hit_at_10 = 1 THEN 'admitted' WHEN m.query_id IS NULL THEN 'no_gold' ELSE 'context_fallback' END AS admission FROM benchmark b LEFT JOIN met m ON m.query_id = b.item_id")
def e06(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.length("text").alias("n"))
    j = b.join(bm25_metrics(spark, sf).select("query_id", "hit_at_10"), "query_id", "left")
    return j.select(F.col("query_id").alias("item_id"), F.when(F.col("n") > 400, "clarification").when(F.col("hit_at_10") == 1, "admitted").when(F.col("hit_at_10").isNull(), "no_gold").otherwise("context_fallback").alias("admission"))


@query("e08_selectable_units", "WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(line, '[.!?]$') OR regexp_matches(line, '^\\s*[-•]\\s*\\S.{3,}')) AS selectable, count(*) AS units FROM l GROUP BY 1")
def e08(spark, sf):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf, "documents").select("doc_id", F.explode(lines).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("[.!?]$") | F.col("line").rlike(r"^\s*[-•]\s*\S.{3,}")).alias("selectable"), F.count("*").alias("units"))


# Questions with an example planted: broad, of a part, of one phase, of another kind.
_BROAD = [
    (1, "수혈 절차를 알려줘"), (2, "수혈 전 절차를 알려줘"), (3, "투여량과 방법"), (4, "어떻게 진행해"), (5, "수혈 전·후 순서"), (6, "준비물과 절차"), (7, "세척 주기 방법"), (8, "시행 과정과 방법의 목적"),
    (9, "이후 방법"), (10, "산소 투여 중 방법"), (11, "욕창 알려줘"), (12, "단계별 시행 방법, 사전 준비와 이후 관리"), (13, "몇 회 방법"), (14, "소독 방법으로"),
]
_LOW = "lower(trim(regexp_replace(q, '\\s+', ' ', 'g')))"
_PHASED = "+".join(
    f"(regexp_matches({_LOW}, '(?:^|[^가-힣a-z0-9])(?:{'|'.join(A.PHASE_WORDS[p])})(?:[^가-힣a-z0-9]|$)') OR list_contains(list_concat({', '.join(f'regexp_extract_all({_LOW}, $${x}(?:{A.PHASE_END})$$, 1)' for x in (A.EVENT, A.CONTINUED))}), '{s}'))::INT" for s, p in A.SHORT_PHASES.items()
)


@query("e11_broad_questions", f"WITH a AS {sql_planted(_BROAD)} SELECT id, {_KIND} = 'procedure' AND regexp_matches(q, '{A.BROAD}') AND NOT regexp_matches(q, '{A.NARROW}') AND ({_PHASED}) <> 1 AS broad FROM a")
def e11(spark, sf):
    return planted(spark, sf, _BROAD).select("id", A.broad_procedure(F.col("q")).alias("broad"))


# A small corpus end to end: the question's best chunk by words alone.
_CORPUS = [(1, "수혈 전에 혈액형을 확인한다."), (2, "격리 해제 기준을 확인한다."), (3, "foley catheter 소독 순서를 지킨다."), (4, "thoracentesis 준비물은 멸균 장갑이다."), (5, "낙상 위험을 평가한다.")]
_CASES = [(1, "수혈 전에 확인할 사항", 1), (2, "격리를 해제하는 기준", 2), (3, "폴리 카테터 소독", 3), (4, "흉강천자 준비물", 4), (5, "낙상 평가", 5)]


@query("m28_cases_end_to_end")
def m28(spark, sf):
    docs = bm25.tokenized(literal(spark, _CORPUS, "id long, text string"), "id", F.col("text"))
    cases = literal(spark, _CASES, "id long, q string, want long")
    best = bm25.top(bm25.scores(docs, cases, "id", F.col("q")), 1)
    return cases.join(best, cases["id"] == best["query_id"], "left").select("id", F.col("chunk_id").alias("found"), (F.col("chunk_id") == F.col("want")).alias("passed"))


@query("s05_carried_sections", "WITH p AS (SELECT doc_id, source, CASE WHEN length(string_split(text, chr(10))[1]) <= 40 THEN string_split(text, chr(10))[1] END AS h FROM documents) SELECT doc_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id), '') AS section FROM p")
def s05(spark, sf):
    first = F.split("text", "\n")[0]
    h = F.when(F.length(first) <= 40, first)
    rows = table(spark, sf, "documents").select("doc_id", "source", h.alias("h"))
    return rows.select("doc_id", F.coalesce(F.last("h", ignorenulls=True).over(Window.partitionBy("source").orderBy("doc_id")), F.lit("")).alias("section"))


