"""Retrieval queries: BM25, vectors, fusion, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import query_terms, term_matches
from quillspark.operators import bm25, contained, dense, fusion, inverted, vectors
from quillspark.queries.common import MINIMAL, among, bm25_minimal_top, bm25_scores, bm25_top, hit_documents, lexical_tokens, shared_bags, sql_bm25, sql_tokens, table
from quillspark.session import blocks

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("r01_bm25_stats", f"WITH {sql_bm25()} SELECT (SELECT n FROM bm_stats)::BIGINT AS n_docs, round((SELECT avgdl FROM bm_stats), 6) AS avgdl, (SELECT count(*) FROM bm_df)::BIGINT AS n_terms")
def r01(spark, sf):
    bags = shared_bags(spark, sf)
    return bags.df.read().agg(F.count("*").alias("n_terms")).select(F.lit(bags.n).cast("long").alias("n_docs"), F.round(F.lit(float(bags.avgdl)), 6).alias("avgdl"), "n_terms")


@query("r02_bm25_scores", f"WITH {sql_bm25()} SELECT query_id AS item_id, chunk_id AS doc_id, score FROM bm_scores")
def r02(spark, sf):
    return bm25_scores(spark, sf).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score")


@query("r03_bm25_minimal", f"WITH {sql_bm25('mi', MINIMAL)} SELECT query_id AS item_id, rank, chunk_id AS doc_id FROM mi_top")
def r03(spark, sf):
    return bm25_minimal_top(spark, sf).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"))


# The idf of this variant may be negative; such terms get a quarter of the mean idf of all terms.
@query(
    "r04_bm25_okapi",
    f"""WITH {sql_bm25()},
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM bm_df, bm_stats),
floor_ AS (SELECT 0.25 * avg(idf) AS f FROM idf),
s AS (SELECT query_id, chunk_id, round(sum((CASE WHEN idf < 0 THEN f ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM bm_q JOIN bm_tf USING (term) JOIN idf USING (term), bm_stats, floor_ GROUP BY ALL)
SELECT query_id AS item_id, rank, chunk_id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
)
def r04(spark, sf):
    bags = shared_bags(spark, sf)
    n = F.lit(float(bags.n))
    df = bags.df.read().withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = df.agg((0.25 * F.avg("idf")).alias("low"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term")).distinct()
    weighed = asked.join(df, "term").crossJoin(F.broadcast(low)).select("query_id", "term", F.when(F.col("idf") < 0, F.col("low")).otherwise(F.col("idf")).alias("w"))  # one row
    return bags.top(weighed, 10).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "score")


@query("r05_bm25_top10", f"WITH {sql_bm25()} SELECT query_id AS item_id, rank, chunk_id AS doc_id, score FROM bm_top")
def r05(spark, sf):
    return bm25_top(spark, sf).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "score")


# The same rows from a full ranking of all pairs that share a term.
@query("r05_full_ranking", f"WITH {sql_bm25()} SELECT query_id AS item_id, rank, chunk_id AS doc_id, score FROM bm_top")
def r05f(spark, sf):
    return bm25.top(bm25_scores(spark, sf), 10).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "score")


# Zero scores stay in the ranking, by id; the fused list has only positive ones, ranked anew.
@query(
    "r07_positive_ranks",
    f"""WITH {sql_bm25()}, every AS (SELECT item_id AS query_id, doc_id AS chunk_id, coalesce(score, 0) AS score FROM (SELECT item_id, doc_id FROM benchmark, documents) x LEFT JOIN bm_scores s ON s.query_id = item_id AND s.chunk_id = doc_id),
raw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS raw_rank FROM every)
SELECT query_id AS item_id, chunk_id AS doc_id, score, raw_rank, CASE WHEN score > 0 THEN row_number() OVER (PARTITION BY query_id, score > 0 ORDER BY raw_rank) END AS lexical_rank FROM raw WHERE raw_rank <= 40""",
)
def r07(spark, sf):
    bags = shared_bags(spark, sf)
    scored = bags.top(bags.asked(table(spark, sf, "benchmark"), "item_id", lexical_tokens(F.col("text"))), 40).drop("rank")
    # Of documents without a score only the 40 with the least ids can come among the first 40.
    low = table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(40)
    zero = table(spark, sf, "benchmark").select("item_id").join(F.broadcast(low)).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(0.0).alias("score"))  # 40 rows a question
    raw = scored.unionByName(zero).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    raw = raw.withColumn("raw_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter("raw_rank <= 40")
    positive = F.col("score") > 0
    ranked = raw.withColumn("lexical_rank", F.when(positive, F.row_number().over(Window.partitionBy("query_id", positive).orderBy("raw_rank"))))
    return ranked.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score", F.col("raw_rank").cast("long"), F.col("lexical_rank").cast("long"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), dense.as_doubles(F.col("embedding")).alias("v"), "label")


def _asked(spark, sf):
    """The questions of a search: every vector whose id is divisible by 50."""
    return _vectors(spark, sf).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))


_SIM = """sims AS (SELECT q.vec_id AS q_id, d.vec_id, round({f}(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"""


@query("d01_dense_top10", f"WITH {_SIM.format(f='list_dot_product')} SELECT q_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10")
def d01(spark, sf):
    return vectors.top(_vectors(spark, sf), _asked(spark, sf), 10).select(F.col("query_id").alias("q_id"), "rank", F.col("chunk_id").alias("vec_id"), "score")


@query("d03_cosine_rank", f"WITH {_SIM.format(f='list_cosine_similarity')} SELECT q_id, rank, vec_id, score AS cos FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 40")
def d03(spark, sf):
    return vectors.top(_vectors(spark, sf), _asked(spark, sf), 40, cosine=True).select(F.col("query_id").alias("q_id"), "rank", F.col("chunk_id").alias("vec_id"), F.col("score").alias("cos"))


@query(
    "d02_sql_vector_search",
    f"""WITH {_SIM.format(f='list_cosine_similarity')},
firsts AS (SELECT q_id, w FROM (SELECT q_id, w, row_number() OVER (PARTITION BY q_id ORDER BY fi) AS r FROM (SELECT q_id, w, min(i) AS fi FROM (SELECT q_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM (SELECT 50 * item_id AS q_id, {sql_tokens('text')} AS toks FROM benchmark)) WHERE length(w) > 1 GROUP BY ALL)) WHERE r <= 16),
lex AS (SELECT q_id, doc_id AS vec_id, count(*) AS lexical FROM firsts, (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM documents) d WHERE contains(t, w) GROUP BY ALL),
ranked AS (SELECT s.*, coalesce(lexical, 0) AS lexical, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS dense_rank, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(lexical, 0) DESC, score DESC, vec_id) AS keyword_rank FROM sims s LEFT JOIN lex USING (q_id, vec_id))
SELECT q_id, vec_id, score AS sim, lexical, dense_rank, keyword_rank FROM ranked WHERE dense_rank <= 20 OR (lexical > 0 AND keyword_rank <= 20) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) <= 40""",
)
def d02(spark, sf):
    # Words count for pairs of vectors only: other items and documents have none to be joined with.
    known = table(spark, sf, "embeddings").select("vec_id")
    items = table(spark, sf, "benchmark").select((50 * F.col("item_id")).alias("query_id"), "text")
    terms = among(items, "query_id", known).select("query_id", F.slice(F.array_distinct(F.filter(lexical_tokens(F.col("text"), False), lambda w: F.length(w) > 1)), 1, 16).alias("terms"))
    bare = among(table(spark, sf, "documents"), "doc_id", known).select(F.col("doc_id").alias("chunk_id"), F.regexp_replace(F.lower("text"), r"\s+", "").alias("t"))
    lexical = reduce(DataFrame.unionByName, [bare.mapInArrow(contained.holding(own.toArrow()), f"chunk_id long, {contained.WORDS}") for own in blocks(terms, "query_id")])
    return vectors.blended(_vectors(spark, sf), _asked(spark, sf), lexical, 40).select(F.col("query_id").alias("q_id"), F.col("chunk_id").alias("vec_id"), F.col("score").alias("sim"), "lexical", "dense_rank", "keyword_rank")


@query(
    "d04_vector_validity",
    """WITH v AS (SELECT embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT count(*) AS n, count(DISTINCT len(e)) AS sizes, max(len(e))::BIGINT AS dims, count(*) FILTER (len(list_filter(e, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite_n, count(*) FILTER (n = 0) AS zero_n,
count(*) FILTER (abs(n - 1) > 1e-4) AS off_unit_n, round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm FROM v""",
)
def d04(spark, sf):
    return dense.validity(_vectors(spark, sf))


@query(
    "d05_scoped_cosine",
    f"WITH {_SIM.format(f='list_cosine_similarity')}, s AS (SELECT q_id, vec_id, score, round(1 - score, 6) AS distance FROM sims JOIN embeddings USING (vec_id) WHERE label < 5) SELECT q_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 10",
)
def d05(spark, sf):
    best = vectors.top(_vectors(spark, sf).filter("label < 5"), _asked(spark, sf), 10, cosine=True)
    return best.select(F.col("query_id").alias("q_id"), "rank", F.col("chunk_id").alias("vec_id"), F.round(1 - F.col("score"), 6).alias("distance"))


@query(
    "d06_duplicate_vectors",
    "SELECT md5(array_to_string(list_transform(embedding, lambda x: round(x * 1e6)::BIGINT), ',')) AS vec_hash, count(*) AS n, count(DISTINCT label) AS labels, min(vec_id) AS first_id FROM embeddings GROUP BY ALL",
)
def d06(spark, sf):
    key = F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x * 1e6).cast("long").cast("string")), ","))
    return table(spark, sf, "embeddings").groupBy(key.alias("vec_hash")).agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.min("vec_id").alias("first_id"))


@query("d07_self_search", f"WITH {_SIM.format(f='list_cosine_similarity')} SELECT q_id, vec_id AS top_id, score AS sim, q_id = vec_id AS is_self FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank = 1")
def d07(spark, sf):
    best = vectors.top(_vectors(spark, sf), _asked(spark, sf), 1, cosine=True)
    return best.select(F.col("query_id").alias("q_id"), F.col("chunk_id").alias("top_id"), F.col("score").alias("sim"), (F.col("query_id") == F.col("chunk_id")).alias("is_self"))


# The inverted file: the rows of an exact search (its bounds leave cells out, never a row), those of a few cells, and what a rebuild stores.
@query("s23_index_exact", f"WITH {_SIM.format(f='list_cosine_similarity')} SELECT q_id, rank, vec_id, score AS cos FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10")
def s23(spark, sf):
    index = inverted.build(_vectors(spark, sf))
    return inverted.search(index, _asked(spark, sf), 10, exact=True).select(F.col("query_id").alias("q_id"), "rank", F.col("chunk_id").alias("vec_id"), F.col("score").alias("cos"))


@query("s23_index_probes")
def s23p(spark, sf):
    index = inverted.build(_vectors(spark, sf))
    return inverted.search(index, _asked(spark, sf), 10).select(F.col("query_id").alias("q_id"), "rank", F.col("chunk_id").alias("vec_id"), F.col("score").alias("cos"))


@query("s23_rebuild_counts", "SELECT batch, expected, sum(expected) OVER (ORDER BY batch)::BIGINT AS stored FROM (SELECT vec_id % 4 AS batch, count(*) AS expected FROM embeddings GROUP BY 1)")
def s23r(spark, sf):
    return inverted.rebuilt(inverted.build(_vectors(spark, sf), batches=4))


_RRF = """rr AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS score FROM (SELECT query_id, chunk_id, rank FROM bm_top UNION ALL SELECT query_id, chunk_id, rank FROM mi_top) GROUP BY ALL),
rr_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr) WHERE rank <= 10)"""
SQL_RRF = f"{sql_bm25()}, {sql_bm25('mi', MINIMAL)}, {_RRF}"


def fused_top(spark, sf, k=10):
    return bm25.top(fusion.rrf([bm25_top(spark, sf), bm25_minimal_top(spark, sf)]), k)


@query("f01_rrf", f"WITH {SQL_RRF} SELECT query_id AS item_id, chunk_id AS doc_id, score AS rrf FROM rr")
def f01(spark, sf):
    return fusion.rrf([bm25_top(spark, sf), bm25_minimal_top(spark, sf)]).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("score").alias("rrf"))


@query("f02_rrf_top10", f"WITH {SQL_RRF} SELECT query_id AS item_id, rank, chunk_id AS doc_id, score AS rrf FROM rr_top")
def f02(spark, sf):
    return fused_top(spark, sf).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long"), F.col("chunk_id").alias("doc_id"), F.col("score").alias("rrf"))


_OVERLAP = f"""overlap AS (SELECT r.query_id, r.chunk_id, round(len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('d.text')}))) / greatest(1, len(list_distinct({sql_tokens('b.text')}))), 6)::DOUBLE AS overlap
FROM RANKING r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id)"""


def overlaps(spark, sf, ranking):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(lexical_tokens(F.col("text"))).alias("qt"))
    d = hit_documents(spark, sf, ranking).select(F.col("doc_id").alias("chunk_id"), F.array_distinct(lexical_tokens(F.col("text"))).alias("dt"))
    pairs = ranking.select("query_id", "chunk_id").join(q, "query_id").join(d, "chunk_id")
    return pairs.select("query_id", "chunk_id", F.round(F.size(F.array_intersect("qt", "dt")) / F.greatest(F.lit(1), F.size("qt")), 6).alias("overlap"))


@query("f12_overlap", f"WITH {sql_bm25()}, {_OVERLAP.replace('RANKING', 'bm_top')} SELECT query_id AS item_id, chunk_id AS doc_id, overlap FROM overlap")
def f12(spark, sf):
    return overlaps(spark, sf, bm25_top(spark, sf)).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "overlap")


_VARIANTS = """cand AS (SELECT r.query_id, r.chunk_id, r.rank, r.score, a.rank AS r1, b.rank AS r2, o.overlap, row_number() OVER (PARTITION BY r.query_id ORDER BY o.overlap DESC, r.rank) AS cur
FROM rr_top r LEFT JOIN bm_top a ON a.query_id = r.query_id AND a.chunk_id = r.chunk_id LEFT JOIN mi_top b ON b.query_id = r.query_id AND b.chunk_id = r.chunk_id JOIN overlap o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id),
keyed AS (
SELECT 'no_reranker' AS strategy, query_id, chunk_id, rank, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2 FROM cand
UNION ALL SELECT 'normalized_input', query_id, chunk_id, rank, (rank - 1) // 3, -overlap, 0 FROM cand
UNION ALL SELECT 'candidate_aware', query_id, chunk_id, rank, (rank - 1) // 3, CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 0 ELSE 1 END, least(coalesce(r1, 99), coalesce(r2, 99)) FROM cand
UNION ALL SELECT 'rank_preserving', query_id, chunk_id, rank, (rank - 1) // 3, cur, 0 FROM cand
UNION ALL SELECT 'top_n_rerank', query_id, chunk_id, rank, CASE WHEN rank <= 5 THEN 0 ELSE 1 END, CASE WHEN rank <= 5 THEN cur ELSE 0 END, 0 FROM cand
UNION ALL SELECT 'origin_feature', query_id, chunk_id, rank, -round(score + 0.05 * (coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0)) + CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 0.0005 ELSE 0 END, 9), 0, 0 FROM cand)"""


@query("f10_rerank_variants", f"WITH {SQL_RRF}, {_OVERLAP.replace('RANKING', 'rr_top')}, {_VARIANTS} SELECT strategy, query_id AS item_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY strategy, query_id ORDER BY k0, k1, k2, rank) AS new_rank FROM keyed")
def f10(spark, sf):
    fused = fused_top(spark, sf)
    one = bm25_top(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("first_rank"))
    two = bm25_minimal_top(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("second_rank"))
    cand = fused.join(one, ["query_id", "chunk_id"], "left").join(two, ["query_id", "chunk_id"], "left").join(overlaps(spark, sf, fused), ["query_id", "chunk_id"])
    cand = cand.withColumn("current_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")))
    return fusion.rerank_variants(cand).select("strategy", F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("new_rank").cast("long"))


@query(
    "f11_selective_decision",
    f"""WITH {sql_bm25()}, {_OVERLAP.replace('RANKING', '(SELECT * FROM bm_top WHERE rank = 1)')},
s AS (SELECT t.query_id, max(score) FILTER (rank = 1) AS top, coalesce(max(score) FILTER (rank = 2), 0) AS second FROM bm_top t GROUP BY 1),
w AS (SELECT query_id, regexp_matches(text, '[0-9]') AS exact, (top < 3.0)::INT AS w1, ((CASE WHEN top <> 0 THEN (top - second) / greatest(abs(top), 1e-9) ELSE 0 END) < 0.10)::INT AS w2, (overlap < 0.45)::INT AS w3 FROM s JOIN overlap USING (query_id) JOIN benchmark ON item_id = query_id)
SELECT query_id AS item_id, NOT exact AND w1 + w2 + w3 >= 2 AS use_dense, w1 + w2 + w3 AS n_weak,
CASE WHEN exact THEN 'exact_lexical_priority' WHEN w1 + w2 + w3 < 2 THEN 'bm25_confident' ELSE concat_ws(',', CASE WHEN w1 = 1 THEN 'low_top_score' END, CASE WHEN w2 = 1 THEN 'weak_score_gap' END, CASE WHEN w3 = 1 THEN 'low_lexical_overlap' END) END AS reasons FROM w""",
)
def f11(spark, sf):
    top = bm25_top(spark, sf)
    best = top.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    over = overlaps(spark, sf, top.filter("rank = 1")).select("query_id", "overlap")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").rlike("[0-9]").alias("exact"))
    signals = best.join(over, "query_id").join(asked, "query_id").select("*", F.lit("fact").alias("kind"), F.lit("").alias("phase"), F.lit(False).alias("follow_up"))
    return fusion.selective_decision(signals).withColumnRenamed("query_id", "item_id")


# Rows of a table as bags of words. The document frequency counts occurrences, as it does in the engine to be matched.
_ROW_TOKENS = "regexp_extract_all(lower({t}), '[a-z][a-z0-9-]*|[0-9]+')"


@query(
    "f13_table_row_search",
    f"""WITH r AS (SELECT p_partkey, {_ROW_TOKENS.format(t="p_name || ' ' || p_brand || ' ' || p_type")} AS toks FROM part),
tf AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(toks) AS term FROM r) GROUP BY ALL),
cf AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY term), n AS (SELECT count(*) AS t FROM r),
q AS (SELECT DISTINCT q, unnest({_ROW_TOKENS.format(t='s')}) AS term FROM (SELECT 1 AS q, (SELECT p_name FROM part ORDER BY p_partkey LIMIT 1) AS s UNION ALL SELECT 2, 'brand 13 polished')),
s AS (SELECT q, p_partkey, round(sum((CASE WHEN regexp_matches(term, '^[0-9]') THEN 10 ELSE 1 END) * ln(1 + (t + 1) / (cf + 1)) * (1 + ln(tf))), 6) AS score FROM q JOIN tf USING (term) JOIN cf USING (term), n GROUP BY q, p_partkey)
SELECT q, rank, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 10""",
)
def f13(spark, sf):
    part = table(spark, sf, "part")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]*|[0-9]+"), F.lit(0))
    rows = part.select("p_partkey", words(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("toks"))
    tf = rows.select("p_partkey", F.explode("toks").alias("term")).groupBy("p_partkey", "term").agg(F.count("*").alias("tf"))
    cf = tf.groupBy("term").agg(F.sum("tf").alias("cf"))
    total = rows.agg(F.count("*").alias("t"))
    asked = part.agg(F.min_by("p_name", "p_partkey").alias("s")).select(F.lit(1).alias("q"), "s").unionByName(spark.range(1).select(F.lit(2).alias("q"), F.lit("brand 13 polished").alias("s")))
    q = asked.select("q", F.explode(F.array_distinct(words(F.col("s")))).alias("term"))
    w = F.when(F.col("term").rlike("^[0-9]"), 10.0).otherwise(1.0)
    scored = q.join(tf, "term").join(cf, "term").crossJoin(F.broadcast(total)).groupBy("q", "p_partkey").agg(F.round(F.sum(w * F.log(1 + (F.col("t") + 1) / (F.col("cf") + 1)) * (1 + F.log("tf"))), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "p_partkey")).cast("long"))
    return ranked.filter("rank <= 10").select("q", "rank", "p_partkey", "score")


# Lexical evidence of each fused candidate: terms of the question in the text.
@query(
    "f06_lexical_evidence",
    f"""WITH {sql_bm25()}, q AS (SELECT item_id, list_slice(list_distinct(t), 1, 1) AS one, t FROM (SELECT item_id, list_filter({sql_tokens('text')}, lambda w: length(w) > 1) AS t FROM benchmark)),
fw AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM q) GROUP BY ALL)),
x AS (SELECT b.query_id, b.chunk_id, count(*) FILTER (regexp_matches(lower(d.text), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')) AS hits FROM bm_top b JOIN fw ON fw.item_id = b.query_id AND r <= 32 JOIN documents d ON d.doc_id = b.chunk_id GROUP BY ALL)
SELECT query_id AS item_id, chunk_id AS doc_id, hits AS lexical, hits > 0 AS supported FROM x""",
)
def f06(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text")).alias("terms"))
    top = bm25_top(spark, sf)
    d = hit_documents(spark, sf, top).select(F.col("doc_id").alias("chunk_id"), "text")
    pairs = top.select("query_id", "chunk_id").join(q, "query_id").join(d, "chunk_id")
    hits = pairs.withColumn("term", F.explode("terms")).groupBy("query_id", "chunk_id").agg(F.count_if(term_matches(F.col("term"), F.col("text"))).alias("lexical"))
    return hits.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "lexical", (F.col("lexical") > 0).alias("supported"))
