"""Chunk and corpus queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import terms as D
from quillspark.functions import text as X
from quillspark.functions.text import lexical_tokens
from quillspark.operators import chunks as C
from quillspark.operators import embedding
from quillspark.operators.dense import norm
from quillspark.queries.common import literal, sql_tokens, table, values
from quillspark.session import shared_dir

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_LS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_LINES = f"ls AS (SELECT doc_id, source, {_LS} AS l FROM documents), lines AS (SELECT doc_id, source, i AS idx, l[i + 1] AS text, len(l) AS n FROM (SELECT doc_id, source, l, unnest(range(len(l))) AS i FROM ls))"


def lines(spark, sf):
    return C.line_chunks(table(spark, sf, "documents"))


_PAGES = [
    (1, "1. 준비\n손을 씻는다.\n\n약품 | 용량\nA | 5 mg\n\n목적\n감염을 막는다.\n이어지는 글"),
    (2, "머리말 없이 시작한다.\n2) 절차\n소독한다.\n3) 기록\n\n끝 문단은 앞 제목을 잇는다."),
    (3, "한 줄뿐이다."),
]


def _blocks_sql(rows: str, columns: str) -> str:
    """Paragraphs of tables are blocks; in others each first line and each heading begins one, below the last heading."""
    heading = f"length(trim(line)) <= 60 AND NOT regexp_matches(trim(line), '{D.SENTENCE_END}') AND (regexp_matches(trim(line), '{D.NUMBERED_LINE}') OR trim(line) IN ({', '.join(repr(x) for x in D.HEADINGS)}))"
    return f"""WITH p AS (SELECT doc_id, i AS p, s[i] AS para FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s FROM {rows}))),
l AS (SELECT doc_id, p, is_table, i AS l, ls[i] AS line FROM (SELECT doc_id, p, is_table, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, p, contains(para, ' | ') AS is_table, CASE WHEN contains(para, ' | ') THEN [para] ELSE string_split(para, chr(10)) END AS ls FROM p))),
h AS (SELECT *, NOT is_table AND {heading} AS heading FROM l),
b AS (SELECT *, count(*) FILTER (l = 1 OR heading) OVER w AS block, coalesce(last_value(CASE WHEN heading THEN trim(line) END IGNORE NULLS) OVER w, '') AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY p, l)),
g AS (SELECT doc_id, block, arg_min(section, (p, l)) AS section, trim(string_agg(line, chr(10) ORDER BY p, l)) AS text FROM b GROUP BY 1, 2),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS ordinal, section, text FROM g)
SELECT {columns} FROM o"""


@query("c01_semantic_blocks", _blocks_sql(values(_PAGES, "doc_id, text"), "doc_id::BIGINT AS doc_id, ordinal::INT AS ordinal, section, text"))
def c01(spark, sf):
    return C.semantic_blocks(literal(spark, _PAGES, "doc_id long, text string"))


@query("c01_document_blocks", _blocks_sql("documents", "doc_id, ordinal, section, length(text) AS n_chars"))
def c01d(spark, sf):
    return C.semantic_blocks(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("ordinal").cast("long"), "section", F.length("text").cast("long").alias("n_chars"))


@query(
    "c02_stride_chunks",
    "WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents) SELECT doc_id, i::BIGINT AS idx, array_to_string(list_slice(w, i * 90 + 1, i * 90 + 110), ' ') AS text FROM (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 20) / 90.0)::BIGINT, 1))) AS i FROM w)",
)
def c02(spark, sf):
    return C.stride_chunks(table(spark, sf, "documents")).select("doc_id", F.col("idx").cast("long"), "text")


@query("c02_recursive_chunks")
def c02r(spark, sf):
    return C.recursive_chunks(table(spark, sf, "documents").select("doc_id", "text"))


@query("c03_header_rows", f"WITH {_LINES}, h AS (SELECT doc_id, min(idx) AS first FROM lines WHERE contains(text, ' | ') GROUP BY 1) SELECT l.doc_id, l.idx, length(f.text || chr(10) || l.text) AS n FROM lines l JOIN h USING (doc_id) JOIN lines f ON f.doc_id = h.doc_id AND f.idx = h.first WHERE contains(l.text, ' | ') AND l.idx > first")
def c03(spark, sf):
    rows = lines(spark, sf).filter(F.contains("text", F.lit(" | ")))
    head = rows.groupBy("doc_id").agg(F.min_by("text", "idx").alias("header"), F.min("idx").alias("first"))
    return rows.join(head, "doc_id").filter("idx > first").select("doc_id", F.col("idx").cast("long"), F.length(F.concat_ws("\n", "header", "text")).cast("long").alias("n"))


@query("c04_line_chunks", f"WITH {_LINES} SELECT doc_id, idx, lag(idx) OVER w AS prev_idx, lead(idx) OVER w AS next_idx, length(text) AS n_chars FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def c04(spark, sf):
    return lines(spark, sf).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "prev_idx", "next_idx")], F.length("text").cast("long").alias("n_chars"))


_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("c05_chunk_quality", f"SELECT source, count(*) FILTER ({_NORM} = '') AS empty_n, count(*) FILTER (len({sql_tokens('text')}) > 110) AS over_limit_n, count(*) FILTER ({_NORM} <> '') - count(DISTINCT {_NORM}) FILTER ({_NORM} <> '') AS duplicate_n, max(len({sql_tokens('text')}))::BIGINT AS max_tokens FROM documents GROUP BY 1")
def c05(spark, sf):
    return C.quality(table(spark, sf, "documents"), "source", lexical_tokens)


@query(
    "c06_edge_labels",
    f"""WITH ls AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS source, page_id AS doc_id, {_LS} AS l FROM (SELECT url, page_id, html AS text FROM pages)), e AS (SELECT source, doc_id, unnest(list_distinct(list_concat(list_slice(l, 1, 3), list_slice(l, greatest(len(l) - 2, 1), len(l))))) AS label FROM ls)
SELECT source, label, count(DISTINCT doc_id) AS pages FROM e WHERE length(label) <= 60 AND NOT contains(label, ' | ') AND NOT regexp_matches(label, '(?:다[.!?]?|[。.!?])$') AND NOT regexp_matches(label, '(?i)\\d\\s*(?:mg|ml|㎎|㎖|℃|분|시간|회|%)') AND regexp_matches(label, '[가-힣A-Za-z]') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""",
)
def c06(spark, sf):
    pages = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return C.edge_labels(pages)


@query(
    "c07_running_headers",
    f"""WITH f AS (SELECT source, doc_id, coalesce({_LS}[1], '') AS first FROM documents), s AS (SELECT *, length(first) BETWEEN 1 AND 60 AND NOT regexp_matches(first, '(?:다[.!?]?|[.!?])$') AS shape FROM f)
SELECT source, doc_id, shape AND count(*) FILTER (shape) OVER (PARTITION BY source, lower(first)) >= 2 AS is_header FROM s""",
)
def c07(spark, sf):
    return C.running_headers(table(spark, sf, "documents"))


@query(
    "c08_inherited_titles",
    f"""WITH {_LINES}, t AS (SELECT *, length(text) <= 12 AS is_title FROM lines), c AS (SELECT *, min(CASE WHEN NOT is_title THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS consumer FROM t),
d AS (SELECT doc_id, consumer, text, min(idx) AS i FROM c WHERE is_title AND consumer IS NOT NULL GROUP BY ALL), g AS (SELECT doc_id, consumer AS idx, string_agg(text, ' ' ORDER BY i) AS inherited FROM d GROUP BY ALL)
SELECT t.doc_id, t.idx, coalesce(inherited, '') AS inherited FROM t LEFT JOIN g USING (doc_id, idx) WHERE NOT is_title""",
)
def c08(spark, sf):
    rows = lines(spark, sf).select("doc_id", F.col("idx").cast("long"), "text", (F.length("text") <= 12).alias("is_title"))
    return C.inherited_titles(rows)


@query("c09_corpus_stats", f"SELECT lang, count(*) AS chunks, count(*) FILTER ({_NORM} = '') AS empty_n, count(*) FILTER (length({_NORM}) < 8) AS short_n, min(len({sql_tokens('text')}))::BIGINT AS min_tokens, round(avg(len({sql_tokens('text')})), 3) AS avg_tokens, max(len({sql_tokens('text')}))::BIGINT AS max_tokens FROM documents GROUP BY 1")
def c09(spark, sf):
    return C.statistics(table(spark, sf, "documents"), "lang", lexical_tokens)


@query("c10_extraction_summary", "SELECT source, count(*) AS pages, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars < 80) AS scan_candidates, count(*) FILTER (contains(lower(text), 'license')) AS keyword_pages FROM documents GROUP BY 1")
def c10(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 80).alias("scan_candidates"), F.count_if(F.contains(F.lower("text"), F.lit("license"))).alias("keyword_pages"))


@query("c11_chunk_projection", "SELECT 'doc-' || doc_id AS chunk_id, source AS document_name, doc_id AS page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized_text FROM documents")
def c11(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("document_name"), F.col("doc_id").alias("page"), X.lower_clean(F.col("text")).alias("normalized_text"))


@query("c12_table_units", f"WITH {_LINES}, h AS (SELECT doc_id, arg_min(text, idx) AS header, min(idx) AS first FROM lines WHERE contains(text, ' | ') GROUP BY 1) SELECT l.doc_id, l.idx, coalesce(CASE WHEN contains(l.text, ' | ') AND l.idx > first THEN header || chr(10) || l.text END, l.text) AS text FROM lines l LEFT JOIN h USING (doc_id)")
def c12(spark, sf):
    rows = lines(spark, sf)
    is_row = F.contains("text", F.lit(" | "))
    head = rows.filter(is_row).groupBy("doc_id").agg(F.min_by("text", "idx").alias("header"), F.min("idx").alias("first"))
    unit = F.when(is_row & (F.col("idx") > F.col("first")), F.concat_ws("\n", "header", "text"))
    return rows.join(head, "doc_id", "left").select("doc_id", F.col("idx").cast("long"), F.coalesce(unit, F.col("text")).alias("text"))


_TABLES = [(1, 1, ["a", "b"]), (1, 2, ["c", ""]), (1, 3, ["d", ""]), (1, 4, ["", "e"]), (2, 1, ["x", "y"]), (2, 2, ["z", "w"]), (3, 1, ["p", ""]), (3, 2, ["q", ""])]


@query(
    "c13_sparse_tables",
    f"WITH t AS {values(_TABLES, 'table_id, row_no, cells')}, r AS (SELECT *, len(list_filter(cells, lambda x: x <> '')) AS filled FROM t WHERE row_no > 1) SELECT table_id::BIGINT AS table_id, count(*) AS body_rows, count(*) >= 3 AND count(*) FILTER (filled <= 1) * 4 >= 3 * count(*) AS sparse FROM r GROUP BY 1",
)
def c13(spark, sf):
    t = literal(spark, _TABLES, "table_id long, row_no int, cells array<string>").filter("row_no > 1")
    thin = F.size(F.filter("cells", lambda x: x != "")) <= 1
    return t.groupBy("table_id").agg(F.count("*").alias("body_rows"), ((F.count("*") >= 3) & (F.count_if(thin) * 4 >= 3 * F.count("*"))).alias("sparse"))


_TOK = sql_tokens("text")


@query(
    "c14_row_links",
    f"""WITH {_LINES}, r AS (SELECT doc_id AS page, idx AS row_id, unnest(list_distinct({_TOK})) AS t FROM lines WHERE contains(text, ' | ')), c AS (SELECT doc_id AS page, idx AS chunk_id, unnest(list_distinct({_TOK})) AS t FROM lines WHERE NOT contains(text, ' | ')),
s AS (SELECT page, row_id, chunk_id, count(*) AS overlap FROM r JOIN c USING (page, t) GROUP BY ALL) SELECT page, row_id, chunk_id, overlap FROM s QUALIFY overlap >= greatest(1, ceil(0.25 * max(overlap) OVER (PARTITION BY page, row_id)))""",
)
def c14(spark, sf):
    rows = lines(spark, sf).select(F.col("doc_id").alias("page"), F.col("idx").cast("long").alias("i"), "text", lexical_tokens(F.col("text")).alias("tokens"))
    is_row = F.contains("text", F.lit(" | "))
    return C.linked_rows(rows.filter(is_row).select("page", F.col("i").alias("row_id"), "tokens"), rows.filter(~is_row).select("page", F.col("i").alias("chunk_id"), "tokens"))


_FIGS = [(p, f"logo{p % 2}", 30.0, 20.0, 0.02) for p in range(1, 10)] + [(1, "fig-a", 300.0, 200.0, 0.2), (2, "fig-b", 20.0, 10.0, 0.1), (3, "fig-c", 200.0, 100.0, 0.001), (4, "fig-d", 120.0, 90.0, 0.08)]


@query("c15_figure_filter", f"WITH f AS {values(_FIGS, 'page, signature, w, h, area')}, n AS (SELECT count(DISTINCT page) AS pages FROM f), c AS (SELECT signature, count(DISTINCT page) AS seen FROM f GROUP BY 1) SELECT DISTINCT page::BIGINT AS page, signature FROM f JOIN c USING (signature), n WHERE seen < greatest(3, pages / 3.0) AND w >= 24 AND h >= 16 AND area >= 0.005")
def c15(spark, sf):
    f = literal(spark, _FIGS, "page long, signature string, w double, h double, area double")
    pages = f.agg(F.count_distinct("page").alias("pages"))
    seen = f.groupBy("signature").agg(F.count_distinct("page").alias("seen"))
    kept = f.join(seen, "signature").crossJoin(F.broadcast(pages)).filter((F.col("seen") < F.greatest(F.lit(3), F.col("pages") / 3)) & (F.col("w") >= 24) & (F.col("h") >= 16) & (F.col("area") >= 0.005))
    return kept.select("page", "signature").distinct()


@query("c16_raw_free_manifest", "SELECT doc_id, sha256(text) AS text_sha256, length(text) AS n_chars FROM documents")
def c16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@query("c17_table_markdown", "SELECT p_partkey, '| ' || replace(p_name, '|', '\\|') || ' | ' || p_brand || ' | part:' || p_partkey || ' |' AS row_markdown FROM part")
def c17(spark, sf):
    cells = F.array(X.markdown_cell(F.col("p_name")), F.col("p_brand"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("row_markdown"))


# Catalog: documents are orders, their chunks line items, members customers.


@query("s07_ready_snapshot", "SELECT o_orderkey AS document_id, l_linenumber::BIGINT AS position, l_partkey AS chunk FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def s07(spark, sf):
    ready = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("position"), F.col("l_partkey").alias("chunk"))
    return ready.join(items, "document_id")


@query("s08_catalog_integrity", "SELECT l_orderkey AS document_id, count(*) AS chunks, count(DISTINCT l_linenumber) = count(*) AS unique_positions, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM lineitem GROUP BY 1")
def s08(spark, sf):
    n, p = F.count("*"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(n.alias("chunks"), (F.count_distinct(p) == n).alias("unique_positions"), (F.max(p) - F.min(p) + 1 == n).alias("contiguous"))


@query("s09_scoped_projection", "SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2')")
def s09(spark, sf):
    return table(spark, sf, "documents").filter(F.col("source").isin("src1", "src2")).select("doc_id", "source", "n_chars")


@query("s10_optional_columns", "SELECT doc_id, lang, NULL::VARCHAR AS location, NULL::VARCHAR AS parent_id FROM documents")
def s10(spark, sf):
    from quillspark.sources.tables import with_optional

    return with_optional(table(spark, sf, "documents"), {"location": "string", "parent_id": "string"}).select("doc_id", "lang", "location", "parent_id")


@query("s11_document_list", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def s11(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))  # a list of 500 is the feature


@query("s12_publishable", "SELECT doc_id, sha256(text) AS file_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def s12(spark, sf):
    first = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "file_hash")


@query("s13_vector_reuse", "SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS reused FROM documents")
def s13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").select("doc_id", (F.col("doc_id") > F.col("first")).alias("reused"))


@query("s14_replace", "WITH n AS (SELECT source, max(doc_id) AS latest FROM documents GROUP BY 1) SELECT doc_id, source, CASE WHEN doc_id = latest THEN 'ready' ELSE 'replaced' END AS status FROM documents JOIN n USING (source)")
def s14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.join(d.groupBy("source").agg(F.max("doc_id").alias("latest")), "source").select("doc_id", "source", F.when(F.col("doc_id") == F.col("latest"), "ready").otherwise("replaced").alias("status"))


@query("s15_retired_left", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s15(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("s17_fingerprint", "SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1")
def s17(spark, sf):
    each = F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("s"))
    return table(spark, sf, "documents").groupBy("source").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["s"]), ","), 256).alias("fingerprint"))


@query("s18_backup_verify", "WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT doc_id, sha256(CASE WHEN toxic = 1 THEN text || ' ' ELSE text END) AS h FROM documents LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN m.doc_id IS NULL THEN 'extra' WHEN n.doc_id IS NULL THEN 'missing' WHEN m.h <> n.h THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM m FULL JOIN n USING (doc_id) GROUP BY 1")
def s18(spark, sf):
    from quillspark.sources.tables import compare_manifests

    d = table(spark, sf, "documents").select("doc_id", "text")
    toxic = table(spark, sf, "labels").select("doc_id", "toxic")
    now = d.join(toxic, "doc_id", "left").select("doc_id", F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("h"))
    return compare_manifests(d.select("doc_id", F.sha2("text", 256).alias("h")), now, "doc_id").groupBy("state").agg(F.count("*").alias("n"))


@query("s20_vector_contract", "SELECT count(*) AS n, min(len(embedding)) = max(len(embedding)) AS same_size, count(DISTINCT vec_id) = count(*) AS unique_ids, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_n FROM embeddings")
def s20(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.agg(F.count("*").alias("n"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("same_size"), (F.count_distinct("vec_id") == F.count("*")).alias("unique_ids"), F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zero_n"))


@query("s21_valid_cases", "SELECT item_id, length(text) AS n FROM benchmark WHERE length(text) BETWEEN 1 AND 500")
def s21(spark, sf):
    return table(spark, sf, "benchmark").filter(F.length("text").between(1, 500)).select("item_id", F.length("text").cast("long").alias("n"))


@query("s22_resume_remainder", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s22(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


# Vectors of all documents by hashed features, in four batches that a run can resume.
@query("s22_hashed_vectors", "SELECT doc_id, 64::BIGINT AS dims, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def s22v(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}"
    made = embedding.embed(docs, "doc_id", "text", embedding.Hashing(64), store, batches=4)
    return made.select("doc_id", F.size("v").cast("long").alias("dims"), F.round(norm(F.col("v")), 4).alias("norm"))


# Joins of the catalog.


@query("j01_chunks_of_ready", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1")
def j01(spark, sf):
    ready = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(ready, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("j02_member_chunks", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def j02(spark, sf):
    allowed = table(spark, sf, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(allowed, "l_partkey", "left_semi").select("l_orderkey", F.col("l_linenumber").cast("long"))


@query("j03_visible_rows", "SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS visible FROM orders")
def j03(spark, sf):
    members = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("m"))
    return table(spark, sf, "orders").join(members, "o_custkey", "left").select("o_orderkey", F.coalesce("m", F.lit(False)).alias("visible"))


@query("j04_term_postings", f"WITH q AS (SELECT DISTINCT unnest({_TOK}) AS term FROM benchmark) SELECT term, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) JOIN q USING (term) GROUP BY 1")
def j04(spark, sf):
    wanted = table(spark, sf, "benchmark").select(F.explode(lexical_tokens(F.col("text"))).alias("term")).distinct()
    rows = table(spark, sf, "documents").select("doc_id", F.explode(lexical_tokens(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("postings"), F.count_distinct("doc_id").alias("docs"))


@query("j06_candidate_union", "WITH d AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS s FROM embeddings WHERE label < 3), l AS (SELECT doc_id AS id, n_chars::DOUBLE AS t FROM documents WHERE n_chars > 5000) SELECT id, round(coalesce(s, 0), 6)::DOUBLE AS dense, coalesce(t, 0)::DOUBLE AS lexical FROM d FULL JOIN l USING (id)")
def j06(spark, sf):
    d = table(spark, sf, "embeddings").filter("label < 3").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("s"))
    lex = table(spark, sf, "documents").filter("n_chars > 5000").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("t"))
    return d.join(lex, "id", "full_outer").select("id", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("dense"), F.coalesce("t", F.lit(0.0)).alias("lexical"))


@query("j08_checklist_match", "WITH c AS (SELECT * FROM (VALUES (1, ['license', 'apache']), (2, ['token', 'password']), (3, ['zzzz'])) v(id, keywords)) SELECT doc_id, id::BIGINT AS checklist FROM documents, c WHERE len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 3")
def j08(spark, sf):
    lists = {1: ("license", "apache"), 2: ("token", "password"), 3: ("zzzz",)}
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(k).cast("long")) for k, words in lists.items()]))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.slice(hits, 1, 3)).alias("checklist"))


@query("j09_quote_check", "WITH q AS (SELECT c.conv_id, c.turn, c.text AS quote, lag(c.text) OVER (PARTITION BY c.conv_id ORDER BY turn) AS source FROM conversations c) SELECT conv_id, turn, coalesce(contains(source, string_split(quote, ' ')[1]), false) AS quoted FROM q")
def j09(spark, sf):
    from pyspark.sql import Window

    source = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumn("source", source)
    return rows.select("conv_id", "turn", F.coalesce(F.contains("source", F.split("text", " ")[0]), F.lit(False)).alias("quoted"))


# Requests name a document by seven times the number of their vector; some numbers are too high.
@query("j10_unknown_ids", "SELECT DISTINCT 7 * vec_id AS doc_id FROM embeddings WHERE 7 * vec_id NOT IN (SELECT doc_id FROM documents)")
def j10(spark, sf):
    asked = table(spark, sf, "embeddings").select((7 * F.col("vec_id")).alias("doc_id")).distinct()
    return asked.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti")


@query("j12_gold_questions", "SELECT d.doc_id, quality::BIGINT AS quality, n_chars FROM documents d JOIN labels USING (doc_id) WHERE quality = 1")
def j12(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id", F.col("quality").cast("long"), "n_chars")


@query("j14_contract_equality", "SELECT user_id, count(DISTINCT event_type) = 1 AS same_type, count(*) AS n FROM events GROUP BY 1")
def j14(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg((F.count_distinct("event_type") == 1).alias("same_type"), F.count("*").alias("n"))


@query("j15_id_audit", "SELECT 'chunk_without_vector' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'vector_without_chunk', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'duplicate_id', doc_id FROM documents GROUP BY 2 HAVING count(*) > 1")
def j15(spark, sf):
    d, v = table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    kinds = {"chunk_without_vector": d.join(v, "id", "left_anti"), "vector_without_chunk": v.join(d, "id", "left_anti"), "duplicate_id": d.groupBy("id").count().filter("count > 1").select("id")}
    out = [df.select(F.lit(k).alias("kind"), "id") for k, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("j19_scope_intersection", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def j19(spark, sf):
    a = table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    b = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(a, "o_custkey", "left_semi").join(b, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))
