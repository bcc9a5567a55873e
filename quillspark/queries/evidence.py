"""Context, evidence, answer and quota queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions.text import clean, selectable_unit, sentences, source_units
from quillspark.operators import chunks as C
from quillspark.operators import context, evidence
from quillspark.queries.common import bm25_top, hit_documents, literal, planted, sql_bm25, sql_planted, sql_sentences, table, values
from quillspark.plans.questions import classify
from quillspark.queries.plan import _KIND
from quillspark.queries.text import _units_sql
from quillspark.streaming import lifecycle, quota

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_LS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
# Lines as chunks: four lines are a parent, ten a page, twenty a section. The middle line of a hit document is the seed.
_CH = f"""ch AS (SELECT doc_id, i AS idx, i // 4 AS parent, i // 10 AS page, i // 20 AS section, l[i + 1] AS text, len(l) AS n FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, {_LS} AS l FROM documents)))"""
_SEED = f"WITH {sql_bm25()}, {_CH}, seeds AS (SELECT t.query_id, t.rank, c.* FROM bm_top t JOIN ch c ON c.doc_id = t.chunk_id AND c.idx = n // 2 WHERE t.rank <= 3)"


def line_rows(spark, sf, docs=None):
    i = F.col("idx").cast("long")
    rows = C.line_chunks(table(spark, sf, "documents") if docs is None else docs)
    return rows.select("doc_id", i.alias("idx"), F.floor(i / 4).alias("parent"), F.floor(i / 10).alias("page"), F.floor(i / 20).alias("section"), "text")


def hit_lines(spark, sf, k=3):
    """The lines of documents that are among the first k of some item."""
    return line_rows(spark, sf, hit_documents(spark, sf, bm25_top(spark, sf, k)))


def seeds(spark, sf, k=3):
    rows = hit_lines(spark, sf, k)
    middle = rows.groupBy("doc_id").agg(F.floor(F.count("*") / 2).alias("idx"))
    top = bm25_top(spark, sf, k).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))
    return top.join(middle, "doc_id")


@query("x01_neighbors", f"{_SEED} SELECT s.query_id AS item_id, s.doc_id, s.idx AS seed, c.idx AS chunk, c.idx - s.idx AS distance FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND abs(c.idx - s.idx) <= 2 WHERE c.section = s.section AND abs(c.page - s.page) <= 1")
def x01(spark, sf):
    own = seeds(spark, sf).select("query_id", "doc_id", "idx")
    found = context.neighbours(own, hit_lines(spark, sf))
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.col("idx").alias("seed"), "chunk", F.col("distance").cast("long"))


@query("x02_parent_group", f"{_SEED} SELECT s.query_id AS item_id, c.doc_id, c.parent, c.idx FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND c.parent = s.parent")
def x02(spark, sf):
    rows = hit_lines(spark, sf)
    own = seeds(spark, sf).join(rows.select("doc_id", "idx", "parent"), ["doc_id", "idx"]).select("query_id", "doc_id", "parent")
    return own.join(rows.select("doc_id", "parent", "idx"), ["doc_id", "parent"]).select(F.col("query_id").alias("item_id"), "doc_id", "parent", "idx")


@query("x03_signature_dedup", f"WITH {sql_bm25()}, h AS (SELECT t.*, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS sig FROM bm_top t JOIN documents d ON d.doc_id = t.chunk_id) SELECT query_id AS item_id, chunk_id AS doc_id, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, sig ORDER BY rank, chunk_id) = 1")
def x03(spark, sf):
    top = bm25_top(spark, sf)
    texts = hit_documents(spark, sf, top).select(F.col("doc_id").alias("chunk_id"), "text")
    hits = top.join(texts, "chunk_id").withColumn("context_only", F.lit(False))
    return context.deduplicated(hits, "query_id", F.lower(clean(F.col("text")))).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long"))


@query("x04_expansion", f"{_SEED} SELECT DISTINCT s.query_id AS item_id, c.doc_id, c.idx FROM seeds s JOIN ch c ON c.doc_id = s.doc_id WHERE c.parent = s.parent OR (abs(c.idx - s.idx) <= 2 AND c.section = s.section AND abs(c.page - s.page) <= 1)")
def x04(spark, sf):
    return x02(spark, sf).select("item_id", "doc_id", "idx").unionByName(x01(spark, sf).select("item_id", "doc_id", F.col("chunk").alias("idx"))).distinct()


@query(
    "x05_ordered_context",
    f"{_SEED}, e AS (SELECT s.query_id, s.rank, c.doc_id, c.idx FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND c.parent = s.parent) SELECT query_id AS item_id, doc_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) AS position FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) <= 12",
)
def x05(spark, sf):
    rows = hit_lines(spark, sf)
    own = seeds(spark, sf).join(rows.select("doc_id", "idx", "parent"), ["doc_id", "idx"]).select("query_id", "rank", "doc_id", "parent")
    every = own.join(rows.select("doc_id", "parent", "idx"), ["doc_id", "parent"])
    placed = every.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "idx")).cast("long"))
    return placed.filter("position <= 12").select(F.col("query_id").alias("item_id"), "doc_id", "idx", "position")


@query(
    "x06_round_robin",
    f"{_SEED}, e AS (SELECT s.query_id, s.rank, c.doc_id, c.idx, row_number() OVER (PARTITION BY s.query_id, c.doc_id ORDER BY c.idx) AS depth FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND c.parent = s.parent) SELECT query_id AS item_id, doc_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY depth, rank, idx) AS position FROM e",
)
def x06(spark, sf):
    rows = hit_lines(spark, sf)
    own = seeds(spark, sf).join(rows.select("doc_id", "idx", "parent"), ["doc_id", "idx"]).select("query_id", "rank", "doc_id", "parent")
    every = own.join(rows.select("doc_id", "parent", "idx"), ["doc_id", "parent"]).select("query_id", F.col("doc_id").alias("grp"), F.col("rank").alias("grp_order"), "idx")
    return context.round_robin(every, "query_id").select(F.col("query_id").alias("item_id"), F.col("grp").alias("doc_id"), "idx", F.col("position").cast("long"))


# Each item's text with a cue asks for one kind of thing; procedures get their groups one after another, all else the groups by turns.
_CUES = ("의 절차를 알려줘", "의 준비물은", "의 차이", "은 어떻게 진행해", "의 목적")
_CUED = "CASE item_id % 5 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CUES)) + " END"


@query(
    "x10_context_dispatch",
    f"""{_SEED}, e AS (SELECT s.query_id, s.rank, c.doc_id, c.idx, row_number() OVER (PARTITION BY s.query_id, c.doc_id ORDER BY c.idx) AS depth FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND c.parent = s.parent),
k AS (SELECT item_id AS query_id, {_KIND} = 'procedure' AS procedure FROM (SELECT item_id, text || {_CUED} AS q FROM benchmark))
SELECT query_id AS item_id, 'procedure' AS branch, doc_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) AS position FROM e JOIN k USING (query_id) WHERE procedure QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, idx) <= 12
UNION ALL SELECT query_id, 'other', doc_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY depth, rank, idx) FROM e JOIN k USING (query_id) WHERE NOT procedure QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, rank, idx) <= 12""",
)
def x10(spark, sf):
    cue = F.element_at(F.array(*[F.lit(c) for c in _CUES]), (F.col("item_id") % 5 + 1).cast("int"))
    procedure = table(spark, sf, "benchmark").select("item_id", (classify(F.concat("text", cue)) == "procedure").alias("procedure"))
    one, other = x05(spark, sf).join(procedure.filter("procedure"), "item_id", "left_semi"), x06(spark, sf).join(procedure.filter("NOT procedure"), "item_id", "left_semi")
    return one.withColumn("branch", F.lit("procedure")).unionByName(other.filter("position <= 12").withColumn("branch", F.lit("other"))).select("item_id", "branch", "doc_id", "idx", "position")


def _packed_sql(groups: str, key: str, limit: int) -> str:
    """CTEs after WITH RECURSIVE. groups: k, position, name, size."""
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY position, name, size) AS rn FROM ({groups})),
r AS (
  SELECT k, 0::BIGINT AS rn, 0::BIGINT AS used, '' AS taken, false AS stop FROM o GROUP BY k
  UNION ALL
  SELECT r.k, o.rn, CASE WHEN NOT stop AND used + size <= {limit} THEN used + size ELSE used END, CASE WHEN NOT stop AND used + size <= {limit} THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || name ELSE taken END, stop OR (used + size > {limit} AND taken = '')
  FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT k AS {key}, arg_max(taken, rn) AS taken, arg_max(used, rn)::INT AS used FROM r GROUP BY k"""


@query("x07_atomic_packing", f"WITH RECURSIVE {sql_bm25()}, " + _packed_sql("SELECT query_id AS k, rank AS position, chunk_id::VARCHAR AS name, len(string_split(text, chr(10))) AS size FROM bm_top JOIN documents ON doc_id = chunk_id", "item_id", 40))
def x07(spark, sf):
    top = bm25_top(spark, sf)
    sizes = hit_documents(spark, sf, top).select(F.col("doc_id").alias("chunk_id"), F.size(F.split("text", "\n")).alias("size"))
    groups = top.join(sizes, "chunk_id").select("query_id", F.col("rank").alias("position"), F.col("chunk_id").cast("string").alias("name"), "size")
    return context.packed(groups, "query_id", 40).withColumnRenamed("query_id", "item_id")


@query("x08_context_complete", f"{_SEED}, g AS (SELECT s.query_id, c.doc_id, c.parent, count(*) FILTER (abs(c.idx - s.idx) <= 1) AS selected_n, count(*) AS total_n FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND c.parent = s.parent GROUP BY ALL) SELECT query_id AS item_id, doc_id, parent, selected_n, total_n, selected_n = total_n AS complete FROM g")
def x08(spark, sf):
    rows = hit_lines(spark, sf)
    own = seeds(spark, sf).join(rows.select("doc_id", "idx", "parent"), ["doc_id", "idx"]).select("query_id", "doc_id", "parent", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx"))
    near = own.join(rows.select("doc_id", "parent", "idx"), ["doc_id", "parent", "idx"])
    return context.completeness(near, rows, "query_id").select(F.col("query_id").alias("item_id"), "doc_id", "parent", "selected_n", "total_n", "complete")


@query("x09_source_context", f"WITH {_CH} SELECT c.doc_id, c.idx, length(string_agg(o.text, chr(10) ORDER BY o.idx)) AS n_chars FROM ch c JOIN ch o ON o.doc_id = c.doc_id AND o.idx BETWEEN c.idx - 1 AND c.idx + 1 GROUP BY ALL")
def x09(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("idx")
    near = F.concat_ws("\n", F.lag("text").over(order), F.col("text"), F.lead("text").over(order))
    return line_rows(spark, sf).select("doc_id", "idx", F.length(near).cast("long").alias("n_chars"))


@query(
    "e01_evidence_groups",
    f"""{_SEED}, h AS (SELECT s.query_id, c.doc_id, c.parent, c.idx, c.text, c.idx <> s.idx AS context_only FROM seeds s JOIN ch c ON c.doc_id = s.doc_id AND abs(c.idx - s.idx) <= 2 WHERE c.section = s.section AND abs(c.page - s.page) <= 1)
SELECT query_id AS item_id, doc_id || ':' || parent AS group_key, min(idx) AS start, max(idx) AS "end", count(*) AS n, bool_or(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 8) AS substantive, CASE WHEN bool_or(NOT context_only) THEN 'seed' ELSE 'optional_context' END AS reason FROM h GROUP BY query_id, doc_id, parent""",
)
def e01(spark, sf):
    rows = line_rows(spark, sf)
    near = context.neighbours(seeds(spark, sf).select("query_id", "doc_id", "idx"), rows).select("query_id", "doc_id", F.col("chunk").alias("idx"), (F.col("distance") != 0).alias("context_only"))
    hits = near.join(rows.select("doc_id", "idx", "parent", "text"), ["doc_id", "idx"]).withColumn("complete", F.lit(True))
    return evidence.groups(hits).select(F.col("query_id").alias("item_id"), "group_key", "start", "end", "n", "substantive", "reason")


@query("e02_relevant_body", f"WITH {sql_bm25()} SELECT t.query_id AS item_id, t.chunk_id AS doc_id, length(trim(d.text)) >= 8 AND t.score > 5 AND d.lang = 'en' AS relevant FROM bm_top t JOIN documents d ON d.doc_id = t.chunk_id")
def e02(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    return bm25_top(spark, sf).join(d, "chunk_id").select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), ((F.length(F.trim("text")) >= 8) & (F.col("score") > 5) & (F.col("lang") == "en")).alias("relevant"))


_GATE = [(1, 3, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 2, 1, 0, 0, 0), (4, 2, 0, 1, 0, 0), (5, 2, 0, 0, 1, 0), (6, 2, 0, 0, 0, 1)]


@query(
    "e05_sufficiency_gate",
    f"WITH g AS {values(_GATE, 'id, topics, lost_branches, incomplete, repeats, lost_aspects')} SELECT id::BIGINT AS id, r = 'supported' AS sufficient, r AS reason FROM (SELECT id, CASE WHEN topics = 0 THEN 'no_topic_evidence' WHEN lost_branches > 0 THEN 'missing_requested_branch' WHEN incomplete > 0 THEN 'incomplete_semantic_block' WHEN repeats > 0 THEN 'duplicate_evidence' WHEN lost_aspects > 0 THEN 'missing_requested_aspect' ELSE 'supported' END AS r FROM g)",
)
def e05(spark, sf):
    g = literal(spark, _GATE, "id long, topics int, lost_branches int, incomplete int, repeats int, lost_aspects int")
    rules = F.when(F.col("topics") == 0, "no_topic_evidence").when(F.col("lost_branches") > 0, "missing_requested_branch").when(F.col("incomplete") > 0, "incomplete_semantic_block").when(F.col("repeats") > 0, "duplicate_evidence").when(F.col("lost_aspects") > 0, "missing_requested_aspect").otherwise("supported")
    return g.select("id", (rules == "supported").alias("sufficient"), rules.alias("reason"))


@query(
    "e07_source_units",
    f"SELECT doc_id, 'su' || lpad(i::VARCHAR, 5, '0') AS unit, s[i] AS text, regexp_matches(s[i], '[.!?]$') AS selectable FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))",
)
def e07(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("p", "text"))
    return rows.select("doc_id", F.concat(F.lit("su"), F.lpad((F.col("p") + 1).cast("string"), 5, "0")).alias("unit"), "text", F.col("text").rlike("[.!?]$").alias("selectable"))


_SEEDS = [
    (1, "foley 세척 절차", "foley 카테터를 세척한다", "절차", False, True, True),
    (2, "foley 세척 절차", "foley 카테터를 세척한다", "절차", True, True, True),
    (3, "foley 세척 절차", "목적과 정의", "foley", False, True, True),
    (4, "foley 세척 절차", "무균 상태로 시행", "PICC", False, True, True),
    (5, "foley 세척 절차", "무균 상태로 시행", "foley", False, False, True),
    (6, "foley 세척 절차", "무균 상태로 시행", "foley", False, True, False),
    (7, "세척 절차", "기록한다", "", False, True, True),
]


@query("e04_procedure_seed", f"WITH s AS {values(_SEEDS, 'id, q, body, section, context_only, substantive, supported')} SELECT id::BIGINT AS id, NOT context_only AND substantive AND supported AND regexp_matches(body, '한다|하고|시행|실시|준비|기록') AND (NOT contains(q, 'foley') OR contains(body || ' ' || section, 'foley')) AS seed FROM s")
def e04(spark, sf):
    rows = literal(spark, _SEEDS, "id long, q string, body string, section string, context_only boolean, substantive boolean, supported boolean")
    c = F.col
    return rows.select("id", evidence.procedure_seed(c("q"), c("body"), c("section"), c("context_only"), c("substantive"), c("supported")).alias("seed"))


# The document with the number before stands for the chunk before.
@query(
    "e08_unit_selection",
    rf"""WITH u AS ({_units_sql('documents', 'doc_id', 'text')}), p AS (SELECT doc_id + 1 AS doc_id, list(unit) AS units FROM u GROUP BY 1)
SELECT u.doc_id, position, regexp_matches(unit, '[.!?。！？]$') AND NOT regexp_matches(unit, '^\s*(?:[①-⑳]|\d+(?:\.\d+)*[.)]|[가-하]\))?\s*[^.!?。！？]{{0,40}}(?:방법|절차|목적|기준|투여)\s*$') AND trim(lower(unit), ' .:：') NOT IN (lower(source), lower(lang))
  AND NOT (position = 1 AND len(list_filter(coalesce(units, []), lambda x: ends_with(x, unit))) > 0) AS selectable
FROM u JOIN documents USING (doc_id) LEFT JOIN p USING (doc_id)""",
)
def e08_selection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", source_units(F.col("text")).alias("units"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("units").alias("before"))
    rows = docs.join(before, "doc_id", "left").select("doc_id", "source", "lang", "before", F.posexplode("units").alias("p", "unit"))
    names = F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("position"), selectable_unit(F.col("unit"), names, F.col("p") == 0, F.col("before")).alias("selectable"))


# A phase once named holds until another is named or a heading resets it.
_UNITS = [(1, 1, "before"), (1, 2, None), (1, 3, "reset"), (1, 4, None), (1, 5, "after"), (1, 6, None), (2, 1, None), (2, 2, "during"), (2, 3, None)]


@query("e07_phase_carry", f"WITH u AS {values(_UNITS, 'grp, pos, marker')} SELECT grp::BIGINT AS grp, pos::BIGINT AS pos, CASE WHEN coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY grp ORDER BY pos), 'reset') = 'reset' THEN 'unspecified' ELSE last_value(marker IGNORE NULLS) OVER (PARTITION BY grp ORDER BY pos) END AS phase FROM u")
def e07p(spark, sf):
    last = F.coalesce(F.last("marker", ignorenulls=True).over(Window.partitionBy("grp").orderBy("pos")), F.lit("reset"))
    return literal(spark, _UNITS, "grp long, pos long, marker string").select("grp", "pos", F.when(last == "reset", "unspecified").otherwise(last).alias("phase"))


_COV = [(1, "a", "adult", 1, 1, "x y", True, True), (1, "a", "adult", 2, 2, "z", True, True), (1, "b", "common", 3, 3, "x  y", False, True), (2, "c", "common", 1, 5, "p", True, True), (2, "c", "common", 2, 4, "p", True, False)]


@query(
    "e09_prompt_coverage",
    f"""WITH u AS {values(_COV, 'query_id, group_key, branch, position, idx, text, required, complete')}, o AS (SELECT *, coalesce(idx >= lag(idx) OVER (PARTITION BY query_id, group_key ORDER BY position), true) AS ok FROM u)
SELECT query_id::BIGINT AS query_id, count(DISTINCT group_key) FILTER (required) AS required_groups, count(DISTINCT group_key) FILTER (NOT required) AS optional_groups, bool_and(ok) AS source_ordered, bool_and(complete) AS complete, count(*) - count(DISTINCT branch || '|' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS duplicate_count FROM o GROUP BY 1""",
)
def e09(spark, sf):
    return evidence.coverage(literal(spark, _COV, "query_id long, group_key string, branch string, position int, idx int, text string, required boolean, complete boolean"))


_LOSS = [(1, ["a"], ["a"], ["u"], ["u"], [], [], True, True), (2, ["a", "b"], ["a"], [], [], [], [], True, True), (3, ["a"], ["a"], ["u", "v"], ["u"], [], [], True, True), (4, ["a"], ["a"], [], [], ["adult"], [], True, True), (5, ["a"], ["a"], [], [], [], [], False, True), (6, ["a"], ["a"], [], [], [], [], True, False)]


@query(
    "e10_coverage_loss",
    f"WITH l AS {values(_LOSS, 'query_id, bg, ag, bu, au, bb, ab, complete, ordered')} SELECT query_id::BIGINT AS query_id, CASE WHEN NOT list_has_all(ag, bg) THEN 'missing_evidence_group' WHEN NOT list_has_all(au, bu) THEN 'missing_procedure_unit' WHEN NOT list_has_all(ab, bb) THEN 'missing_branch' WHEN NOT complete THEN 'incomplete_semantic_block' WHEN NOT ordered THEN 'source_order' ELSE '' END AS loss FROM l",
)
def e10(spark, sf):
    a = "array<string>"
    return evidence.coverage_loss(literal(spark, _LOSS, f"query_id long, before_groups {a}, after_groups {a}, before_units {a}, after_units {a}, before_branches {a}, after_branches {a}, complete boolean, ordered boolean"))


_SLOT = [(1, "g1", "adult", "before", "check", 1), (2, "g1", "adult", "before", "check", 2), (3, "g1", "adult", "after", "record", 3), (4, "g2", "pediatric", "before", "check", 4), (5, "g2", "pediatric", "before", "report", 5)]


@query("e12_requirement_slots", f"WITH u AS {values(_SLOT, 'unit, group_key, branch, phase, family, ord')} SELECT unit::BIGINT AS unit, branch, phase, family FROM u QUALIFY row_number() OVER (PARTITION BY branch, phase, family ORDER BY ord) = 1")
def e12(spark, sf):
    u = literal(spark, _SLOT, "unit long, group_key string, branch string, phase string, family string, ord int")
    return u.groupBy("branch", "phase", "family").agg(F.min_by("unit", "ord").alias("unit")).select("unit", "branch", "phase", "family")


@query(
    "e13_facets",
    f"""WITH u AS {values(_SLOT, 'unit, group_key, branch, phase, family, ord')}, f AS (SELECT 'group' AS kind, group_key AS facet, unit FROM u UNION SELECT 'branch', branch, unit FROM u UNION SELECT 'phase', branch || '/' || phase, unit FROM u UNION SELECT 'action_family', family, unit FROM u)
SELECT kind, facet, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS eligible FROM f GROUP BY ALL""",
)
def e13(spark, sf):
    u = literal(spark, _SLOT, "unit long, group_key string, branch string, phase string, family string, ord int")
    facets = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("facet")) for k, c in (("group", F.col("group_key")), ("branch", F.col("branch")), ("phase", F.concat_ws("/", "branch", "phase")), ("action_family", F.col("family")))])).alias("f")
    return u.select("unit", facets).groupBy("f.kind", "f.facet").agg(F.array_join(F.transform(F.sort_array(F.collect_set("unit")), lambda x: x.cast("string")), ",").alias("eligible"))


_ANS = [(1, ["g1", "g2"], ["g1", "g2"], ["adult"], ["adult"], True), (2, ["g1", "g2"], ["g1"], [], [], True), (3, ["g1"], ["g1"], ["adult"], [], True), (4, ["g1"], ["g1"], [], [], False)]


@query("e14_answer_coverage", f"WITH a AS {values(_ANS, 'id, rg, sg, rb, sb, ordered')} SELECT id::BIGINT AS id, CASE WHEN NOT list_has_all(sb, rb) THEN 'selection_branch' WHEN NOT list_has_all(sg, rg) THEN 'selection_missing_group' WHEN NOT ordered THEN 'selection_source_order' ELSE '' END AS reason FROM a")
def e14(spark, sf):
    a = literal(spark, _ANS, "id long, rg array<string>, sg array<string>, rb array<string>, sb array<string>, ordered boolean")
    lost = lambda r, s: F.size(F.array_except(r, s)) > 0
    return a.select("id", F.when(lost("rb", "sb"), "selection_branch").when(lost("rg", "sg"), "selection_missing_group").when(~F.col("ordered"), "selection_source_order").otherwise("").alias("reason"))


_DOSES = [(1, 0, "Give 5 mg of the drug every 10 분 in all cases."), (2, 0, "Give 10 mg of the drug every 10 분 in all cases."), (3, 0, "Give 5 mg of the drug every 10 분 in all cases."), (4, 0, "Give 5 mg of another drug every 2 일 in all cases.")]


@query(
    "e15_conflicts",
    f"""WITH c AS {values(_DOSES, 'doc_id, idx, text')}, s AS (SELECT doc_id, lower(trim(unnest({sql_sentences('text')}))) AS s FROM c), k AS (SELECT doc_id, s, array_to_string(regexp_extract_all(s, '[0-9]+(?:\\.[0-9]+)?\\s*(?:mg|ml|분|초|시간|회|개|일)'), ',') AS q, regexp_replace(s, '[0-9]+(?:\\.[0-9]+)?(\\s*(?:mg|ml|분|초|시간|회|개|일))', '#\\1', 'g') AS key FROM s WHERE length(s) BETWEEN 15 AND 350),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE q <> '' GROUP BY 1) SELECT DISTINCT k.key, a.doc_id::BIGINT AS doc_a, k.doc_id::BIGINT AS doc_b FROM k JOIN f USING (key) JOIN k a ON a.key = k.key AND a.doc_id = first WHERE k.doc_id <> a.doc_id AND k.q <> a.q""",
)
def e15(spark, sf):
    return evidence.conflicts(literal(spark, _DOSES, "doc_id long, idx int, text string"))


@query(
    "e15_document_conflicts",
    f"""WITH s AS (SELECT doc_id, unnest({sql_sentences('text')}) AS s FROM documents), n AS (SELECT doc_id, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS s FROM s), k AS (SELECT doc_id, array_to_string(regexp_extract_all(s, '[0-9]+(?:\\.[0-9]+)?\\s*(?:mg|ml|분|초|시간|회|개|일)'), ',') AS q, regexp_replace(s, '[0-9]+(?:\\.[0-9]+)?(\\s*(?:mg|ml|분|초|시간|회|개|일))', '#\\1', 'g') AS key FROM n WHERE length(s) BETWEEN 15 AND 350)
SELECT count(*) AS keys FROM (SELECT key FROM k WHERE q <> '' GROUP BY key HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT q) > 1)""",
)
def e15d(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("idx"), "text")
    return evidence.conflicts(rows).agg(F.count_distinct("key").alias("keys"))


_STAGE = [(1, "s1", "required", ["a", "b"], ["b"]), (1, "s2", "required", ["c"], ["b"]), (1, "s3", "supplemental", ["d"], ["d"]), (2, "s1", "required", ["a"], ["a"])]


@query("e16_stage_recall", f"WITH s AS {values(_STAGE, 'id, stage, importance, allowed, got')} SELECT id::BIGINT AS id, round(avg(list_has_any(allowed, got)::INT) FILTER (importance = 'required'), 6) AS required_recall, round(avg(list_has_any(allowed, got)::INT) FILTER (importance = 'supplemental'), 6) AS supplemental_recall FROM s GROUP BY 1")
def e16(spark, sf):
    s = literal(spark, _STAGE, "id long, stage string, importance string, allowed array<string>, got array<string>")
    hit = F.arrays_overlap("allowed", "got").cast("int")
    return s.groupBy("id").agg(*[F.round(F.avg(F.when(F.col("importance") == k, hit)), 6).alias(f"{k}_recall") for k in ("required", "supplemental")])


@query("e17_order_audit", "SELECT conv_id, count(*) - count(DISTINCT text) AS duplicates, bool_and(ok) AS ordered FROM (SELECT conv_id, text, coalesce(turn >= lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), true) AS ok FROM conversations) GROUP BY 1")
def e17(spark, sf):
    ok = F.coalesce(F.col("turn") >= F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(True))
    return table(spark, sf, "conversations").withColumn("ok", ok).groupBy("conv_id").agg((F.count("*") - F.count_distinct("text")).alias("duplicates"), F.bool_and("ok").alias("ordered"))


@query("e18_slot_mapping", f"WITH {sql_bm25()} SELECT query_id AS item_id, chunk_id AS doc_id, score FROM bm_top QUALIFY score >= greatest(0.25, 0.75 * max(score) OVER (PARTITION BY query_id))")
def e18(spark, sf):
    best = F.max("score").over(Window.partitionBy("query_id"))
    return bm25_top(spark, sf).withColumn("best", best).filter(F.col("score") >= F.greatest(F.lit(0.25), 0.75 * F.col("best"))).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score")


_SRC = [("c1", "손을 씻는다.\n약 5 mg을 투여한다.\n10분 뒤 확인한다."), ("c2", "기록을 남긴다.")]
_STM = [
    (1, "약 5 mg을 투여한다.", "c1", "약 5 mg을 투여한다."), (2, "약 50 mg을 투여한다.", "c1", "약 5 mg을 투여한다."), (3, "약 5 ml을 투여한다.", "c1", "약 5 mg을 투여한다."), (4, "손을 씻는다.", "c2", "손을 씻는다."),
    (5, "기록을 남긴다.", "c2", "기록을 남긴다."), (6, "기록하고 소독한다.", "c2", "기록을 남긴다."), (7, "<b>기록을 남긴다.</b>", "c2", "기록을 남긴다."), (8, "남긴다.", "c2", "기록을 남긴다."), (9, "기록을 남긴다.", "c9", "기록을 남긴다."),
]


@query("v01_answer_validation")
def v01(spark, sf):
    return evidence.validated(literal(spark, _STM, "statement_no long, text string, chunk_id string, quote string"), literal(spark, _SRC, "chunk_id string, source string"))


@query("v02_sentence_support", f"WITH s AS (SELECT conv_id, turn, unnest({sql_sentences('text')}) AS s FROM conversations), d AS (SELECT DISTINCT unnest({sql_sentences('text')}) AS s FROM documents) SELECT conv_id, turn, count(*) AS sentences, count(d.s) AS supported FROM s LEFT JOIN d USING (s) GROUP BY ALL")
def v02(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(sentences(F.col("text"))).alias("s"))
    known = table(spark, sf, "documents").select(F.explode(sentences(F.col("text"))).alias("s")).distinct().withColumn("known", F.lit(1))
    return said.join(known, "s", "left").groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.count("known").alias("supported"))


_CIT = [(1, 10, 1, 1), (1, 10, 2, 3), (1, 11, 3, 1), (2, 10, 1, 4), (2, 10, 2, 2), (3, 12, 1, 1), (3, 12, 1, 5), (3, 12, 2, 5)]


@query(
    "v03_citation_order",
    f"WITH c AS {values(_CIT, 'answer, doc_id, statement_no, idx')}, e AS (SELECT answer, doc_id, statement_no, min(idx) AS low, max(idx) AS high FROM c GROUP BY ALL) SELECT answer::BIGINT AS answer, bool_and(ok) AS ordered FROM (SELECT answer, coalesce(low >= lag(high) OVER (PARTITION BY answer, doc_id ORDER BY statement_no), true) AS ok FROM e) GROUP BY 1",
)
def v03(spark, sf):
    return evidence.ordered_citations(literal(spark, _CIT, "answer long, doc_id long, statement_no int, idx int"))


@query("v04_unsupported_action")
def v04(spark, sf):
    rows = literal(spark, [(1, "소독하고 기록한다", "소독한다"), (2, "투여한다", "투약한다"), (3, "확인한다", "본다"), (4, "세척", "irrigation 시행")], "id long, text string, source string")
    return rows.select("id", evidence.unsupported_action(F.col("text"), F.col("source")).alias("unsupported"))


@query("v05_citation_section", "SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey)::VARCHAR ELSE '' END AS section FROM lineitem GROUP BY 1")
def v05(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.when(F.count_distinct("l_suppkey") == 1, F.min("l_suppkey").cast("string")).otherwise("").alias("section"))


@query("v06_selection_contract", f"WITH u AS {values(_SLOT, 'unit, group_key, branch, phase, family, ord')}, s AS (SELECT branch || '/' || phase || '/' || family AS slot, min(ord) AS first_order, count(*) AS specificity FROM u GROUP BY 1) SELECT slot, row_number() OVER (ORDER BY first_order, specificity, slot) AS position FROM s")
def v06(spark, sf):
    u = literal(spark, _SLOT, "unit long, group_key string, branch string, phase string, family string, ord int")
    slots = u.groupBy(F.concat_ws("/", "branch", "phase", "family").alias("slot")).agg(F.min("ord").alias("first_order"), F.count("*").alias("specificity"))
    return slots.select("slot", F.row_number().over(Window.orderBy("first_order", "specificity", "slot")).cast("long").alias("position"))  # at most 16 slots


_SEL = [(1, ["su1", "su2"], ["su1", "su2"]), (2, ["su1", "su1"], ["su1"]), (3, ["su9"], ["su1"]), (4, [], ["su1"]), (5, ["su2"], ["su1", "su2"])]


@query("v07_selection_check", f"WITH s AS {values(_SEL, 'id, chosen, allowed')} SELECT id::BIGINT AS id, CASE WHEN len(chosen) = 0 THEN 'empty_selection' WHEN len(chosen) <> len(list_distinct(chosen)) THEN 'duplicate_unit' WHEN NOT list_has_all(allowed, chosen) THEN 'unknown_unit' WHEN NOT list_has_all(chosen, allowed) THEN 'missing_unit' ELSE '' END AS reason FROM s")
def v07(spark, sf):
    s = literal(spark, _SEL, "id long, chosen array<string>, allowed array<string>")
    rule = F.when(F.size("chosen") == 0, "empty_selection").when(F.size("chosen") != F.size(F.array_distinct("chosen")), "duplicate_unit").when(F.size(F.array_except("chosen", "allowed")) > 0, "unknown_unit").when(F.size(F.array_except("allowed", "chosen")) > 0, "missing_unit").otherwise("")
    return s.select("id", rule.alias("reason"))


@query("v08_reconstruction", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1")
def v08(spark, sf):
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("answer"))


@query("v09_prompt_packing", "WITH RECURSIVE " + _packed_sql("SELECT conv_id AS k, turn AS position, turn::VARCHAR AS name, length(text) AS size FROM conversations", "conv_id", 600))
def v09(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("turn").cast("string").alias("name"), F.length("text").alias("size"))
    return context.packed(turns, "conv_id", 600)


@query("v10_token_estimate", "SELECT conv_id, ceil((32 + sum(16 + len(string_split(text, ' ')))) * 1.1::DOUBLE)::BIGINT + 1024 AS tokens FROM conversations GROUP BY 1")
def v10(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.ceil((32 + F.sum(16 + F.size(F.split("text", " ")))) * F.lit(1.1)) + 1024).alias("tokens"))


@query("v11_shared_metadata", "SELECT conv_id, count(*) AS n, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS shared_role FROM conversations GROUP BY 1")
def v11(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.when(F.count_distinct("role") == 1, F.min("role")).alias("shared_role"))


@query("v12_group_tokens", "SELECT source, lang, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM documents GROUP BY ALL")
def v12(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))


# Units of an item are its statements; an item's number tells what is done to its paraphrase.
_PARAPHRASE = rf"""u AS MATERIALIZED (SELECT item_id, position, 'su' || lpad(position::VARCHAR, 5, '0') AS unit_id, CASE position % 7 WHEN 0 THEN 'adult' WHEN 3 THEN 'pediatric' ELSE '' END AS branch, CASE position % 5 WHEN 0 THEN 'before' WHEN 2 THEN 'after' ELSE 'unspecified' END AS phase, unit FROM ({_units_sql('benchmark', 'item_id', 'text')})),
s AS (
  SELECT item_id, position, unit || CASE item_id % 9 WHEN 3 THEN ' 5 mg' WHEN 4 THEN ' 않는다' WHEN 5 THEN ' 10인 경우' WHEN 8 THEN ' 제외' ELSE '' END AS text, CASE item_id % 9 WHEN 1 THEN [unit_id, unit_id] WHEN 2 THEN [unit_id, 'su99999'] ELSE [unit_id] END AS ids
  FROM u WHERE item_id % 9 <> 7 AND (item_id % 9 <> 6 OR position > 1)
  UNION ALL SELECT item_id, 1, string_agg(unit, ' ' ORDER BY position), list(unit_id ORDER BY position) FROM u WHERE item_id % 9 = 7 GROUP BY 1),
c AS (SELECT s.item_id, s.position, s.text, s.ids, s.k, u.unit_id, branch, phase, unit FROM (SELECT *, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM s) s LEFT JOIN u ON u.item_id = s.item_id AND u.unit_id = s.id),
f AS (SELECT item_id, position, any_value(text) AS text, any_value(ids) AS ids, count(*) FILTER (unit IS NULL) AS unknown, count(DISTINCT nullif(branch, '')) AS branches, count(DISTINCT nullif(phase, 'unspecified')) AS phases, string_agg(unit, ' ' ORDER BY k) AS source FROM c GROUP BY 1, 2),
r AS (SELECT item_id, position, CASE WHEN len(list_distinct(ids)) < len(ids) THEN 'duplicate_evidence_id' WHEN unknown > 0 THEN 'unknown_evidence_id' WHEN branches > 1 THEN 'branch_mixing' WHEN phases > 1 THEN 'phase_mixing'
  WHEN NOT list_has_all(regexp_extract_all(source, '[0-9]+(?:\s*mg)?'), regexp_extract_all(text, '[0-9]+(?:\s*mg)?')) THEN 'unsupported_number_or_unit' WHEN regexp_matches(text, '않') <> regexp_matches(source, '않') THEN 'negation_changed'
  WHEN regexp_matches(text, '경우|제외') <> regexp_matches(source, '경우|제외') THEN 'condition_changed' END AS reason FROM f),
reasons AS (SELECT u.item_id, coalesce(any_value(first), CASE WHEN any_value(covered) < count(*) THEN 'evidence_coverage' ELSE '' END) AS reason
  FROM u LEFT JOIN (SELECT item_id, arg_min(reason, position) AS first FROM r WHERE reason IS NOT NULL GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, count(DISTINCT unit_id) AS covered FROM c GROUP BY 1) USING (item_id) GROUP BY 1)"""


def _paraphrases(spark, sf):
    c, items = F.col, table(spark, sf, "benchmark").select("item_id", F.posexplode(source_units(F.col("text"))).alias("p", "text"))
    at = c("p") + 1
    branch = F.when(at % 7 == 0, "adult").when(at % 7 == 3, "pediatric").otherwise("")
    phase = F.when(at % 5 == 0, "before").when(at % 5 == 2, "after").otherwise("unspecified")
    units = items.select("item_id", at.alias("position"), F.concat(F.lit("su"), F.lpad(at.cast("string"), 5, "0")).alias("unit_id"), branch.alias("branch"), phase.alias("phase"), "text")
    case = c("item_id") % 9
    more = F.when(case == 3, " 5 mg").when(case == 4, " 않는다").when(case == 5, " 10인 경우").when(case == 8, " 제외").otherwise("")
    ids = F.when(case == 1, F.array("unit_id", "unit_id")).when(case == 2, F.array(c("unit_id"), F.lit("su99999"))).otherwise(F.array("unit_id"))
    single = units.filter((case != 7) & ((case != 6) | (c("position") > 1))).select("item_id", "position", F.concat("text", more).alias("text"), ids.alias("ids"))
    own = units.filter(case == 7).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("position", "text", "unit_id"))).alias("g"))
    whole = own.select("item_id", F.lit(1).alias("position"), F.array_join(F.transform("g", lambda x: x["text"]), " ").alias("text"), F.transform("g", lambda x: x["unit_id"]).alias("ids"))
    return evidence.paraphrase_reasons(single.unionByName(whole), units, "item_id")


@query("v13_paraphrase", f"WITH {_PARAPHRASE} SELECT item_id, reason FROM reasons")
def v13(spark, sf):
    return _paraphrases(spark, sf)


@query("v14_decision", f"WITH {_PARAPHRASE} SELECT item_id, 'extractive' AS mode, CASE WHEN reason = '' THEN 'semantic_support_pending' ELSE reason END AS reason FROM reasons")
def v14(spark, sf):
    return evidence.paraphrase_decision(_paraphrases(spark, sf), "item_id")


# Sources and statements made of them: kept, of another kind, of another strength.
_STRENGTHS = [
    (1, "활력징후를 측정하고 즉시 기록한다.", "활력징후를 측정하고 즉시 기록한다."), (2, "약물을 투여해야 한다.", "약물을 투여할 수 있다."), (3, "투여를 중단한다.", "투여를 중단한다."), (4, "투여를 중단한다.", "약물을 투여한다."),
    (5, "검체를 채취하여 라벨을 확인한다.", "라벨을 확인한다."), (6, "카테터를 제거하지 않는다.", "카테터를 제거한다."), (7, "물품을 준비한다; 배액관을 연결한다.", "배액관을 연결한다."), (8, "시행 전, 동의서를 작성한다.", "동의서를 작성하는 것을 권고한다."),
    (9, "무균술 시행을 고려한다.", "무균술을 시행한다."), (10, "낙상에 주의한다.", "낙상에 반드시 주의한다."), (11, "즉시 보고한다.", "보고한다."), (12, "혈압을 점검하며 필요시 수액을 주입한다", "혈압을 점검하며 수액을 주입한다"),
    (13, "음식을 주면 안 된다. 금식을 확인한다.", "금식을 확인하고, 검사를 금지한다."), (14, "투약 후 관찰, 기록 가능", "기록 가능"), (15, "바로 장착하고 즉시 점검한다.", "바로 점검한다."), (16, "권장 용량을 주입하고 반드시 기재해야 한다.", "반드시 기재해야 한다."),
]


def _signatures_sql(name: str, rows: str) -> str:
    """CTEs {name}_sig: id and the distinct pairs of kind and strength, by first place. rows: a table of id and text."""
    count = lambda p, kind: f"(len(regexp_extract_all({p}, '{A.KINDS[kind]}')) - len(regexp_extract_all({p}, '(?:{A.KINDS[kind]}){A.TIME_SUFFIX}(?:{A.TIME_END})')))"
    found = " UNION ALL ".join(
        f"SELECT id, c, {k} AS k, '{kind}' AS kind, i, phrase FROM {name}_ph WHERE {count('phrase', kind)} > CASE WHEN i % 2 = 0 THEN {count('p[i - 1]', kind)} + {count('p[i + 1]', kind)} ELSE 0 END" for k, kind in enumerate(A.KINDS)
    )
    rules = " ".join(f"WHEN regexp_matches(phrase, '{p}') THEN '{s}'" for p, s in ((A.NEGATED, "prohibited"), (A.CONSIDER, "consider"), (A.RECOMMENDED, "recommended"), (A.OPTIONAL, "optional"), (A.IMMEDIATE, "immediate_required"), (A.MANDATORY, "required")))
    return f"""{name}_cl AS (SELECT id, c, trim(l[c]) AS clause FROM (SELECT id, l, unnest(generate_series(1, len(l))) AS c FROM (SELECT id, regexp_split_to_array(text, '{A.CLAUSE_END}') AS l FROM {rows}))),
{name}_pc AS (SELECT id, c, string_split(regexp_replace(clause, '({A.PHRASE_END})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM {name}_cl WHERE clause <> ''),
{name}_ph AS (SELECT id, c, i, p, CASE WHEN i % 2 = 1 THEN p[i] ELSE p[i - 1] || p[i] || p[i + 1] END AS phrase FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM {name}_pc)),
{name}_f AS ({found}),
{name}_s AS (SELECT id, c, k, i, kind, CASE WHEN kind = 'prohibit' THEN 'prohibited' {rules} WHEN kind = 'caution' THEN 'caution' ELSE 'required' END AS strength FROM {name}_f f WHERE NOT (kind = 'administer' AND EXISTS (SELECT 1 FROM {name}_f g WHERE g.id = f.id AND g.c = f.c AND g.kind = 'stop' AND g.phrase = f.phrase))),
{name}_sig AS (SELECT id, kind, strength, min(c * 1000000 + k * 10000 + i) AS place FROM {name}_s GROUP BY ALL),
{name}_k AS (SELECT id, string_agg(kind, ',' ORDER BY place) AS kinds FROM (SELECT id, kind, min(place) AS place FROM {name}_sig GROUP BY ALL) GROUP BY id),
{name}_t AS (SELECT id, string_agg(strength, ',' ORDER BY place) AS strengths FROM (SELECT id, strength, min(place) AS place FROM {name}_sig GROUP BY ALL) GROUP BY id)"""


_SOURCES, _STATEMENTS = ([(r[0], r[k]) for r in _STRENGTHS] for k in (1, 2))


@query(
    "v15_action_strength",
    f"""WITH src AS (SELECT id, q AS text FROM {sql_planted(_SOURCES)}), own AS (SELECT id, example AS text FROM (SELECT 1000 * conv_id + turn AS id FROM conversations) JOIN {values([(k, r[1]) for k, r in enumerate(_STATEMENTS)], 'k, example')} ON id % {len(_STRENGTHS)} = k),
{_signatures_sql('a', 'src')}, {_signatures_sql('b', 'own')},
bad AS (SELECT b.id, bool_or(NOT EXISTS (SELECT 1 FROM a_sig WHERE a_sig.id = b.id AND a_sig.kind = b.kind)) AS kind_, bool_or(NOT EXISTS (SELECT 1 FROM a_sig WHERE a_sig.id = b.id AND a_sig.kind = b.kind AND a_sig.strength = b.strength)) AS strength_ FROM b_sig b GROUP BY b.id)
SELECT src.id, NOT coalesce(strength_, false) AS passed, CASE WHEN kind_ THEN 'evaluation_action_kind_changed' WHEN strength_ THEN 'evaluation_action_strength_changed' ELSE '' END AS error_code,
coalesce(a_k.kinds, '') AS source_kinds, coalesce(b_k.kinds, '') AS statement_kinds, coalesce(a_t.strengths, '') AS source_strengths, coalesce(b_t.strengths, '') AS statement_strengths
FROM src LEFT JOIN bad USING (id) LEFT JOIN a_k USING (id) LEFT JOIN b_k USING (id) LEFT JOIN a_t USING (id) LEFT JOIN b_t USING (id)""",
)
def v15(spark, sf):
    n, own = len(_STRENGTHS), F.broadcast(literal(spark, [(k, r[1]) for k, r in enumerate(_STATEMENTS)], "k long, statement string"))  # as many rows as are written here
    both = planted(spark, sf, _SOURCES).join(own, F.col("id") % n == F.col("k"))
    checked = both.select("id", A.strength_check(A.signatures(F.col("statement")), A.signatures(F.col("q"))).alias("x"))
    return checked.select("id", F.col("x.passed"), F.coalesce("x.error_code", F.lit("")).alias("error_code"), *[F.array_join(f"x.{c}", ",").alias(c) for c in ("source_kinds", "statement_kinds", "source_strengths", "statement_strengths")])


@query("v16_first_failure", "SELECT doc_id, CASE WHEN length(text) = 0 THEN '01_empty' WHEN length(text) < 100 THEN '02_short' WHEN regexp_matches(text, '[#$%&]{3}') THEN '03_symbols' WHEN regexp_matches(text, '@') THEN '04_private' ELSE '' END AS first_failure FROM documents")
def v16(spark, sf):
    t = F.col("text")
    stages = F.array_compact(F.array(F.when(F.length(t) == 0, F.lit("01_empty")), F.when(F.length(t) < 100, F.lit("02_short")), F.when(t.rlike("[#$%&]{3}"), F.lit("03_symbols")), F.when(t.contains("@"), F.lit("04_private"))))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.array_min(stages), F.lit("")).alias("first_failure"))


@query("v17_numeric_diagnostics", "WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[0-9]+')) AS g, list_distinct(regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[0-9]+')) AS a FROM conversations) SELECT conv_id, turn, len(g) AS generated, len(a) AS allowed, len(list_filter(g, lambda x: NOT list_contains(a, x))) AS offending FROM c")
def v17(spark, sf):
    nums = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", nums(F.col("text")).alias("g"), nums(before).alias("a"))
    return rows.select("conv_id", "turn", F.size("g").cast("long").alias("generated"), F.size("a").cast("long").alias("allowed"), F.size(F.array_except("g", "a")).cast("long").alias("offending"))


@query("v18_display_rows", "WITH c AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations) SELECT conv_id, turn, 'heading' AS kind, role AS label FROM c WHERE new UNION ALL SELECT conv_id, turn, 'statement', '' FROM c")
def v18(spark, sf):
    new = ~F.col("role").eqNullSafe(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    heading = F.struct(F.lit("heading").alias("kind"), F.col("role").alias("label"))
    statement = F.struct(F.lit("statement").alias("kind"), F.lit("").alias("label"))
    rows = table(spark, sf, "conversations").withColumn("new", new)
    return rows.select("conv_id", "turn", F.explode(F.when(F.col("new"), F.array(heading, statement)).otherwise(F.array(statement))).alias("r")).select("conv_id", "turn", "r.kind", "r.label")


@query("v19_citation_numbers", f"WITH {sql_bm25()}, s AS (SELECT query_id, source, min(rank) AS first FROM bm_top JOIN documents ON doc_id = chunk_id GROUP BY ALL) SELECT query_id AS item_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first) AS number FROM s")
def v19(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    first = bm25_top(spark, sf).join(d, "chunk_id").groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    return first.select(F.col("query_id").alias("item_id"), "source", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long").alias("number"))


@query("v20_checklist_check", "SELECT l_orderkey AS checklist, count(*) AS items, count(*) BETWEEN 1 AND 40 AND count(DISTINCT l_orderkey) = 1 AND min(length(l_returnflag)) >= 1 AS valid FROM lineitem GROUP BY 1")
def v20(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("checklist")).agg(F.count("*").alias("items"), (F.count("*").between(1, 40) & (F.min(F.length("l_returnflag")) >= 1)).alias("valid"))


def ledger(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("tokens"))


@query("v21_quota_usage", "WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events) SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS used_24h, round(sum(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), 4) AS used_60s FROM l")
def v21(spark, sf):
    return quota.usage(ledger(spark, sf), "user_id").select("event_id", "used_24h", "used_60s")


@query(
    "v21_quota_admission",
    """WITH RECURSIVE l AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS t, value::DOUBLE AS used, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id, value) AS rn FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, false AS admitted, CAST([] AS STRUCT(t BIGINT, used DOUBLE)[]) AS live FROM l GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, event_id, ok, CASE WHEN ok THEN list_append(held, {'t': t, 'used': used}) ELSE held END
  FROM (SELECT *, len(held) < 20 AND coalesce(list_sum(list_transform(list_filter(held, lambda y: y.t > t - 60000000), lambda y: y.used)), 0) + used <= 200 AS ok
    FROM (SELECT l.user_id, l.rn, l.event_id, l.t, l.used, list_filter(r.live, lambda y: y.t >= l.t - 86400000000) AS held FROM r JOIN l ON l.user_id = r.user_id AND l.rn = r.rn + 1)))
SELECT user_id, event_id, admitted FROM r WHERE rn > 0""",
)
def v21a(spark, sf):
    return quota.admitted(ledger(spark, sf), "user_id", calls=20, tokens=200.0)


@query("v21_quota_minutes", "SELECT user_id, time_bucket(INTERVAL 60 SECOND, ts) AS minute, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY ALL")
def v21m(spark, sf):
    return quota.by_minute(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "calls", F.round("tokens", 4).alias("tokens"))


_LIFE_SQL = """WITH RECURSIVE ops AS MATERIALIZED (
  SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'signup' THEN 'settle' ELSE 'reserve' END AS kind,
    last_value(CASE WHEN event_type NOT IN ('error', 'signup') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS name, floor(value)::BIGINT AS used,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, ''::VARCHAR AS outcome, CAST([] AS STRUCT(id BIGINT, t BIGINT, used BIGINT, done BOOLEAN)[]) AS live FROM ops GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, event_id, outcome,
    CASE outcome WHEN 'reserved' THEN list_append(held, {'id': name, 't': t, 'used': used, 'done': false})
      WHEN 'cancelled' THEN list_filter(held, lambda y: y.id <> name)
      WHEN 'settled' THEN list_append(list_filter(held, lambda y: y.id <> name), {'id': name, 't': t, 'used': used, 'done': true}) ELSE held END
  FROM (SELECT *, CASE
      WHEN kind = 'reserve' THEN CASE WHEN len(held) >= 20 THEN 'calls' WHEN used > 200 THEN 'length'
        WHEN coalesce(list_sum(list_transform(held, lambda y: y.used)), 0) + used > 600 THEN 'day'
        WHEN coalesce(list_sum(list_transform(list_filter(held, lambda y: y.t > t - 60000000), lambda y: y.used)), 0) + used > 200 THEN 'minute' ELSE 'reserved' END
      WHEN len(list_filter(held, lambda y: y.id = name AND NOT y.done)) = 0 THEN 'ignored'
      WHEN kind = 'cancel' THEN 'cancelled' WHEN used <= 0 THEN 'kept' ELSE 'settled' END AS outcome
    FROM (SELECT o.user_id, o.rn, o.event_id, o.t, o.kind, o.name, o.used, list_filter(r.live, lambda y: y.t >= o.t - 86400000000) AS held FROM r JOIN ops o ON o.user_id = r.user_id AND o.rn = r.rn + 1)))
SELECT user_id, event_id, outcome FROM r WHERE rn > 0"""
_LIMITS = lifecycle.Limits(calls=20, day=600, minute=200)


def operations(spark, sf):
    """Events as operations: errors cancel and signups settle the user's latest reservation, all others reserve."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "signup", "settle").otherwise("reserve")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("op_id"), kind.alias("kind"), F.floor("value").alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))
    order = Window.partitionBy("key").orderBy("at", "op_id")
    return rows.withColumn("name", F.last(F.when(F.col("kind") == "reserve", F.col("op_id")), ignorenulls=True).over(order))


@query("v21_quota_lifecycle", _LIFE_SQL)
def v21l(spark, sf):
    return lifecycle.outcomes(operations(spark, sf), _LIMITS).select(F.col("key").alias("user_id"), F.col("op_id").alias("event_id"), "outcome")


# The same as a stream: the operations in files by time, one file a micro-batch, the outcomes as a table.
@query("v21_lifecycle_stream", _LIFE_SQL)
def v21s(spark, sf):
    return lifecycle.streamed(operations(spark, sf), _LIMITS).select(F.col("key").alias("user_id"), F.col("op_id").alias("event_id"), "outcome")


@query("v22_artefact_guard", "SELECT 'raw_text_in_questions' AS rule, count(*) AS violations FROM benchmark WHERE sha256(text) IN (SELECT sha256(text) FROM documents) UNION ALL SELECT 'raw_text_in_turns', count(*) FROM conversations WHERE sha256(text) IN (SELECT sha256(text) FROM documents)")
def v22(spark, sf):
    held = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")).distinct()
    out = [table(spark, sf, t).select(F.sha2("text", 256).alias("h")).join(held, "h", "left_semi").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, t in (("raw_text_in_questions", "benchmark"), ("raw_text_in_turns", "conversations"))]
    return out[0].unionByName(out[1])


@query("v23_hashed_questions", "SELECT item_id, sha256(text) AS question_sha256 FROM benchmark")
def v23(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("question_sha256"))
