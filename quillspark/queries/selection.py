"""Selections of source units over all sentences of the documents, with faults planted.

Twenty sentences in a row are the catalogue of a question, four of them a group; the first three groups are required, the
second and third for a branch of their own. A question's number of twenty says what is wrong with its answer. Every fifth
document asks for no procedure: all its groups are required and common, and it has no coverage. The seventh sentence of each
catalogue stands for a heading, which may not be selected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import sentences
from quillspark.operators import gate, selection
from quillspark.queries.common import shared, sql_sentences, table
from quillspark.session import write_shared

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


_COLUMNS = {
    "query_id": "doc_id * 10000 + i div 20",
    "fault": "(doc_id + i div 20) % 20",
    "procedure": "doc_id % 5 <> 4",
    "broad": "doc_id % 3 <> 0",
    "ord": "i % 20",
    "g": "i % 20 div 4",
    "r": "i % 4",
}
# What an answer holds of a unit: by fault, place in its group (r), group (g), and whether it may be selected and is required.
_PICKED = """CASE WHEN fault = 4 THEN false WHEN fault = 8 THEN required WHEN NOT (required AND selectable) THEN false WHEN fault = 11 THEN g <> 0 WHEN fault = 12 THEN g <> 1
 WHEN fault = 15 THEN r < 2 WHEN fault = 16 THEN r > 0 WHEN fault = 17 THEN r IN (0, 2) WHEN fault = 19 THEN r = 0 ELSE true END"""
_BRANCH = "CASE WHEN procedure AND g = 1 THEN 'adult' WHEN procedure AND g = 2 THEN 'pediatric' ELSE 'common' END"
_PHASE = "CASE WHEN g >= 3 THEN 'unspecified' WHEN r < 2 THEN 'before' ELSE 'after' END"
_SLOT = "CASE WHEN fault = 9 AND g < 2 THEN 1 - g ELSE g END"


def _units(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "text"))
    u = rows.select("text", *[F.expr(v).cast("boolean" if k in ("procedure", "broad") else "long").alias(k) for k, v in _COLUMNS.items()])
    u = u.select("*", F.concat(F.lit("u"), F.col("ord") + 1).alias("unit"), F.concat(F.lit("k"), F.col("g")).alias("group_key"), F.expr(_BRANCH).alias("branch"), (~F.col("procedure") | (F.col("g") < 3)).alias("required"), (F.col("text").rlike("[.!?]$") & (F.col("ord") != 6)).alias("selectable"), F.expr(_PHASE).alias("phase"))
    families = F.when(F.col("r") == 0, F.array(F.lit("check"), F.lit("record"))).when(F.col("r") == 1, F.array(F.lit("check"))).when(F.col("r") == 2, F.array(F.lit("report"))).otherwise(F.array(F.lit("prepare")))
    return u.withColumn("families", families)


def _inputs(spark, sf):
    """Plans, slots, units and answers. Units and slots are written once for a session: the rules go over them many times."""
    u = shared(spark, sf, "selection-units", lambda: write_shared(_units(spark, sf), "selection-units"))
    names = ["query_id", "fault", "procedure", "broad", "g"]
    of = F.transform(F.array_sort(F.collect_list(F.when(F.col("selectable"), F.struct("ord", "unit")))), lambda x: x["unit"])
    number = F.expr("CASE WHEN fault = 14 THEN -g ELSE g END").alias("slot_no")
    s = u.groupBy(*names, "group_key", "branch", "required").agg(of.alias("allowed")).filter(F.size("allowed") > 0).withColumns({"slot": F.concat(F.lit("g"), F.col("g") + 1), "slot_no": number})
    slots = s
    s = shared(spark, sf, "selection-slots", lambda: write_shared(slots, "selection-slots"))
    # Answers: the units of each slot in order, backwards for fault 10, the first said twice for 6, one that isn't there for 7.
    held = u.filter(F.expr(_PICKED)).withColumn("to", F.expr(_SLOT)).groupBy("query_id", F.col("to").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]).alias("said"))
    a = s.join(held, ["query_id", "g"], "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    said = F.when(F.col("fault") == 10, F.reverse("said")).when(F.col("fault") == 6, F.concat("said", F.slice("said", 1, 1))).when(F.col("fault") == 7, F.concat("said", F.array(F.lit("u99")))).otherwise(F.col("said"))
    quote = F.when(F.col("fault") == 3, "").otherwise('"')
    body = F.concat(F.lit('"'), "slot", F.lit('": ['), F.array_join(F.transform(said, lambda x: F.concat(quote, F.when(F.col("fault") == 3, F.substring(x, 2, 9)).otherwise(x), quote)), ", "), F.lit("]"))
    a = a.withColumn("body", F.when((F.col("fault") != 2) | (F.col("g") > 0), body))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("g", "body")))), lambda x: x["body"]), ", ")
    a = a.groupBy("query_id", "fault").agg(joined.alias("all"))
    raw = F.concat(F.lit('{"group_selections": {'), "all", F.when(F.col("fault") == 1, "}").otherwise("}}"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("required") & F.col("procedure"), F.struct("slot_no", "group_key", "branch"))))
    p = s.groupBy("query_id", "fault", "procedure", "broad").agg(ordered.alias("need"))
    groups = F.transform("need", lambda x: x["group_key"])
    most = F.when(F.col("fault") == 19, 4).when(F.col("fault") == 5, 3).otherwise(20)
    plans = p.select(
        "query_id", "procedure", "broad",
        F.when(F.col("fault") == 18, F.array(F.lit("xyzzy"))).otherwise(F.array().cast("array<string>")).alias("actions"),
        F.col("procedure").alias("covered"),
        F.when(F.col("fault") == 13, F.concat(groups, F.array(F.lit("zz")))).otherwise(groups).alias("covered_groups"),
        F.array_distinct(F.filter(F.transform("need", lambda x: x["branch"]), lambda b: b != "common")).alias("covered_branches"),
        most.alias("most"),
    )
    return plans, s, u, a.select("query_id", raw.alias("raw"))


_SQL_COLUMNS = ", ".join(f"{v.replace(' div ', ' // ')} AS {k}" for k, v in _COLUMNS.items() if k not in ("g",))
_INPUTS = f"""s0 AS (SELECT doc_id, s, unnest(range(len(s))) AS i FROM (SELECT doc_id, {sql_sentences("text")} AS s FROM documents)),
u0 AS (SELECT {_SQL_COLUMNS}, (i % 20) // 4 AS g, s[i + 1] AS text FROM s0),
u AS (SELECT *, 'u' || (ord + 1) AS unit, 'k' || g AS group_key, {_BRANCH} AS branch, NOT procedure OR g < 3 AS required, regexp_matches(text, '[.!?]$') AND ord <> 6 AS selectable, {_PHASE} AS phase,
 CASE r WHEN 0 THEN ['check', 'record'] WHEN 1 THEN ['check'] WHEN 2 THEN ['report'] ELSE ['prepare'] END AS families FROM u0),
s AS (SELECT query_id, fault, procedure, broad, g, group_key, branch, required, 'g' || (g + 1) AS slot, CASE WHEN fault = 14 THEN -g ELSE g END AS slot_no, list(unit ORDER BY ord) AS allowed FROM u WHERE selectable GROUP BY ALL),
held AS (SELECT query_id, {_SLOT} AS g, unit, ord, fault FROM u WHERE {_PICKED}),
said AS (SELECT query_id, g, CASE WHEN fault = 10 THEN list_reverse(l) WHEN fault = 6 THEN l || l[1:1] WHEN fault = 7 THEN l || ['u99'] ELSE l END AS said FROM (SELECT s.query_id, s.g, s.fault, coalesce(list(h.unit ORDER BY h.ord) FILTER (h.unit IS NOT NULL), []) AS l FROM s LEFT JOIN held h ON h.query_id = s.query_id AND h.g = s.g GROUP BY ALL)),
p AS (SELECT query_id, fault, procedure, broad, CASE WHEN fault = 18 THEN ['xyzzy'] ELSE [] END AS actions, CASE fault WHEN 19 THEN 4 WHEN 5 THEN 3 ELSE 20 END AS most, list(group_key ORDER BY slot_no) FILTER (required AND procedure) AS groups FROM s GROUP BY ALL)"""


# The faults of the shape (1 to 3) are told by number: a cut answer, a slot that isn't named (where there is one to leave out), numbers for units.
@query(
    "v07_selection_reasons",
    f"""WITH {_INPUTS},
pick AS (SELECT s.query_id, s.slot_no, s.allowed, s.branch AS slot_branch, s.required, nth, said[nth] AS unit FROM (SELECT query_id, g, said, unnest(CASE WHEN len(said) = 0 THEN [NULL] ELSE range(1, len(said) + 1) END) AS nth FROM said) JOIN s USING (query_id, g)),
k AS (SELECT pick.*, u.ord, u.group_key, u.branch, u.selectable, u.phase, u.families, u.text, u.unit IS NULL AND pick.unit IS NOT NULL AS missing FROM pick LEFT JOIN u ON u.query_id = pick.query_id AND u.unit = pick.unit),
o AS (SELECT *, coalesce(lag(ord) OVER (PARTITION BY query_id, slot_no ORDER BY nth) > ord, false) AS slot_back, coalesce(last_value(ord IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY slot_no, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > ord, false) AS back FROM k),
ps AS (SELECT query_id, slot_no, CASE WHEN bool_or(unit IS NOT NULL AND NOT list_contains(allowed, unit)) THEN 'selection_wrong_group' WHEN bool_or(slot_back) THEN 'selection_source_order' WHEN bool_and(required) AND count(unit) = 0 THEN CASE WHEN min(slot_branch) <> 'common' THEN 'selection_branch' ELSE 'selection_missing_group' END END AS why FROM o GROUP BY ALL),
sr AS (SELECT query_id, arg_min(why, slot_no) AS slot_reason FROM ps WHERE why IS NOT NULL GROUP BY 1),
seen AS (SELECT query_id, count(unit) AS n, count(DISTINCT unit) AS nd, count(*) FILTER (missing) AS nu, count(*) FILTER (NOT selectable) AS nc, bool_or(back) AS back, string_agg(text, chr(10)) AS text FROM o GROUP BY 1),
able AS (SELECT u.* FROM u JOIN p USING (query_id) WHERE p.procedure AND p.broad AND u.required AND u.selectable AND list_contains(groups, u.group_key)),
ph AS (SELECT query_id, branch, phase, arg_min(unit, ord) AS unit, arg_min(families, ord) AS families FROM able WHERE phase <> 'unspecified' GROUP BY ALL),
fam AS (SELECT query_id, family, arg_min(unit, ord) AS unit FROM (SELECT query_id, unit, ord, unnest(families) AS family FROM able) GROUP BY ALL),
wit AS (SELECT query_id, count(DISTINCT unit) AS witness FROM (SELECT query_id, arg_min(unit, ord) AS unit FROM able GROUP BY query_id, group_key UNION ALL SELECT query_id, unit FROM ph UNION ALL SELECT query_id, unit FROM fam) GROUP BY 1),
hp AS (SELECT DISTINCT query_id, branch, phase FROM o WHERE unit IS NOT NULL), ha AS (SELECT DISTINCT query_id, branch, phase, unnest(families) AS family FROM o WHERE unit IS NOT NULL),
lp AS (SELECT DISTINCT query_id, true AS lost FROM ph ANTI JOIN hp USING (query_id, branch, phase)),
la AS (SELECT DISTINCT query_id, true AS lost FROM (SELECT query_id, branch, phase, unnest(families) AS family FROM ph) ANTI JOIN ha USING (query_id, branch, phase, family)),
lf AS (SELECT query_id, count(DISTINCT fam.family) > coalesce(any_value(h.n), 0) AS lost FROM fam LEFT JOIN (SELECT query_id, count(DISTINCT family) AS n FROM ha GROUP BY 1) h USING (query_id) GROUP BY 1)
SELECT query_id, CASE WHEN reason = 'selection_schema' THEN 0 ELSE n END::BIGINT AS n_selected, reason FROM (SELECT p.query_id, n, CASE
 WHEN p.fault = 1 OR (p.fault = 2 AND EXISTS (SELECT 1 FROM s WHERE s.query_id = p.query_id AND s.g = 0)) OR (p.fault = 3 AND n > 0) THEN 'selection_schema'
 WHEN n = 0 THEN 'selection_empty' WHEN n > most THEN 'selection_limit' WHEN nd < n THEN 'selection_duplicate_id' WHEN nu > 0 THEN 'selection_unknown_id' WHEN nc > 0 THEN 'selection_non_selectable'
 WHEN slot_reason IS NOT NULL THEN slot_reason WHEN procedure AND p.fault = 13 THEN 'selection_contract_drift' WHEN seen.back THEN 'selection_source_order' WHEN NOT procedure THEN ''
 WHEN broad AND coalesce(witness, 0) > most THEN 'selection_requirement_capacity' WHEN lp.lost THEN 'selection_missing_phase' WHEN la.lost THEN 'selection_missing_phase_action' WHEN lf.lost THEN 'selection_insufficient_action_diversity'
 WHEN p.fault = 18 AND NOT contains(seen.text, 'xyzzy') THEN 'selection_missing_action' ELSE '' END AS reason
 FROM p JOIN seen USING (query_id) LEFT JOIN sr USING (query_id) LEFT JOIN wit USING (query_id) LEFT JOIN lp USING (query_id) LEFT JOIN la USING (query_id) LEFT JOIN lf USING (query_id)) p""",
)
def v07_reasons(spark, sf):
    return selection.validate(*_inputs(spark, sf))


_FACETS = f"""{_INPUTS},
pl AS (SELECT p.query_id, fault, most, actions, CASE WHEN fault = 13 THEN groups || ['zz'] ELSE groups END AS groups, (SELECT coalesce(list(DISTINCT branch), []) FROM s WHERE s.query_id = p.query_id AND required AND branch <> 'common') AS branches FROM p WHERE procedure AND broad AND groups IS NOT NULL),
able AS (SELECT u.*, pl.actions FROM u JOIN pl USING (query_id) WHERE required AND selectable AND list_contains(pl.groups, group_key)),
anchor AS (SELECT query_id, branch, phase, arg_min(families, ord) AS families FROM able WHERE phase <> 'unspecified' GROUP BY ALL),
asked AS (SELECT query_id, 'group' AS kind, unnest(groups) AS key FROM pl UNION SELECT query_id, 'branch', unnest(branches) FROM pl UNION SELECT query_id, 'phase', branch || '/' || phase FROM anchor
 UNION SELECT query_id, 'phase_action', branch || '/' || phase || '/' || unnest(families) FROM anchor UNION SELECT query_id, 'action_family', unnest(families) FROM able UNION SELECT query_id, 'query_action', unnest(actions) FROM pl),
covers AS (SELECT query_id, 'group' AS kind, group_key AS key, unit, ord FROM able UNION ALL SELECT query_id, 'branch', branch, unit, ord FROM able UNION ALL SELECT query_id, 'phase', branch || '/' || phase, unit, ord FROM able
 UNION ALL SELECT query_id, 'phase_action', branch || '/' || phase || '/' || unnest(families), unit, ord FROM able UNION ALL SELECT query_id, 'action_family', unnest(families), unit, ord FROM able
 UNION ALL SELECT query_id, 'query_action', a, unit, ord FROM (SELECT query_id, unit, ord, text, unnest(actions) AS a FROM able) WHERE contains(text, a)),
facet AS (SELECT a.query_id, a.kind, a.key, min(ord) AS first, coalesce(list(unit ORDER BY ord) FILTER (unit IS NOT NULL), []) AS eligible FROM asked a LEFT JOIN covers c ON c.query_id = a.query_id AND c.kind = a.kind AND c.key = a.key GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first NULLS LAST, CASE kind WHEN 'phase_action' THEN 0 WHEN 'phase' THEN 1 WHEN 'action_family' THEN 3 WHEN 'query_action' THEN 4 ELSE 2 END, kind, key) AS slot_no FROM facet)"""


@query("e13_required_facets", f"WITH {_FACETS} SELECT query_id, slot_no::BIGINT AS slot_no, kind, key, array_to_string(eligible, ',') AS eligible FROM f")
def e13_facets(spark, sf):
    plans, _, units, _ = _inputs(spark, sf)
    return selection.facets(plans, units).select("query_id", F.col("slot_no").cast("long").alias("slot_no"), "kind", "key", F.array_join("eligible", ",").alias("eligible"))


# Answers take the first unit of each facet, or the last (fault 10); 3 leaves out the first facet, 8 says a number, 7 names a unit that isn't there.
@query(
    "v07_facet_reasons",
    f"""WITH {_FACETS}, told AS (SELECT f.query_id, slot_no, eligible, pl.fault, CASE WHEN fault = 7 AND slot_no = 2 THEN 'u99' WHEN len(eligible) = 0 THEN 'u0' WHEN fault = 10 THEN eligible[-1] ELSE eligible[1] END AS unit FROM f JOIN pl USING (query_id)),
wrong AS (SELECT query_id, arg_min(CASE WHEN fault = 8 AND slot_no = 1 THEN 'selection_schema' ELSE 'selection_wrong_facet' END, slot_no) AS why FROM told WHERE (fault = 8 AND slot_no = 1) OR NOT list_contains(eligible, unit) GROUP BY 1),
one AS (SELECT query_id, unit, min(slot_no) AS slot_no FROM told WHERE NOT (fault = 8 AND slot_no = 1) GROUP BY ALL),
o AS (SELECT one.query_id, coalesce(lag(u.ord) OVER (PARTITION BY one.query_id ORDER BY slot_no) > u.ord, false) AS back FROM one LEFT JOIN u ON u.query_id = one.query_id AND u.unit = one.unit),
n AS (SELECT query_id, count(*) AS n, bool_or(back) AS back FROM o GROUP BY 1),
wit AS (SELECT query_id, count(DISTINCT unit) AS witness FROM (SELECT query_id, eligible[1] AS unit FROM f WHERE kind IN ('group', 'phase', 'action_family') AND len(eligible) > 0) GROUP BY 1)
SELECT pl.query_id, CASE WHEN fault = 3 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_selected, CASE WHEN fault = 3 AND EXISTS (SELECT 1 FROM f WHERE f.query_id = pl.query_id) THEN 'selection_schema' WHEN why IS NOT NULL THEN why WHEN coalesce(n, 0) = 0 THEN 'selection_empty' WHEN n > most THEN 'selection_limit'
 WHEN n.back THEN 'selection_source_order' WHEN witness > most THEN 'selection_requirement_capacity' ELSE '' END AS reason FROM pl LEFT JOIN n USING (query_id) LEFT JOIN wrong USING (query_id) LEFT JOIN wit USING (query_id)""",
)
def v07_facet_reasons(spark, sf):
    plans, slots, units, _ = _inputs(spark, sf)
    fault = F.expr("(query_id div 10000 + query_id % 10000) % 20")
    plans = plans.filter("procedure AND broad")
    f = write_shared(selection.facets(plans, units), "selection-facets")
    unit = F.when((fault == 7) & (F.col("slot_no") == 2), "u99").when(F.size("eligible") == 0, "u0").when(fault == 10, F.element_at("eligible", -1)).otherwise(F.try_element_at("eligible", F.lit(1)))
    value = F.when((fault == 8) & (F.col("slot_no") == 1), "8").otherwise(F.concat(F.lit('"'), unit, F.lit('"')))
    body = F.when((fault != 3) | (F.col("slot_no") > 1), F.concat(F.lit('"'), "slot", F.lit('": '), value))
    answers = f.groupBy("query_id").agg(F.concat(F.lit('{"facet_selections": {'), F.array_join(F.collect_list(body), ", "), F.lit("}}")).alias("raw"))
    # A plan without any facet has an answer without any.
    answers = plans.select("query_id").join(answers, "query_id", "left").select("query_id", F.coalesce("raw", F.lit('{"facet_selections": {}}')).alias("raw"))
    return selection.validate_facets(plans, f, units, answers)


# The same catalogues as evidence, with other faults: the question's number of twenty takes away what one rule looks for.
_EVIDENCE = {
    "query_id": "query_id",
    "doc_id": "CASE WHEN g >= 3 THEN query_id div 10000 + 1 ELSE query_id div 10000 END",
    "group_key": "group_key",
    "branch": "branch",
    "position": "ord",
    "idx": "CASE WHEN fault = 8 THEN -ord ELSE ord END",
    "text": "CASE WHEN fault = 9 AND g = 0 THEN 'same' ELSE text END",
    "section": "CASE WHEN fault = 12 THEN 'VRE' ELSE '' END",
    "seed": "fault <> 3",
    "complete": "fault <> 6",
    "procedural": "fault <> 7",
    "headed": "false",
}
_HELD = "NOT (fault = 4 AND g = 1) AND NOT (fault = 5 AND g = 2)"
_ASKED = {
    "query_id": "query_id",
    "kind": "CASE WHEN fault = 5 THEN 'comparison' WHEN procedure THEN 'procedure' ELSE 'summary' END",
    "clarify": "fault = 1",
    "domain": "CASE WHEN fault = 2 THEN 'unknown' ELSE 'hospital' END",
    "scoped": "false",
    "text": "CASE WHEN fault = 10 THEN 'xyzzy' WHEN fault = 12 THEN '소독' ELSE 'plain' END",
    "least": "CASE WHEN fault = 14 THEN 3 ELSE 1 END",
}
_ASPECTS = [("xyzzy", "xyzzy"), ("plain", "[a-z]")]
_SQL_EVIDENCE = ", ".join(f"{v.replace(' div ', ' // ')} AS {k}" for k, v in _EVIDENCE.items())
_SQL_ASKED = ", ".join(f"{v} AS {k}" for k, v in _ASKED.items())


@query(
    "e05_gate_reasons",
    f"""WITH {_INPUTS}, q AS (SELECT DISTINCT {_SQL_ASKED}, fault, CASE WHEN fault IN (4, 15) THEN ['adult'] WHEN fault IN (5, 16) THEN ['adult', 'pediatric'] ELSE [] END AS branches FROM u),
e AS (SELECT {_SQL_EVIDENCE} FROM u WHERE {_HELD}),
k AS (SELECT e.*, q.kind, coalesce(e.idx >= lag(e.idx) OVER (PARTITION BY query_id, group_key ORDER BY position), true) AS ok, len(branches) <> 1 OR e.branch = 'common' OR list_contains(branches, e.branch) AS kept FROM e JOIN q USING (query_id)),
f AS (SELECT query_id, bool_or(seed) AS seeded, list(DISTINCT branch) FILTER (kept) AS got, bool_and(complete) FILTER (kept) AS complete, bool_or(procedural) FILTER (kept) AS procedural, bool_and(ok) FILTER (kept) AS ordered, count(*) FILTER (kept) - count(DISTINCT branch || '|' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) FILTER (kept) AS repeats,
 bool_or(regexp_matches(text, '[a-z]', 'i')) FILTER (kept) AS latin, bool_or(contains(lower(text), 'xyzzy')) FILTER (kept) AS magic, bool_or(contains(text, '소독')) FILTER (kept) AS cleaned, bool_or(contains(lower(text || ' ' || section), 'foley')) FILTER (kept) AS foley, count(DISTINCT doc_id) FILTER (kept) AS docs FROM k GROUP BY 1),
r AS (SELECT query_id, CASE WHEN clarify OR domain <> 'hospital' THEN 'domain_or_clarification' WHEN NOT coalesce(seeded, false) THEN 'no_topic_evidence'
 WHEN len(branches) = 1 AND NOT list_has_all(coalesce(got, []), branches) THEN 'missing_requested_branch' WHEN kind = 'comparison' AND len(branches) = 2 AND NOT list_has_all(coalesce(got, []), branches) THEN 'missing_comparison_branch'
 WHEN NOT complete THEN 'incomplete_semantic_block' WHEN kind = 'procedure' AND NOT procedural THEN 'missing_procedure_unit' WHEN kind = 'procedure' AND NOT ordered THEN 'procedure_source_order' WHEN kind = 'procedure' AND repeats > 0 THEN 'duplicate_evidence'
 WHEN (fault = 10 AND NOT magic) OR (fault NOT IN (10, 12) AND NOT latin) THEN 'missing_requested_aspect' WHEN fault = 11 AND NOT foley THEN 'missing_entity' WHEN fault = 12 AND NOT cleaned THEN 'missing_action'
 WHEN docs < least OR fault = 13 THEN 'missing_document' ELSE 'supported' END AS reason FROM q LEFT JOIN f USING (query_id)) SELECT query_id, reason = 'supported' AS sufficient, reason FROM r""",
)
def e05_gate(spark, sf):
    _, _, units, _ = _inputs(spark, sf)
    evidence = units.filter(_HELD).select(*[F.expr(v).alias(k) for k, v in _EVIDENCE.items()])
    none = F.array().cast("array<string>")
    adult, both = F.array(F.lit("adult")), F.array(F.lit("adult"), F.lit("pediatric"))
    asked = units.select("query_id", "fault", "procedure").distinct()
    asked = asked.select(
        *[F.expr(v).alias(k) for k, v in _ASKED.items()],
        F.when(F.col("fault").isin(4, 15), adult).when(F.col("fault").isin(5, 16), both).otherwise(none).alias("branches"),
        F.when(F.col("fault") == 11, F.array(F.lit("foley"))).when(F.col("fault") == 12, F.array(F.lit("vre"))).otherwise(none).alias("entities"),
        F.when(F.col("fault") == 13, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")).alias("documents"),
    )
    return gate.sufficiency(asked, evidence, _ASPECTS)
