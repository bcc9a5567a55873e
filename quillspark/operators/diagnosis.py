"""Where a generated answer fails first: sixteen stages from the receipt of the answer to its last check.

cases  query_id, received (boolean), raw (the answer, JSON), requested_phase, and what the answer has to keep, as arrays of texts:
       facts, numbers, quantity_units, times, conditions, negations, steps
units  query_id, unit_id, position (in the source), branch, phase, text: the evidence that the answer may rest on
slots  query_id, slot_no, slot_id, requirement, unit_ids: what statements that rest on certain units have to tell

An answer is {"statements": [{"text": ..., "supporting_source_unit_ids": [...]}]}: 1 to 16 statements of 1 to 700 characters on 1
to 4 units each, and nothing else. A null answer is no JSON, and neither is one that names a key twice. A case without units, or
with two units of one id, has no valid catalogue. Null texts of units are empty; null arrays and phases ask for nothing. Repeated
cases give repeated rows. Units and slots of other cases and columns of other names are left out; empty tables give an empty
result. Texts are taken to be in compatibility form (unicode.normal_form).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions import terms as D
from quillspark.functions.text import let
from quillspark.operators.evidence import quantities

# The stages in order, with the name of what checks each.
STAGES = {
    "http_response_received": "http",
    "json_decode": "json_decode",
    "structured_schema_validation": "structured_schema",
    "supporting_source_unit_id_validation": "source_unit_id",
    "evaluation_action_strength_validation": "evaluation_action_strength",
    "citation_support_validation": "citation_support",
    "answer_coverage_validation": "answer_coverage",
    "number_validation": "number",
    "unit_validation": "unit",
    "time_validation": "time",
    "condition_exception_validation": "condition_exception",
    "negation_prohibition_validation": "negation_prohibition",
    "action_source_order_validation": "action_source_order",
    "branch_phase_validation": "branch_phase",
    "phase_scope_validation": "phase_scope",
    "final_candidate_validation": "final_candidate",
}
# Bounds of an answer.
MOST_STATEMENTS, MOST_UNITS, MOST_CHARACTERS = 16, 4, 700
# Endings that a word of a requirement may lose, and the share of its pieces that have to be found.
ENDINGS = "으로|에서|에게|까지|부터|한다|하고|하여|하며|했다|되는|되면|해야|별|한|는|은|이|가|을|를|에|의|와|과"
SHARE = 0.8
# What tells that a text speaks of the time during and after a procedure.
DURING = r"시작\s*후|시행\s*중|시술\s*중|진정\s*중|수혈\s*중|투여\s*중|주입\s*중|진행\s*중"
AFTER = r"(?:완료|종료|회복|퇴실)\s*후|사후"

#: What an answer has to keep: columns of cases.
WANTED = ("facts", "numbers", "quantity_units", "times", "conditions", "negations", "steps")
#: The stages that look at statements one by one.
SINGLE = ("supporting_source_unit_id_validation", "evaluation_action_strength_validation", "number_validation", "unit_validation", "condition_exception_validation", "negation_prohibition_validation", "branch_phase_validation")
ITEM_NUMBER = r"^\s*\d{1,2}\s*[.)]\s*"
LATIN = "[a-z0-9%]+"
WORD = f"[가-힣]+|{LATIN}"
_SHAPE = "^OBJECT<statements: ARRAY<OBJECT<supporting_source_unit_ids: ARRAY<STRING>, text: STRING>>>$"
_STATEMENTS = "array<struct<text:string,supporting_source_unit_ids:array<string>>>"
_FAIL = "struct<code:string,statement:long,unit_ids:array<string>>"


def _low(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), ITEM_NUMBER, "")


def _latin(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))


def _korean(low: Column) -> Column:
    """Pieces of the Korean words: pairs of syllables without the word's ending, and words of one syllable, which also go with a word beside them.

    The text is searched as a whole, as functions of its single words would take many times as long.
    """
    found = F.array_join(F.regexp_extract_all(low, F.lit("[가-힣][^a-z0-9%]*"), F.lit(0)), "%")  # % stands where Latin words part Korean ones

    def of(own: Column) -> Column:
        stems = F.regexp_replace(own, f"(?<![가-힣])([가-힣]{{2,}}?)(?:{ENDINGS})(?![가-힣])", "$1")
        joined = F.regexp_replace(stems, "(?<![가-힣])([가-힣])[^가-힣%]+(?=[가-힣])", "$1")
        return F.array_distinct(F.concat(F.regexp_extract_all(joined, F.lit("(?=([가-힣]{2}))"), F.lit(1)), F.regexp_extract_all(own, F.lit("(?<![가-힣])[가-힣](?![가-힣])"), F.lit(0))))

    return let(found, of)


def pieces(text: Column) -> Column:
    """Distinct pieces of a text by which two ways of saying a thing are compared: Latin words, and pairs of Korean syllables."""
    return let(_low(text), lambda low: F.array_distinct(F.concat(_korean(low), _latin(low))))


def tight(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def known(text: Column) -> Column:
    """What told() looks for requirements in."""
    return let(_low(text), lambda low: F.struct(tight(text).alias("tight"), low.alias("low"), _korean(low).alias("korean")))


def told(requirement: Column, own: Column, sense: bool = True) -> Column:
    """Whether a text (known()) holds a requirement: to the letter but for case and white space or, if its sense is enough, for the most part."""
    literal = F.contains(own["tight"], tight(requirement))

    def most(p: Column) -> Column:
        latin = F.when(F.exists(p, lambda w: ~w.rlike("^[가-힣]")), F.size(F.array_intersect(p, _latin(own["low"])))).otherwise(0)
        return (F.size(p) > 0) & (F.size(F.array_intersect(p, own["korean"])) + latin >= SHARE * F.size(p))

    return literal | let(pieces(requirement), most) if sense else literal


def _all_told(field: str, own: Column, sense: bool = True) -> Column:
    return F.coalesce(F.forall(F.filter(field, lambda r: r.isNotNull()), lambda r: told(r, own, sense)), F.lit(True))


def _statement_codes(s: Column) -> dict[str, Column]:
    """By stage, the code of a statement at fault. Fields: text, ids, source (of its units), lines, unknown, branches, phases, said and held (quantities), foreign.

    What says its source word for word changes nothing in it and isn't searched.
    """
    text, source, lines, foreign = s["text"], s["source"], s["lines"], s["foreign"]
    numbers = lambda q: F.array_distinct(F.transform(q, lambda x: F.regexp_extract(x, r"^\d+(?:\.\d+)?", 0)))
    differ = lambda pattern: text.rlike(pattern) != source.rlike(pattern)
    targets = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(D.CASE_TARGET), F.lit(1))))
    wrong = "unsupported_number_or_unit"
    judge = lambda own, given: F.when(F.size(own) > 0, let(A.of_clauses(given), lambda of: A.strength_check(own, of)["error_code"]))
    # A clause of the source asks for nothing else than the source.
    strength = let(A.clauses(lines), lambda given: let(A.of_clauses(F.array_except(A.clauses(text), given)), lambda own: judge(own, given)))
    return {
        "supporting_source_unit_id_validation": F.when(F.size(F.array_distinct(s["ids"])) < F.size(s["ids"]), "duplicate_evidence_id").when(s["unknown"] > 0, "unknown_evidence_id"),
        "evaluation_action_strength_validation": F.when(text != lines, strength),  # what a source says word for word asks for the same
        "number_validation": F.when(F.size(F.array_except(numbers(foreign), numbers(s["held"]))) > 0, wrong),
        "unit_validation": F.when(F.size(foreign) > 0, wrong),
        "condition_exception_validation": F.when((text != source) & (differ(D.CONDITION) | differ(D.EXCEPTION) | (targets(text) != targets(source))), "condition_changed"),
        "negation_prohibition_validation": F.when((text != source) & differ(D.NEGATION), "negation_changed"),
        "branch_phase_validation": F.when(F.size(s["branches"]) > 1, "branch_mixing").when(F.size(s["phases"]) > 1, "phase_mixing"),
    }


def _statements(rows: DataFrame) -> DataFrame:
    """rows and own: its statements in order, each with its text, ids, places of its units and codes, one for each stage of SINGLE.

    statements and units (array, in the order of their positions) are those of the row. Of units of one id the first counts.
    """
    unit = lambda i: F.get(F.filter("units", lambda u: u["unit_id"] == i), F.lit(0))
    found = lambda s: F.filter(s["cited"], lambda u: u.isNotNull())
    some = lambda s, field, able: F.array_distinct(F.filter(F.transform(found(s), lambda u: u[field]), able))

    def cited(s: Column) -> Column:
        ids = s["supporting_source_unit_ids"]
        return F.struct(s["text"].alias("text"), ids.alias("ids"), F.transform(ids, unit).alias("cited"))

    def facts(s: Column) -> Column:
        texts = F.transform(found(s), lambda u: u["text"])
        return F.struct(
            s["text"].alias("text"),
            s["ids"].alias("ids"),
            F.transform(s["cited"], lambda u: u["position"]).alias("places"),
            (F.size(s["cited"]) - F.size(found(s))).alias("unknown"),
            some(s, "branch", lambda b: b.isin("adult", "pediatric")).alias("branches"),
            some(s, "phase", lambda p: ~p.isin("", "unspecified")).alias("phases"),
            F.array_join(texts, " ").alias("source"),
            F.array_join(texts, "\n").alias("lines"),
        )

    def amounts(s: Column) -> Column:
        kept = [s[f].alias(f) for f in ("text", "ids", "places", "unknown", "branches", "phases", "source", "lines")]
        changed = lambda c: F.when(s["text"] != s["source"], quantities(c)).otherwise(F.array().cast("array<string>"))
        return F.struct(*kept, changed(s["text"]).alias("said"), changed(s["source"]).alias("held"))

    def coded(s: Column, at: Column) -> Column:
        codes = _statement_codes(s)
        return F.struct(at.alias("at"), s["text"].alias("text"), s["ids"].alias("ids"), s["places"].alias("places"), F.array(*[codes[stage] for stage in SINGLE]).alias("codes"))

    foreign = lambda s: s.withField("foreign", F.array_except(s["said"], s["held"]))
    own = F.col("statements")
    for step in (cited, facts, amounts, foreign, coded):
        own = F.transform(own, step)
    return rows.withColumn("own", own)


def _linked(slot: Column) -> Column:
    """The text of the statements that rest on a unit of a slot."""
    return F.array_join(F.transform(F.filter("own", lambda s: F.arrays_overlap(s["ids"], slot["unit_ids"])), lambda s: s["text"]), " ")


def diagnose(cases: DataFrame, units: DataFrame, slots: DataFrame) -> DataFrame:
    """query_id, candidate_sha256, n_statements, stage_no, stage, validator, error_code, statement, unit_ids, statuses, passed.

    stage to unit_ids tell of the first stage that fails and are null if none does; statement is that at fault, from 0, or null
    where the answer as a whole is. statuses has PASS, FAIL or NOT_RUN for each stage. Every rule of the last stage is one of an
    earlier stage, so it passes whenever it is reached.

    Cases, units and slots are exchanged by case, each once; those of a case, whose evidence is what a prompt holds, are one row.
    """
    c = cases.select("query_id", "received", "raw", "requested_phase", *WANTED)
    unit = F.struct("position", "unit_id", "branch", "phase", F.coalesce("text", F.lit("")).alias("text"))
    catalogue = units.groupBy("query_id").agg(F.count("*").alias("n_units"), F.array_sort(F.collect_set("unit_id")).alias("known"), F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), unit))).alias("units"))
    asked = slots.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("slot_no", "slot_id", "requirement", "unit_ids"))).alias("slots"))
    rows = c.join(catalogue, "query_id", "left").join(asked, "query_id", "left")
    no_units = F.array().cast(catalogue.schema["units"].dataType)
    return judged(rows.withColumn("units", F.coalesce("units", no_units)))


def judged(rows: DataFrame) -> DataFrame:
    """diagnose() for cases that hold their evidence: nothing is exchanged.

    rows: the columns of cases, units (array of position, unit_id, branch, phase, text, by position; no text is null), n_units,
    known (their ids, sorted, each once) and slots (array of slot_no, slot_id, requirement, unit_ids, in order). The checks of a
    case end with the first that fails.
    """
    c = rows.withColumn("v", F.try_parse_json("raw"))
    shaped = F.coalesce(F.schema_of_variant("v").rlike(_SHAPE), F.lit(False))
    c = c.withColumn("statements", F.when(shaped, F.try_variant_get("v", "$.statements", _STATEMENTS)))
    sound = lambda s: F.length(s["text"]).between(1, MOST_CHARACTERS) & F.size(s["supporting_source_unit_ids"]).between(1, MOST_UNITS) & ~F.exists(s["supporting_source_unit_ids"], lambda u: u.isNull())
    schema = F.size("statements").between(1, MOST_STATEMENTS) & F.forall("statements", lambda s: F.coalesce(sound(s), F.lit(False)))
    c = c.withColumns({"decoded": F.col("v").isNotNull(), "statements": F.when(F.coalesce(F.col("received"), F.lit(False)) & schema, F.col("statements"))}).drop("v")
    rows = _statements(c)

    none = F.lit(None).cast(_FAIL)
    ids = F.flatten(F.transform("own", lambda s: s["ids"]))
    rows = rows.withColumns({"generated": F.array_join(F.transform("own", lambda s: s["text"]), " "), "cited": ids, "places": F.flatten(F.transform("own", lambda s: s["places"]))})
    text = F.col("generated")

    def whole(bad: Column, code: Column | str, of: Column | None = None) -> Column:
        named = F.lit(code) if isinstance(code, str) else code
        unit_ids = F.array_distinct("cited") if of is None else of
        return F.when(bad, F.struct(named.alias("code"), F.lit(None).cast("long").alias("statement"), unit_ids.alias("unit_ids")))

    def single(stage: str) -> Column:
        code = lambda x: F.get(x["codes"], F.lit(SINGLE.index(stage)))
        failed = F.filter("own", lambda x: code(x).isNotNull())
        return F.get(F.transform(failed, lambda x: F.struct(code(x).alias("code"), x["at"].cast("long").alias("statement"), x["ids"].alias("unit_ids"))), F.lit(0))

    no_ids = F.array().cast("array<string>")
    missed = F.get(F.filter("slots", lambda s: let(known(_linked(s)), lambda own: ~told(s["requirement"], own))), F.lit(0))
    ordered = F.coalesce(F.forall(F.sequence(F.lit(1), F.greatest(F.size("places") - 1, F.lit(1))), lambda i: (F.size("places") < 2) | (F.get("places", i - 1) < F.get("places", i))), F.lit(False))
    broken = F.coalesce((F.col("n_units") == 0) | (F.size("known") < F.col("n_units")), F.lit(True))
    phase = (F.col("requested_phase") == "before") & (text.rlike(DURING) | text.rlike(AFTER))
    early = [
        whole(~F.coalesce(F.col("received"), F.lit(False)), "http_response_missing", no_ids),
        whole(~F.col("decoded"), "provider_json", no_ids),
        whole(F.col("statements").isNull(), "controlled_schema", no_ids),
        F.coalesce(whole(broken, "invalid_evidence_catalog", no_ids), single("supporting_source_unit_id_validation")),
        single("evaluation_action_strength_validation"),
    ]

    def late(own: Column) -> list[Column]:
        kept = lambda field, code, sense=True: whole(~_all_told(field, own, sense), code)
        return [
            kept("facts", "critical_fact_preservation"),
            F.coalesce(whole(F.array_sort(F.array_distinct("cited")) != F.col("known"), "evidence_coverage"), let(missed, lambda s: whole(s.isNotNull(), F.concat(F.lit("required_coverage:"), s["slot_id"]), s["unit_ids"]))),
            F.coalesce(single("number_validation"), kept("numbers", "critical_number_preservation", False)),
            F.coalesce(single("unit_validation"), kept("quantity_units", "critical_unit_preservation", False)),
            kept("times", "critical_time_preservation"),
            F.coalesce(single("condition_exception_validation"), kept("conditions", "critical_condition_preservation")),
            F.coalesce(single("negation_prohibition_validation"), kept("negations", "critical_negation_preservation")),
            F.coalesce(kept("steps", "critical_action_preservation"), whole((F.size(F.array_distinct("cited")) < F.size("cited")) | ~ordered, "source_order")),
            single("branch_phase_validation"),
            whole(phase, "phase_scope"),
            none,
        ]

    def told_at(n: int) -> Callable[[Column], Column]:
        return lambda x: F.when(x["code"].isNotNull(), F.struct(F.lit(n).cast("long").alias("stage_no"), x.alias("fail")))

    def first(checks: list[Column], before: int) -> Column:
        return F.coalesce(*[let(c, told_at(n)) for n, c in enumerate(checks, before + 1)])

    failed = F.coalesce(first(early, 0), let(known(text), lambda own: first(late(own), len(early))))
    rows = rows.select("query_id", "raw", F.coalesce(F.size("statements"), F.lit(0)).cast("long").alias("n"), failed.alias("failed")).select("query_id", "raw", "n", "failed.*")
    named = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("stage_no") - 1)
    status = F.transform(F.sequence(F.lit(1), F.lit(len(STAGES))), lambda i: F.when(F.col("stage_no").isNull() | (i < F.col("stage_no")), "PASS").when(i == F.col("stage_no"), "FAIL").otherwise("NOT_RUN"))
    return rows.select(
        "query_id",
        F.sha2("raw", 256).alias("candidate_sha256"),
        F.col("n").alias("n_statements"),
        "stage_no",
        named(STAGES).alias("stage"),
        named(STAGES.values()).alias("validator"),
        F.col("fail.code").alias("error_code"),
        F.col("fail.statement").alias("statement"),
        F.col("fail.unit_ids").alias("unit_ids"),
        status.alias("statuses"),
        F.col("stage_no").isNull().alias("passed"),
    )
