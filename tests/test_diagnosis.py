"""The sixteen stages: each code from a sound answer by one change."""

import json

import pytest

from quillspark.operators import diagnosis

C = "query_id long, received boolean, raw string, requested_phase string, facts array<string>, numbers array<string>, quantity_units array<string>, times array<string>, conditions array<string>, negations array<string>, steps array<string>"
U = "query_id long, unit_id string, position int, branch string, phase string, text string"
S = "query_id long, slot_no int, slot_id string, requirement string, unit_ids array<string>"

UNITS = [("u1", 0, "adult", "", "약물 5 mg을 투여한다."), ("u2", 1, "pediatric", "before", "소아인 경우 즉시 기록한다."), ("u3", 2, "", "after", "금식하지 않는다.")]
SAID = [("약물 5 mg을 투여한다.", ["u1"]), ("소아인 경우 즉시 기록한다.", ["u2"]), ("금식하지 않는다.", ["u3"])]


def said(**change):
    """The answer with texts or ids of statements changed, by number."""
    return [(change.get(f"text{i}", t), change.get(f"ids{i}", u)) for i, (t, u) in enumerate(SAID)]


def raw(statements, **more):
    return json.dumps({"statements": [{"text": t, "supporting_source_unit_ids": u} for t, u in statements], **more}, ensure_ascii=False)


KEEP = ["facts", "numbers", "quantity_units", "times", "conditions", "negations", "steps"]
# code, statement, statements, what is asked.
CASES = [
    (None, None, said(), {}),
    (None, None, said(), {"facts": ["약물은 5 mg 투여했다"], "numbers": ["5"], "quantity_units": ["5mg"], "times": ["1. 즉시 기록"], "conditions": ["소아인 경우"], "negations": ["금식하지 않는다"], "steps": ["약물 투여"], "phase": "before"}),
    ("http_response_missing", None, said(), {"received": False}),
    ("http_response_missing", None, said(), {"received": None}),
    ("provider_json", None, said(), {"raw": "{"}),
    ("provider_json", None, said(), {"raw": None}),
    ("controlled_schema", None, said(), {"raw": "null"}),
    ("controlled_schema", None, said(), {"raw": raw(said(), more=1)}),
    ("controlled_schema", None, [], {}),
    ("controlled_schema", None, said(text1=""), {}),
    ("controlled_schema", None, said(text1="a" * 701), {}),
    ("controlled_schema", None, said(ids0=[]), {}),
    ("controlled_schema", None, said(ids0=["u1"] * 5), {}),
    ("controlled_schema", None, said(ids0=["u1", None]), {}),
    ("controlled_schema", None, said(text0=None), {}),
    ("controlled_schema", None, said() * 6, {}),
    ("controlled_schema", None, said(), {"raw": '{"statements": [{"text": "a", "supporting_source_unit_ids": ["u1"]}, {"text": "b"}]}'}),
    ("invalid_evidence_catalog", None, said(), {"units": []}),
    ("invalid_evidence_catalog", None, said(), {"units": [*UNITS, UNITS[0]]}),
    ("duplicate_evidence_id", 0, said(ids0=["u1", "u1"], ids1=["u9"]), {}),
    ("unknown_evidence_id", 1, said(ids1=["u2", "u9"], ids2=["u3", "u3"]), {}),
    ("evaluation_action_kind_changed", 2, said(text2="금식하지 않는다. 관을 제거한다."), {}),
    ("evaluation_action_strength_changed", 1, said(text1="소아인 경우 기록할 수 있다."), {}),
    ("critical_fact_preservation", None, said(), {"facts": ["산소를 올린다"]}),
    ("evidence_coverage", None, said()[:2], {}),
    ("required_coverage:s2", None, said(), {"slots": [(1, "s1", "약물 투여", ["u1"]), (2, "s2", "약물 투여", ["u3"])]}),
    ("unsupported_number_or_unit", 0, said(text0="약물 5 mg을 투여한다. 77"), {}),
    ("critical_number_preservation", None, said(), {"numbers": ["6"]}),
    ("unsupported_number_or_unit", 0, said(text0="약물 5 g을 투여한다."), {}),
    ("critical_unit_preservation", None, said(), {"quantity_units": ["kPa"]}),
    ("critical_time_preservation", None, said(), {"times": ["이틀 뒤"]}),
    ("condition_changed", 0, said(text0="다만 약물 5 mg을 투여한다."), {}),
    ("condition_changed", 1, said(text1="성인인 경우 즉시 기록한다."), {}),
    ("critical_condition_preservation", None, said(), {"conditions": ["임신부인 경우"]}),
    ("negation_changed", 2, said(text2="금식한다."), {}),
    ("critical_negation_preservation", None, said(), {"negations": ["마시지 말 것"]}),
    ("critical_action_preservation", None, said(), {"steps": ["침대 높임"]}),
    ("source_order", None, said()[::-1], {}),
    ("source_order", None, said(ids1=["u2", "u1"], text1="소아인 경우 즉시 기록한다. 5 mg을 투여한다."), {}),
    ("branch_mixing", 0, [(SAID[0][0] + " " + SAID[1][0], ["u1", "u2"]), SAID[2]], {}),
    ("phase_mixing", 1, [SAID[0], (SAID[1][0] + " " + SAID[2][0], ["u2", "u3"])], {}),
    ("phase_scope", None, said(text2="금식하지 않는다. 회복 후"), {"phase": "before"}),
    (None, None, said(text2="금식하지 않는다. 회복 후"), {"phase": "during"}),
]
STAGE = {"http_response_missing": 1, "provider_json": 2, "controlled_schema": 3, "invalid_evidence_catalog": 4, "duplicate_evidence_id": 4, "unknown_evidence_id": 4, "evaluation_action_kind_changed": 5, "evaluation_action_strength_changed": 5,
         "critical_fact_preservation": 6, "evidence_coverage": 7, "required_coverage:s2": 7, "critical_number_preservation": 8, "critical_unit_preservation": 9, "critical_time_preservation": 10, "condition_changed": 11, "critical_condition_preservation": 11,
         "negation_changed": 12, "critical_negation_preservation": 12, "critical_action_preservation": 13, "source_order": 13, "branch_mixing": 14, "phase_mixing": 14, "phase_scope": 15}


def inputs(spark):
    n = [(i, a, s) for i, (_, _, s, a) in enumerate(CASES)]
    cases = [(i, a.get("received", True), a.get("raw", raw(s)), a.get("phase"), *[a.get(k) for k in KEEP]) for i, a, s in n]
    units = [(i, *u) for i, a, _ in n for u in a.get("units", UNITS)]
    slots = [(i, *x) for i, a, _ in n for x in a.get("slots", [(1, "s1", "약물 투여", ["u1"])])]
    return spark.createDataFrame(cases, C), spark.createDataFrame(units, U), spark.createDataFrame(slots, S)


@pytest.fixture(scope="module")
def found(spark):
    return {r["query_id"]: r for r in diagnosis.diagnose(*inputs(spark)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_first_failure(found, i):
    code, statement, said_, _ = CASES[i]
    r = found[i]
    assert (r["error_code"], r["statement"], r["passed"]) == (code, statement, code is None)
    if code is None:
        assert r["statuses"] == ["PASS"] * 16 and r["stage"] is None and r["unit_ids"] is None
        return
    at = STAGE.get(code, r["stage_no"])
    assert r["stage_no"] == at and r["stage"] == list(diagnosis.STAGES)[at - 1] and r["validator"] == diagnosis.STAGES[r["stage"]]
    assert r["statuses"] == ["PASS"] * (at - 1) + ["FAIL"] + ["NOT_RUN"] * (16 - at)
    if statement is not None:
        assert r["unit_ids"] == said_[statement][1]
    elif code.startswith("required_coverage"):
        assert r["unit_ids"] == ["u3"]
    elif at > 4:
        assert r["unit_ids"] == list(dict.fromkeys(u for _, own in said_ for u in own))
    else:
        assert r["unit_ids"] == []


def test_foreign_numbers_and_units_are_two_stages(found):
    of = [found[i]["stage_no"] for i, c in enumerate(CASES) if c[0] == "unsupported_number_or_unit"]
    assert of == [8, 9]


def test_every_code_stands_in_a_case():
    assert set(STAGE) | {"unsupported_number_or_unit", None} == {c[0] for c in CASES}


def test_repeats_clashing_columns_and_nothing(spark):
    cases, units, slots = inputs(spark)
    twice = cases.union(cases).selectExpr("*", "1 AS statements", "2 AS case_no", "3 AS at")
    rows = diagnosis.diagnose(twice, units.selectExpr("*", "1 AS u", "2 AS known"), slots.selectExpr("*", "1 AS n_units")).collect()
    assert len(rows) == 2 * len(CASES)
    assert [r["error_code"] for r in sorted(rows, key=lambda r: r["query_id"])][::2] == [c[0] for c in CASES]
    assert diagnosis.diagnose(cases.limit(0), units.limit(0), slots.limit(0)).collect() == []


def test_pieces(spark):
    row = spark.sql("SELECT '1) 약물을 5 mg 투여했다' AS a, '위 관 A1' AS b, '' AS c").select(*[diagnosis.pieces(diagnosis.F.col(k)).alias(k) for k in "abc"]).first()
    assert (sorted(row["a"]), sorted(row["b"]), row["c"]) == (["5", "mg", "약물", "투여"], ["a1", "관", "위", "위관"], [])
