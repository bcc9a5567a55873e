"""Cases, units and slots of a diagnosis are exchanged by case alone, each once."""

import re

from quillspark.operators import diagnosis

CASE = "query_id long, received boolean, raw string, requested_phase string, facts array<string>, numbers array<string>, quantity_units array<string>, times array<string>, conditions array<string>, negations array<string>, steps array<string>"
UNIT = "query_id long, unit_id string, position int, branch string, phase string, text string"
RAW = '{"statements":[{"text":"Check the label.","supporting_source_unit_ids":["a"]}]}'


def given(spark):
    case = lambda i: (i, True, RAW, "all", None, None, None, None, None, None, None)
    cases = spark.createDataFrame([case(1), case(1), case(2), case(3), case(None)], CASE)
    units = spark.createDataFrame([(1, "a", 0, "", "", "Check the label."), (2, "a", 1, "adult", "", "Late."), (2, "a", 0, "", "", "Check the label."), (3, "b", 0, "", "", None), (None, "a", 0, "", "", "x")], UNIT)
    slots = spark.createDataFrame([], "query_id long, slot_no int, slot_id string, requirement string, unit_ids array<string>")
    return cases, units, slots


def test_exchanges(spark):
    plan = diagnosis.diagnose(*given(spark))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) <= 3 and all(re.fullmatch(r"query_id#\d+L, \d+", k) for k in keys)


def test_rows(spark):
    rows = sorted((r.query_id or 0, r.stage_no or 0, r.error_code or "") for r in diagnosis.diagnose(*given(spark)).collect())
    bad = "invalid_evidence_catalog"
    assert rows == [(0, 4, bad), (1, 0, ""), (1, 0, ""), (2, 4, bad), (3, 4, "unknown_evidence_id")]
