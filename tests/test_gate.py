"""The gate of sufficiency: each reason from sound evidence by one change."""

import pytest

from quillspark.operators import gate

Q = "query_id long, kind string, clarify boolean, domain string, scoped boolean, text string, branches array<string>, entities array<string>, documents array<long>, least int"
E = "query_id long, doc_id long, group_key string, branch string, position int, idx int, text string, section string, seed boolean, complete boolean, procedural boolean, headed boolean"
ASPECTS = [("목적", "위해|목적"), ("after", "afterwards")]


def rows(qid, **change):
    base = [dict(doc_id=1, group_key="a", branch="common", text="VRE 소독한다", seed=True), dict(doc_id=1, group_key="a", branch="common", text="기록한다", seed=False), dict(doc_id=2, group_key="b", branch="adult", text="성인은 쉰다", seed=False)]
    return [(qid, r["doc_id"], r["group_key"], r["branch"], i, change.get("idx", [0, 1, 2])[i], change.get("text", [x["text"] for x in base])[i], change.get("section", ""), r["seed"] and change.get("seed", True), change.get("complete", True), change.get("procedural", True), change.get("headed", False)) for i, r in enumerate(base)][: change.get("n", 3)]


def ask(qid, kind="procedure", clarify=False, domain="hospital", scoped=False, text="", branches=(), entities=(), documents=(), least=1):
    return (qid, kind, clarify, domain, scoped, text, list(branches), list(entities), list(documents), least)


CASES = [
    ("supported", {}, {}),
    ("supported", {"domain": "unknown", "scoped": True}, {}),
    ("domain_or_clarification", {"domain": "unknown"}, {}),
    ("domain_or_clarification", {"domain": "out_of_scope", "scoped": True}, {}),
    ("domain_or_clarification", {"clarify": True}, {}),
    ("no_topic_evidence", {}, {"seed": False}),
    ("no_topic_evidence", {}, {"n": 0}),
    ("supported", {"branches": ["adult"]}, {}),
    ("missing_requested_branch", {"branches": ["pediatric"]}, {}),
    ("missing_comparison_branch", {"branches": ["adult", "pediatric"], "kind": "comparison"}, {}),
    ("supported", {"branches": ["adult", "pediatric"]}, {}),
    ("incomplete_semantic_block", {}, {"complete": False}),
    ("missing_procedure_unit", {}, {"procedural": False}),
    ("supported", {"kind": "summary"}, {"procedural": False, "idx": [1, 0, 2]}),
    ("procedure_source_order", {}, {"idx": [1, 0, 2]}),
    ("duplicate_evidence", {}, {"text": ["한 번", " 한  번", "쉰다"]}),
    ("missing_requested_aspect", {"text": "목적은"}, {}),
    ("missing_requested_aspect", {"text": "목적은", "kind": "purpose"}, {"section": "목적"}),
    ("supported", {"text": "목적은", "kind": "purpose"}, {"section": "목적", "headed": True}),
    ("supported", {"text": "목적은 / 추가 질문: 기록"}, {}),
    ("supported", {"entities": ["vre"], "text": "소독"}, {}),
    ("missing_entity", {"entities": ["foley"]}, {}),
    ("missing_action", {"entities": ["vre"], "text": "교체"}, {}),
    ("supported", {"text": "교체"}, {}),
    ("missing_document", {"least": 3}, {}),
    ("missing_document", {"documents": [1, 9]}, {}),
]


@pytest.fixture(scope="module")
def reasons(spark):
    n = range(len(CASES))
    got = gate.sufficiency(spark.createDataFrame([ask(i, **CASES[i][1]) for i in n], Q), spark.createDataFrame([r for i in n for r in rows(i, **CASES[i][2])], E), ASPECTS)
    return {r["query_id"]: (r["reason"], r["sufficient"]) for r in got.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reason(reasons, i):
    assert reasons[i] == (CASES[i][0], CASES[i][0] == "supported")


def test_nothing_at_all_and_nulls(spark):
    assert gate.sufficiency(spark.createDataFrame([], Q), spark.createDataFrame([], E), ASPECTS).collect() == []
    asked = spark.createDataFrame([ask(1, text=None, kind="summary")], Q)
    assert gate.sufficiency(asked, spark.createDataFrame([r[:6] + (None, None) + r[8:] for r in rows(1)], E), ASPECTS).first()["reason"] == "supported"
