"""Contracts, gold, frozen rankings, queues and ladders: each rule from a sound case by one change."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillspark.operators import release

C = "case_id int, expected_behavior string, expected_intent string, intent string, domain string, route_status string, pre_supported boolean, post_supported boolean, structured_supported boolean, n_selected int, n_structured int, provider_calls int, vision_calls int"
SOUND = {
    "answer": dict(expected_behavior="answer", expected_intent="fact", intent="fact", domain="hospital", route_status="ready", pre_supported=True, post_supported=True, structured_supported=False, n_selected=1, n_structured=0, provider_calls=0, vision_calls=0),
    "abstain": dict(expected_behavior="abstain", domain="unknown"),
    "pending_human_review": dict(expected_behavior="pending_human_review", route_status="pending_image_review"),
}
CONTRACT = [
    ("answer", {}, []),
    ("abstain", {}, []),
    ("pending_human_review", {}, []),
    ("answer", {"provider_calls": 1, "vision_calls": 2}, ["unexpected_provider_call", "unexpected_vision_call"]),
    ("abstain", {"domain": "hospital", "n_selected": 1}, ["out_of_scope_domain_mismatch", "unsafe_out_of_scope_admission"]),
    ("abstain", {"post_supported": True}, ["unsafe_out_of_scope_admission"]),
    ("pending_human_review", {"route_status": None, "n_selected": 1}, ["image_review_gate_missing", "unapproved_image_evidence_selected"]),
    ("answer", {"domain": None, "intent": "summary"}, ["hospital_domain_mismatch", "intent_mismatch"]),
    ("answer", {"expected_intent": "monitoring", "intent": "preparation"}, []),
    ("answer", {"expected_intent": "synthesis", "intent": "synthesis"}, []),
    ("answer", {"expected_intent": "synthesis", "intent": "fact"}, ["intent_mismatch"]),
    ("answer", {"expected_intent": None}, ["intent_mismatch"]),
    ("answer", {"pre_supported": False, "post_supported": None, "n_selected": 0}, ["pre_budget_not_supported", "post_budget_not_supported", "missing_selected_evidence"]),
    ("answer", {"pre_supported": False, "post_supported": False, "n_selected": 0, "n_structured": 1, "structured_supported": True}, []),
    ("answer", {"expected_behavior": "later"}, ["unknown_expected_behavior"]),
    ("answer", {"expected_behavior": None}, ["unknown_expected_behavior"]),
]


def test_contract(spark):
    names = [c.split()[0] for c in C.split(", ")]
    rows = [tuple({"case_id": i, **SOUND[kind], **change}.get(n) for n in names) for i, (kind, change, _) in enumerate(CONTRACT)]
    got = {r["case_id"]: (r["passed"], r["reasons"]) for r in release.uat_contract(spark.createDataFrame(rows, C)).collect()}
    assert got == {i: (not reasons, reasons) for i, (_, _, reasons) in enumerate(CONTRACT)}


def test_every_kind_stands_for_what_it_may(spark):
    kinds = sorted({k for v in release.COMPATIBLE.values() for k in v} | set(release.COMPATIBLE) | {"other"})
    rows = list(itertools.product(kinds, kinds))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", release.compatible_intent(F.col("a"), F.col("b")).alias("ok")).collect()
    assert all(r["ok"] == (r["b"] in release.COMPATIBLE.get(r["a"], {r["a"]})) for r in got) and len(got) == len(rows)


def test_gold_match(spark):
    rows = [
        (1, False, None, True, ["a", "b"], ["b"]), (2, False, None, True, ["a"], ["c"]), (3, False, None, True, [], ["c"]), (4, False, True, True, None, None),
        (5, True, True, True, ["a"], ["c"]), (6, True, None, True, None, ["c"]), (7, False, None, False, ["a"], ["a"]), (8, None, None, None, ["a"], [None]),
    ]
    got = release.gold_match(spark.createDataFrame(rows, "case_id int, expected_abstain boolean, safely_abstained boolean, eligible boolean, gold_ids array<string>, selected_ids array<string>")).orderBy("case_id").collect()
    assert [(r["candidate_match"], r["aggregate_match"]) for r in got] == [(True, True), (False, False), (None, None), (None, None), (True, True), (False, False), (True, None), (False, None)]


CASES, WANT, HIT = "query_id int, seconds double", "query_id int, name string, page int, quote string", "query_id int, name string, page int, text string"


def test_local_evaluation(spark):
    cases = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], CASES)
    expected = spark.createDataFrame([(1, "a", None, None), (1, "a", 2, "two  words"), (2, "a", 3, None), (2, "b", None, None), (3, "a", None, "absent"), (3, "a", None, "absent"), (5, "a", 1, ""), (9, "a", None, None)], WANT)
    hits = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, " has two\nwords "), (2, "a", 1, "x"), (2, "b", None, None), (3, "a", 1, None), (5, "a", None, "x"), (6, "a", 1, "x")], HIT)
    rows = release.local_evaluation(cases, expected, hits)
    assert sorted(tuple(r) for r in rows.drop("seconds").collect()) == [(1, 2, 2, True, 2), (2, 2, 1, False, 2), (3, 2, 0, False, 1), (4, 0, 0, True, 0), (5, 1, 0, False, 1), (6, 0, 0, False, 1)]
    assert tuple(release.local_summary(rows).first()) == (6, 2, 3 / 7, 3.5, 5.75)
    assert tuple(release.local_summary(rows.limit(0)).first()) == (0, 0, None, None, None)


def test_fixed_rankings(spark):
    cases = spark.createDataFrame([(1, "table", True), (2, None, None), (3, "mixed", False), (4, "text", True)], "query_id int, evidence_type string, eligible boolean")
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (4, 40)], "query_id int, chunk_id int")
    good = [(1, 1, 10), (1, 2, 99), (2, 1, 98), (2, 2, 20), (3, 1, 97), (4, 1, 96), (4, 11, 40)]
    given = {"good": good, "short": good[:5], "foreign": [*good, (5, 1, 1)], "twice": [*good, (1, 3, 10)], "late": [*good, (1, 12, 10)]}
    ranked = spark.createDataFrame([(k, *r) for k, rows in given.items() for r in rows], "strategy string, query_id int, rank int, chunk_id int")
    got = {(r["strategy"], r["subset"]): r for r in release.fixed_rankings(cases, gold, ranked).collect()}
    assert {k[0]: r["problem"] for k, r in got.items()} == {"good": None, "late": None, "short": "case_coverage_drift", "foreign": "case_coverage_drift", "twice": "invalid_ranked_ids"}
    every, tables = got["good", "all"], got["late", "table"]
    assert (every["cases"], every["mrr"], every["hit_at_1"], every["hit_at_10"]) == (3, pytest.approx(0.5), pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert (tables["cases"], tables["mrr"], tables["recall_at_5"], tables["precision_at_5"]) == (1, 1.0, 0.5, 0.5)
    assert got["short", "all"]["cases"] == 0 and got["short", "all"]["mrr"] is None and len(got) == 10


W = "case_id int, evidence_type string, note string, image_required boolean, table_required boolean, n_primary int, n_acceptable int, n_chunks int, n_rows int"
FOUND, NONE = "candidate_present_not_final_gold", "not_found_in_current_candidates"
WAITING = [
    (("image_pending", "모호", None, True, 1, 1, 1, 1), "image_human_review_required", FOUND),
    (("table", None, True, None, 0, 0, 0, 0), "image_human_review_required", NONE),
    (("table", "AmBiguous", None, None, 0, 0, 0, 1), "ambiguous_question", FOUND),
    (("text", "질문이 모호함", None, None, 0, 0, 0, None), "ambiguous_question", NONE),
    (("table", None, None, None, 1, 0, 1, 0), "table_structure_or_mapping", FOUND),
    (("text", "", False, True, 0, 0, 0, 0), "table_structure_or_mapping", NONE),
    (("text", "", False, False, 1, 0, 0, 0), "retrieval_miss", FOUND),
    ((None, None, None, None, None, None, None, None), "retrieval_miss", NONE),
    (("text", "x", None, None, 0, 2, 3, 0), "insufficient_candidate_evidence", FOUND),
    (("text", "x", None, None, 1, 0, 3, 0), "other", FOUND),
]


def test_deferred(spark):
    got = release.deferred(spark.createDataFrame([(i, *r) for i, (r, _, _) in enumerate(WAITING)], W).withColumn("category", F.lit("own"))).orderBy("case_id").collect()
    assert [(r["category"], r["evidence_status"]) for r in got] == [w[1:] for w in WAITING]
    assert all(r["layer"] == release.LAYERS[r["category"]] for r in got) and {r["category"] for r in got} == set(release.LAYERS)


def test_ladders_over_all_states(spark):
    flags = ("core_passed", "image_approved", "image_excluded", "live_completed", "provider_disabled", "transfer_approved", "provider_verified", "critical_regression")
    states = list(itertools.product((True, False), repeat=len(flags)))
    rows = [(i, *[None if i % 3 == 0 and not v else v for v in s]) for i, s in enumerate(states)]  # null is false
    got = release.ladders(spark.createDataFrame(rows, "k int, " + ", ".join(f"{f} boolean" for f in flags)), "k").collect()
    assert len(got) == 256
    names = {(True, True): "READY", (False, True): "READY_EXCEPT_IMAGE_HUMAN_REVIEW", (True, False): "READY_EXCEPT_LIVE_RAGAS", (False, False): "READY_EXCEPT_IMAGE_AND_LIVE_RAGAS"}
    for r in got:
        s = dict(zip(flags, states[r["k"]]))
        image, live = s["image_approved"] or s["image_excluded"], s["live_completed"] or s["provider_disabled"]
        assert r["release_status"] == (names[image, live] if s["core_passed"] else "NOT_READY")
        assert r["final_status"] == (names[s["image_approved"], s["transfer_approved"]] if s["core_passed"] else "NOT_READY")
        assert r["blockers"] == [b for b, open_ in ((release.CORE, not s["core_passed"]), (release.IMAGE, not image), (release.LIVE, not live)) if open_]
        assert r["provider_status"].startswith("READY" if s["transfer_approved"] else "BLOCKED")
        assert r["version"] == ("v0.9" if s["critical_regression"] or not s["core_passed"] else "v1.0" if s["provider_verified"] and s["image_approved"] else "v1.0-rc1")


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert release.uat_contract(none(C)).collect() == [] and release.deferred(none(W)).collect() == []
    assert release.local_evaluation(none(CASES), none(WANT), none(HIT)).collect() == []
    assert release.fixed_rankings(none("query_id int, evidence_type string, eligible boolean"), none("query_id int, chunk_id int"), none("strategy string, query_id int, rank int, chunk_id int")).collect() == []
