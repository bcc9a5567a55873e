"""Validation of selections: each reason from one sound selection by one change."""

import json

import pytest

from quillspark.operators import selection as S

PLANS = "query_id long, procedure boolean, broad boolean, actions array<string>, covered boolean, covered_groups array<string>, covered_branches array<string>, most int"
SLOTS = "query_id long, slot string, slot_no int, group_key string, branch string, required boolean, allowed array<string>"
UNITS = "query_id long, unit string, ord int, group_key string, branch string, required boolean, selectable boolean, phase string, families array<string>, text string"

SOUND = {"g1": ["u1", "u2", "u3", "u4"], "g2": ["u5", "u6"], "g3": []}


def units(qid):
    return [
        (qid, "u1", 1, "a", "common", True, True, "before", ["check", "record"], "check and record"),
        (qid, "u2", 2, "a", "common", True, True, "before", ["check"], "check again"),
        (qid, "u3", 3, "a", "common", True, True, "after", ["report"], "report it"),
        (qid, "u4", 4, "a", "common", True, True, "after", ["clean"], "clean up"),
        (qid, "u5", 5, "b", "adult", True, True, "before", ["check"], "adults: check"),
        (qid, "u6", 6, "b", "adult", True, True, "unspecified", [], "adults: rest"),
        (qid, "u7", 7, "c", "common", False, True, "unspecified", [], "an option"),
        (qid, "u8", 8, "c", "common", False, False, "unspecified", [], "a heading"),
    ]


def slots(qid):
    return [(qid, "g1", 1, "a", "common", True, ["u1", "u2", "u3", "u4"]), (qid, "g2", 2, "b", "adult", True, ["u5", "u6"]), (qid, "g3", 3, "c", "common", False, ["u7"])]


def plan(qid, procedure=True, broad=True, actions=("check",), covered=True, groups=("a", "b"), branches=("adult",), most=16):
    return (qid, procedure, broad, list(actions), covered, list(groups), list(branches), most)


def said(**change):
    return json.dumps({"group_selections": SOUND | change})


G = "group_selections"
CASES = [
    ("", said(), {}),
    ("", said(g3=["u7"]), {}),
    ("selection_schema", None, {}),
    ("selection_schema", "{", {}),
    ("selection_schema", "[]", {}),
    ("selection_schema", json.dumps({G: SOUND, "more": 1}), {}),
    ("selection_schema", json.dumps({G: {"g1": ["u1"]}}), {}),
    ("selection_schema", said(g4=[]), {}),
    ("selection_schema", said(g1=[1, 2]), {}),
    ("selection_schema", said(g1=["u1", 2]), {}),
    ("selection_schema", said(g1=["u1", None]), {}),
    ("selection_schema", said(g1="u1"), {}),
    ("selection_schema", said(g1=None), {}),
    ("selection_empty", json.dumps({G: {"g1": [], "g2": [], "g3": []}}), {}),
    ("selection_limit", said(), {"most": 5}),
    ("selection_duplicate_id", said(g1=["u1", "u1", "u3", "u4"]), {}),
    ("selection_unknown_id", said(g1=["u1", "x"]), {}),
    ("selection_non_selectable", said(g3=["u8"]), {}),
    ("selection_wrong_group", said(g3=["u7"], g1=["u1", "u3", "u4", "u6"], g2=["u5"]), {}),
    ("selection_source_order", said(g1=["u2", "u1", "u3", "u4"]), {}),
    ("selection_missing_group", said(g1=[]), {}),
    ("selection_branch", said(g2=[]), {}),
    ("selection_contract_drift", said(), {"groups": ("b", "a")}),
    ("selection_contract_drift", said(), {"branches": ()}),
    ("selection_contract_drift", said(), {"covered": False}),
    ("selection_contract_drift", said(), {"procedure": False, "covered": False}),
    ("selection_requirement_capacity", said(g1=["u1"], g2=["u5"]), {"most": 3}),
    ("selection_missing_phase", said(g1=["u1", "u2"]), {}),
    ("selection_missing_phase_action", said(g1=["u2", "u3", "u4"]), {}),
    ("selection_insufficient_action_diversity", said(g1=["u1", "u3"]), {}),
    ("", said(g1=["u1", "u3"]), {"broad": False}),
    ("selection_missing_action", said(), {"actions": ("check", "sterilise")}),
]


@pytest.fixture(scope="module")
def reasons(spark):
    n = range(len(CASES))
    got = S.validate(
        spark.createDataFrame([plan(i, **CASES[i][2]) for i in n], PLANS),
        spark.createDataFrame([s for i in n for s in slots(i)], SLOTS),
        spark.createDataFrame([u for i in n for u in units(i)], UNITS),
        spark.createDataFrame([(i, CASES[i][1]) for i in n], "query_id long, raw string"),
    )
    return {r["query_id"]: r["reason"] for r in got.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reason(reasons, i):
    assert reasons[i] == CASES[i][0]


def test_order_from_slot_to_slot_and_drift_of_units_and_nothing_at_all(spark):
    # Slots against the order of the source (0), a selectable unit that no slot knows (1), a plan without slots or units (2).
    turned = [(0, "g1", 1, "b", "adult", True, ["u5", "u6"]), (0, "g2", 2, "a", "common", True, ["u1", "u2", "u3", "u4"]), (0, "g3", 3, "c", "common", False, ["u7"])]
    plans = spark.createDataFrame([plan(0, groups=("b", "a")), plan(1), plan(2)], PLANS)
    more = [(1, "u9", 9, "d", "common", False, True, "unspecified", [], "further")]
    answers = [(0, json.dumps({G: {"g1": ["u5"], "g2": ["u1", "u3", "u4"], "g3": []}})), (1, said()), (2, json.dumps({G: {}}))]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = S.validate(plans, made(turned + slots(1), SLOTS), made(units(0) + units(1) + more, UNITS), made(answers, "query_id long, raw string"))
    assert {r["query_id"]: r["reason"] for r in got.collect()} == {0: "selection_source_order", 1: "selection_contract_drift", 2: "selection_schema"}
    assert S.validate(made([], PLANS), made([], SLOTS), made([], UNITS), made([], "query_id long, raw string")).collect() == []


FACETS = [
    ("phase", "common/before", ["u1", "u2"]),
    ("phase_action", "common/before/check", ["u1", "u2"]),
    ("phase_action", "common/before/record", ["u1"]),
    ("group", "a", ["u1", "u2", "u3", "u4"]),
    ("action_family", "check", ["u1", "u2", "u5"]),
    ("action_family", "record", ["u1"]),
    ("query_action", "check", ["u1", "u2", "u5"]),
    ("phase", "common/after", ["u3", "u4"]),
    ("phase_action", "common/after/report", ["u3"]),
    ("action_family", "report", ["u3"]),
    ("action_family", "clean", ["u4"]),
    ("phase", "adult/before", ["u5"]),
    ("phase_action", "adult/before/check", ["u5"]),
    ("group", "b", ["u5", "u6"]),
    ("branch", "adult", ["u5", "u6"]),
]


def test_facets_of_a_broad_procedure(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    plans = made([plan(0), plan(1, broad=False), plan(2, actions=("sterilise",))], PLANS)
    rows = S.facets(plans, made(units(0) + units(1) + units(2), UNITS)).orderBy("query_id", "slot_no").collect()
    got = [(r["kind"], r["key"], r["eligible"]) for r in rows if r["query_id"] == 0]
    assert sorted(got) == sorted(FACETS) and [r["slot"] for r in rows if r["query_id"] == 0] == [f"f{i + 1}" for i in range(15)]
    firsts = [e[0] for _, _, e in got]
    assert firsts == sorted(firsts) and got[0][0] == "phase_action" and got[2][0] == "phase" and got[3][0] == "group" and got[6][0] == "query_action"
    last = [r for r in rows if r["query_id"] == 2][-1]
    assert (last["kind"], last["eligible"]) == ("query_action", []) and not [r for r in rows if r["query_id"] == 1]


def test_reasons_of_facet_answers(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    n = 12
    plans = made([plan(i, broad=i != 7, most=3 if i == 6 else 16) for i in range(n)], PLANS)
    catalog = made([u for i in range(n) for u in units(i)], UNITS)
    rows = [r.asDict() for r in S.facets(plans, catalog).collect()]
    slots = {i: sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["slot_no"]) for i in range(n)}
    say = {i: {r["slot"]: r["eligible"][0] for r in slots[i]} for i in range(n)}
    say[1].pop("f3")
    say[2]["f2"] = 5
    say[3]["f1"] = "u7"
    say[4] = {r["slot"]: r["eligible"][-1] for r in slots[4]}
    for k, r in enumerate(slots[5]):  # the contract lost a unit
        r["eligible"] = [u for u in r["eligible"] if u != "u2"]
    for r, unit in ((slots[8][0], "zz"), (slots[9][0], "u8")):  # the contract knows a unit that the catalogue doesn't, or that is closed
        r["eligible"] = r["eligible"] + [unit]
        say[r["query_id"]][r["slot"]] = unit
    say[10]["f1"], say[10]["f2"] = "u7", None  # the first fault in the order of slots is told
    want = {0: "", 1: "selection_schema", 2: "selection_schema", 3: "selection_wrong_facet", 4: "selection_source_order", 5: "selection_contract_drift", 6: "selection_limit", 7: "selection_empty", 8: "selection_unknown_id", 9: "selection_non_selectable", 10: "selection_wrong_facet", 11: "selection_schema"}
    raw = [(i, json.dumps({"facet_selections": say[i]})) for i in range(n - 1)] + [(11, json.dumps({"facet_selections": say[11], "more": 0}))]
    told = made([(r["query_id"], r["slot"], r["slot_no"], r["kind"], r["key"], r["eligible"]) for i in range(n) for r in slots[i]], "query_id long, slot string, slot_no int, kind string, key string, eligible array<string>")
    assert {r["query_id"]: r["reason"] for r in S.validate_facets(plans, told, catalog, made(raw, "query_id long, raw string")).collect()} == want
    empty = made([], "query_id long, slot string, slot_no int, kind string, key string, eligible array<string>")
    assert S.validate_facets(made([], PLANS), empty, made([], UNITS), made([], "query_id long, raw string")).collect() == []
