"""The rules of a relevant body: each from a sound hit by one change."""

from quillspark.operators import relevance

R = "n int, q string, kind string, entities array<string>, words array<string>, item string, phase string, action string, text string, section string, name string, title string, substantive boolean, headed boolean"
NAMES = [c.split()[0] for c in R.split(", ")]
BASE = dict(q="욕창 주의사항", kind="cautions", words=["욕창"], text="욕창 부위를 관찰한다.", section="", name="", title="", substantive=True, headed=False)
CASES = [
    (True, {}),
    (False, {"substantive": None}),
    (False, {"words": []}),
    (False, {"words": None}),
    (False, {"text": "부위를 관찰한다."}),
    (True, {"text": "부위를 관찰한다.", "title": "욕 창 지침"}),
    (True, {"text": "부위를 관찰한다.", "section": "욕창"}),
    (False, {"text": "욕창 부위를 씻는다."}),
    (True, {"text": "씻는다.", "headed": True}),
    (True, {"kind": "materials", "text": "욕창 물품을 둔다"}),
    (True, {"kind": "summary", "text": "씻는다.", "name": "욕창.pdf"}),
    (False, {"kind": "fact", "q": "욕창", "text": "씻는다.", "name": "욕창.pdf"}),
    (True, {"kind": "fact", "q": "욕창 회복", "text": "회복을 본다", "name": "욕창.pdf"}),
    (False, {"kind": "fact", "q": "욕창 회복", "text": "씻는다", "name": "욕창.pdf"}),
    (False, {"kind": "comparison", "q": "욕창 몇 분", "text": "욕창을 10분 본다"}),
    (True, {"kind": "comparison", "q": "욕창 몇 분", "text": "욕창을 10분 간격으로 본다"}),
    (True, {"kind": "comparison", "q": "욕창 몇 분 / 추가 질문: 차이", "text": "욕창을 본다"}),
    (False, {"kind": "procedure", "text": "씻는다", "title": "욕창"}),
    (False, {"q": "욕창 동의서 주의"}),
    (False, {"q": "욕창 병실 주의", "text": "욕창 병실에 주의"}),
    (True, {"q": "욕창 병실 주의", "text": "욕창 병실에서 관찰"}),
    (False, {"item": "pulse"}),
    (True, {"item": "pulse", "text": "욕창 주의, hr 80"}),
    (False, {"item": "pulse", "text": "욕창 주의, three 80"}),
    (False, {"q": "욕창 SpO2", "text": "욕창 주의"}),
    (True, {"q": "욕창 SpO2", "item": "pulse", "text": "욕창 주의 맥박"}),
    (False, {"action": "check", "text": "욕창 주의"}),
    (True, {"action": "check", "text": "욕창 감시"}),
    (False, {"item": "pulse", "phase": "during", "text": "욕창 주의 맥박"}),
    (True, {"item": "pulse", "phase": "during", "text": "시술 중 욕창 주의 맥박"}),
    (False, {"q": "VRE 욕창 주의"}),
    (True, {"q": "VRE 욕창 주의", "entities": ["vre"], "words": None, "section": "VRE"}),
    (False, {"q": "욕창 주의", "entities": ["vre"]}),
    (False, {"text": None}),
    (False, {"kind": None, "text": None}),
]


def test_relevant(spark):
    rows = [tuple({"n": i, **BASE, **change}.get(k) for k in NAMES) for i, (_, change) in enumerate(CASES)]
    got = {r["n"]: r["ok"] for r in spark.createDataFrame(rows, R).select("n", relevance.relevant().alias("ok")).collect()}
    assert got == {i: ok for i, (ok, _) in enumerate(CASES)}
    assert spark.createDataFrame([], R).select(relevance.relevant()).collect() == []
