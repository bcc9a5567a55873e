"""Operators that SQL doesn't express, against models in Python and examples worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import terms
from quillspark.functions import text as X
from quillspark.functions.unicode import close_match
from quillspark.operators import bm25, chunks, context, evidence, fusion, search, spelling
from quillspark.plans import questions as P
from quillspark.queries import evidence as EQ
from quillspark.queries import hybrid as HQ
from quillspark.queries import plan as PQ
from quillspark.queries import text as TQ
from quillspark.streaming import quota

DIR = "/root/testdata/sf0.001"


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "q string").select(function(F.col("q")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("VRE 격리", ["vre"]), ("반코마이신 내성 장알균 확인", ["vre"]), ("반코마이신내성장알균과 반코마이신 투여", ["vre", "vancomycin"]), ("foley catheter", ["foley"]), ("PCNA test", []), ("신루관 세척과 흉강천자", ["pcn", "thoracentesis"]), ("", [])],
)
def test_anchors_blank_what_they_match(spark, text, want):
    assert sorted(one(spark, text, X.anchors)) == sorted(want)


@pytest.mark.parametrize(("text", "want"), [("수혈은 foley", ["수혈", "ko:수혈", "ko:혈은", "foley", "entity:foley"]), ("A-1 b2", ["a-1", "b2"]), ("은", []), ("은은", ["은", "ko:은은"]), ("을를", ["을", "ko:을를"])])
def test_lexical_tokens(spark, text, want):
    assert one(spark, text, X.lexical_tokens) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("시술 전 확인", ["before"]), ("수혈 중 관찰", ["during"]), ("사전 준비와 이후 관리", ["before", "after"]), ("회복 시 관찰", []), ("투약 시 주의", ["during"]), ("안전 관리", []), ("수술하기 전", ["before"]), ("전·후 비교", ["after"])],
)
def test_temporal_phases(spark, text, want):
    assert one(spark, text, X.temporal_phases) == want


def test_term_match_knows_words_from_parts(spark):
    df = spark.createDataFrame([("cre", "CRE isolation"), ("cre", "increase"), ("신루관 세척", "신 루관세척 절차"), ("pcn", "pcn-1")], "w string, t string")
    assert [r["x"] for r in df.select(X.term_matches(F.col("w"), F.col("t")).alias("x")).collect()] == [True, False, True, True]


@pytest.mark.parametrize(("q", "kind"), [("수혈과 투약의 차이", "comparison"), ("준비물은", "materials"), ("수혈 전에 확인할 항목", "preparation"), ("해제 기준", "release"), ("어떻게 진행해", "procedure"), ("욕창 알려줘", "summary"), ("용량은", "fact")])
def test_classify_takes_the_first_rule(spark, q, kind):
    assert one(spark, q, P.classify) == kind


def test_follow_up_merge(spark):
    rows = [("그럼 준비물은", "VRE 격리 절차"), ("CRE 격리", "VRE 격리 절차"), ("준비물", ""), ("끝", "가" * 200 + P.MORE + "나" * 200)]
    df = spark.createDataFrame(rows, "q string, p string").select(P.merged_question(F.col("q"), F.col("p"), F.lit(True)).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got == ["VRE 격리 절차" + P.MORE + "그럼 준비물은", "CRE 격리", "준비물", "가" * 140 + P.MORE + "나" * 160 + P.MORE + "끝"]


def test_canonical_topic_needs_one(spark):
    topics = spark.createDataFrame([("수혈간호",), ("수혈치료",), ("격리",)], "topic string")
    asked = spark.createDataFrame([(1, "격리 해제 기준"), (2, "수혈 목적"), (3, "낙상")], "id long, q string")
    assert [tuple(r) for r in P.canonical_topics(asked, topics).collect()] == [(1, "격리")]


def test_semantic_blocks(spark):
    page = "1. 준비\n손을 씻는다.\n\n약품 | 용량\n\n목적\n막는다.\n\n끝"
    got = [(r["ordinal"], r["section"], r["text"]) for r in chunks.semantic_blocks(spark.createDataFrame([(1, page)], "doc_id long, text string")).orderBy("ordinal").collect()]
    assert got == [(1, "1. 준비", "1. 준비\n손을 씻는다."), (2, "1. 준비", "약품 | 용량"), (3, "목적", "목적\n막는다."), (4, "목적", "끝")]


def test_packing_folds_match_a_model(spark):
    rnd = random.Random(1)
    rows = [(q, i, f"g{i}", rnd.randint(1, 12)) for q in range(20) for i in range(rnd.randint(1, 8))]
    got = {r["q"]: r["taken"] for r in context.packed(spark.createDataFrame(rows, "q long, position int, name string, size int"), "q", 15).collect()}
    for q in range(20):
        used, taken = 0, []
        for _, i, name, size in sorted(r for r in rows if r[0] == q):
            if used + size <= 15:
                used, taken = used + size, [*taken, name]
            elif not taken:
                break
        assert got[q] == ",".join(taken)


def test_quota_admission_matches_a_model(spark):
    rnd = random.Random(2)
    rows = [(u, i, i * 7_000_000 + rnd.randint(0, 6_999_999), float(rnd.randint(1, 60))) for u in range(4) for i in range(60)]
    got = {(r["user"], r["event_id"]): r["admitted"] for r in quota.admitted(spark.createDataFrame(rows, "user long, event_id long, at long, tokens double"), "user", 25, 120.0).collect()}
    for u in range(4):
        live = []
        for _, i, at, n in sorted((r for r in rows if r[0] == u), key=lambda r: r[2]):
            ok = len(live) < 25 and sum(t for a, t in live if a > at - 60_000_000) + n <= 120
            assert got[u, i] == ok
            live += [(at, n)] * ok


def test_quota_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    run = quota.stream_to_memory(spark, str(tmp_path / "in"), events.schema, "quota_minutes")
    run.awaitTermination(120)
    key = ["user_id", "minute", "calls"]
    assert sorted(map(tuple, spark.table("quota_minutes").select(key).collect())) == sorted(map(tuple, quota.by_minute(events).select(key).collect()))


def test_answer_validation_reasons(spark):
    got = {r["statement_no"]: r["reason"] for r in EQ.v01(spark, DIR).collect()}
    assert got == {1: "", 2: "number", 3: "unit", 4: "citation", 5: "", 6: "unsupported action", 7: "markup", 8: "unsupported sentence", 9: "citation"}
    assert {r["id"]: r["unsupported"] for r in EQ.v04(spark, DIR).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_conflicts_and_order(spark):
    rows = [(1, 0, "투여량은 하루 5 mg으로 정한다고 적혀 있다."), (2, 0, "투여량은 하루 7 mg으로 정한다고 적혀 있다."), (3, 0, "투여량은 하루 5 mg으로 정한다고 적혀 있다.")]
    got = evidence.conflicts(spark.createDataFrame(rows, "doc_id long, idx int, text string")).collect()
    assert [(r["doc_a"], r["doc_b"]) for r in got] == [(1, 2)]


def test_temporal_tiers_and_cases(spark):
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["tier"]) for r in HQ.r06(spark, DIR).collect())
    assert got == [(1, 1, 11, "match"), (1, 2, 13, "neutral"), (1, 3, 12, "mismatch"), (1, 4, 14, "non_positive"), (2, 1, 22, "inactive"), (2, 2, 21, "inactive")]
    assert all(r["passed"] for r in HQ.m28(spark, DIR).collect())


def test_rrf_bounds_and_row_order(spark):
    rows = [(q, c, r) for q in range(3) for r, c in enumerate(random.Random(q).sample(range(20), 10), 1)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")
    a = fusion.rrf([df, df]).collect()
    b = fusion.rrf([df.orderBy(F.rand(1)), df.repartition(5)]).collect()
    assert sorted(a) == sorted(b) and max(r["score"] for r in a) <= 2 / 61 + 1e-9


def test_bm25_on_empty_and_null_texts(spark):
    docs = bm25.tokenized(spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta")], "id long, t string"), "id", F.col("t"))
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None)], "id long, q string")
    assert [(r["query_id"], r["chunk_id"]) for r in bm25.scores(docs, asked, "id", F.col("q")).collect()] == [(1, 3)]
    assert bm25.scores(docs.limit(0), asked, "id", F.col("q")).count() == 0


def test_rerank_reasons(spark):
    c = "query_id long, chunk_id long, fusion double, similarity double, coverage double, focus double, supported boolean, substantive boolean, compatible boolean, signature string"
    rows = [(1, 1, 0.1, 0.9, 0.0, 0.0, True, True, True, "a"), (1, 2, 0.2, 0.9, 0.0, 0.0, True, True, True, "a"), (1, 3, 0.3, 0.1, 0.0, 0.0, False, True, True, "b"), (1, 4, 0.4, 0.9, 0.0, 0.0, True, False, True, "c"), (1, 5, 0.4, 0.9, 0.0, 0.0, True, True, False, "d")]
    got = {r["chunk_id"]: r["reason"] for r in search.reranked(spark.createDataFrame(rows, c)).collect()}
    assert got == {1: "rank_limit_or_duplicate", 2: "selected", 3: "below_unsupported_dense_threshold", 4: "heading_only_or_short_body", 5: "incompatible_topic"}


def test_questions_without_sql(spark):
    typed = ["vancomicin", "irrigation", "isolaton", "catheters", "VRE", "thoracentesiss"]
    known = tuple(sorted({w for own in terms.ALIASES.values() for a in own for w in a.replace("-", " ").split() if w.isascii() and len(w) >= 6} | {"irrigation", "isolation", "thoracentesis"}))
    want = ["vancomycin", "irrigation", "isolation", "catheter", "VRE", "thoracentesis"]
    words = spark.createDataFrame([(w,) for w in typed], "q string")
    assert [r["x"] for r in words.select(close_match(known)("q").alias("x")).collect()] == want
    found = spelling.corrections(words, spark.createDataFrame([(w,) for w in known], "known string"))
    assert {r["word"]: r["corrected"] for r in found.collect()} == {a: b for a, b in zip(typed, want, strict=True) if a != b}
    assert [r["q"] for r in TQ.n02(spark, DIR).collect()] == ["VRE 1", "カタカナ mg", "plain"]
    assert {r["id"]: r["q"] for r in TQ.n12(spark, DIR).collect()}[2] == "수혈 준비사항은"
    plan = {r["id"]: r for r in PQ.p01(spark, DIR).collect()}
    assert plan[7]["entities"] in ("vre,cre", "cre,vre") and plan[7]["max_seeds"] == 8 and plan[6]["domain"] == "out_of_scope"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("감염을 막기 위해\n손을 씻는다.", ["감염을 막기 위해 손을 씻는다."]),
        ("문장이다.\n다음 줄", ["문장이다.", "다음 줄"]),
        ("- 첫 항목\n이어짐\n- 둘째", ["- 첫 항목 이어짐", "- 둘째"]),
        ("- 소독 방법\n별도", ["- 소독 방법", "별도"]),
        ("표의 | 값을\n다음", ["표의 | 값을", "다음"]),
        ("환자를\n\n본다", ["환자를", "본다"]),
        ("0.5 mg을 준다. 다음 1. 항목", ["0.5 mg을 준다.", "다음 1. 항목"]),
        ("plain\ntext", ["plain", "text"]),
        ("", []),
        (None, None),
    ],
)
def test_lines_that_go_on_are_joined(spark, text, want):
    assert spark.createDataFrame([(text,)], "q string").select(X.source_units(F.col("q")).alias("x")).first()["x"] == want


def test_list_items_stay_apart_without_bullets(spark):
    assert one(spark, "- 첫 항목\n이어짐", lambda q: X.source_units(q, False)) == ["- 첫 항목", "이어짐"]


@pytest.mark.parametrize(("text", "want"), [("신규교육 목적은", "hospital"), ("날씨", "out_of_scope"), ("교육 목적은", "unknown"), ("라운지교육 담당", "unknown")])
def test_domain_of_education_questions(spark, text, want):
    assert one(spark, text, P.domain) == want


def test_recursive_splitting():
    split = chunks.split_recursively
    assert split("a b c d e f g", 3, 1) == ["a b c", "c d e", "e f g"]
    assert split("", 3, 1) == split("  \n", 3, 1) == []
    assert split("one two\n\nthree four\n\nfive", 4, 0) == ["one two\n\nthree four", "five"]
    assert split("abcdef", 2, 0, length=len) == ["ab", "cd", "ef"]
    rnd = random.Random(1)
    text = "".join(rnd.choice(["word ", "two. ", "x\n", "y\n\n", "longer "]) for _ in range(2000))
    own = split(text, 50, 10)
    assert all(len(x.split()) <= 50 for x in own) and [w for x in split(text, 50, 0) for w in x.split()] == text.split()
    assert all(x in text for x in own) and own[0] == text.strip()[: len(own[0])]


def test_recursive_chunks_of_rows(spark):
    df = spark.createDataFrame([(1, "a b c d " * 100), (2, None), (3, "")], "doc_id long, text string")
    got = chunks.recursive_chunks(df).collect()
    assert [(r["doc_id"], r["idx"]) for r in sorted(got)] == [(1, k) for k in range(len(got))] and len(got) == 5
