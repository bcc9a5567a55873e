"""Answers over documents are diagnosed without an exchange; pieces and actions stay what they are by the words one by one."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.operators import diagnosis
from quillspark.queries import diagnosis as Q

TEXTS = [None, "", "  \n ", "One.", "a b. " * 13, "위 관 A1. 약물을 투여한다! 5 mg을 x", "".join(f"Zeile {i}: 금식한다.\t Und {i} mg?\n" for i in range(40)), "x" * 700 + ". kurz"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("answers"))
    rows = [(26 * k + i, t) for k in range(3) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{at}/documents.parquet")
    return at


def test_nothing_is_exchanged_by_key(spark, given):
    plan = Q.QUERIES["v16_stages"](spark, given)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan


def test_same_rows_as_sql(spark, given):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{given}/documents.parquet/*.parquet'")
    df = Q.QUERIES["v16_stages"](spark, given)
    rows = sorted(map(repr, map(tuple, df.collect())))
    assert rows and rows == sorted(map(repr, con.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES['v16_stages']})").fetchall()))


def plain(text: str) -> set[str]:
    """Pieces by the words one by one."""
    words = re.findall(diagnosis.WORD, re.sub(diagnosis.ITEM_NUMBER, "", text.lower()))
    words = [re.sub(f"^([가-힣]{{2,}}?)(?:{diagnosis.ENDINGS})$", r"\1", w) for w in words]
    korean = lambda w: bool(re.match("[가-힣]", w))
    pairs = lambda w: {w[i : i + 2] for i in range(len(w) - 1)} or {w}
    found = set()
    for i, w in enumerate(words):
        beside = words[i + 1] if i + 1 < len(words) else ""
        if not korean(w):
            found.add(w)
        elif len(w) == 1 and korean(beside):
            found |= {w} | pairs(w + beside)
        else:
            found |= pairs(w)
    return found


def test_pieces(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["위", "관", "약물을", "투여했다", "에서는", "a1", "%", "ß", " ", " ", " | ", "\n", "5", "."]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", diagnosis.pieces(F.col("t")).alias("p")).collect()
    assert all(sorted(r.p) == sorted(plain(r.t)) for r in rows)


def test_clauses_of_the_source_ask_for_nothing_else(spark):
    said = [("약물을 투여한다. 기록한다", "약물을 투여한다\n기록한다.", None), ("약물을 투여한다. 즉시 기록한다", "약물을 투여한다\n기록한다.", "evaluation_action_strength_changed"), ("제거한다. 기록한다", "기록한다.", "evaluation_action_kind_changed"), ("라벨", "기록한다.", None)]
    rows = spark.createDataFrame(said, "own string, source string, code string")
    own, source = A.clauses(F.col("own")), A.clauses(F.col("source"))
    new = A.strength_check(A.of_clauses(F.array_except(own, source)), A.of_clauses(source))["error_code"]
    whole = A.strength_check(A.signatures(F.col("own")), A.signatures(F.col("source")))["error_code"]
    assert all(r.code == r.new == r.whole for r in rows.select("code", new.alias("new"), whole.alias("whole")).collect())
