"""Incremental parsing, resumed vectors, spelling against brute force, action strength by examples."""

import difflib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_readers import docx, p

from quillspark.functions import actions as A
from quillspark.operators import embedding, spelling
from quillspark.sources import incremental


def test_only_new_files_are_parsed(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    assert incremental.refresh(spark, str(tmp_path / "in*"), store)[1] == 0
    for name in "abc":
        docx(folder / f"{name}.docx", p(f"text of {name}"))
    (folder / "bad.docx").write_bytes(b"no archive")
    seen = lambda df: sorted((r["path"].rsplit("/", 1)[-1], r["text"], r["error"]) for r in df.collect())
    first, n = incremental.refresh(spark, str(folder), store)
    want = seen(first)
    assert n == 4 and [w[0] for w in want] == ["a.docx", "b.docx", "bad.docx", "c.docx"]
    again, n = incremental.refresh(spark, str(folder), store)
    assert n == 0 and seen(again) == want
    docx(folder / "b.docx", p("changed"))
    (folder / "c.docx").rename(folder / "d.docx")
    third, n = incremental.refresh(spark, str(folder), store)
    assert n == 2 and [(a, b) for a, b, e in seen(third) if not e] == [("a.docx", "text of a"), ("b.docx", "changed"), ("d.docx", "text of c")]
    assert incremental.refresh(spark, str(folder), store, version="2")[1] == 4
    assert zipfile.is_zipfile(folder / "d.docx")


def test_vectors_are_resumed_to_the_same_rows(spark, tmp_path):
    class Breaking(embedding.Hashing):
        def make(self):
            work = embedding.Hashing.make(self)

            def vectors(texts):
                if any("break" in t for t in texts):
                    raise RuntimeError("broke off")
                return work(texts)

            return vectors

    rows = [(i, None if i == 3 else "" if i == 4 else f"word{i} text of {i % 7}" + (" break" if i == 50 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    want = {r["id"]: r["v"] for r in embedding.embed(df, "id", "t", embedding.Hashing(32), str(tmp_path / "one"), 4).collect()}
    with pytest.raises(Exception, match="broke off"):
        embedding.embed(df, "id", "t", Breaking(32), str(tmp_path / "two"), 4)
    got = {r["id"]: r["v"] for r in embedding.embed(df, "id", "t", embedding.Hashing(32), str(tmp_path / "two"), 4).collect()}
    assert got == want and len(got) == 120
    assert not any(want[3]) and not any(want[4]) and np.allclose(np.linalg.norm(want[5]), 1)


@pytest.mark.parametrize("long", [False, True])
def test_corrections_match_close_matches(spark, long):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(14, 30) if long else rnd.randint(6, 17)))
    known = sorted({word() for _ in range(150)})

    def typed(w):
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "xy"])
        return "".join(w)

    words = sorted({typed(rnd.choice(known)) for _ in range(250)} | {"abc", "ABCDEFG", "x1y2z3q"})
    want = {}
    for w in words:
        if w not in known and len(w) >= 6 and w.isalpha() and w.islower():
            close = difflib.get_close_matches(w, known, n=2, cutoff=0.88)
            if len(close) == 1:
                want[w] = close[0]
    got = spelling.corrections(spark.createDataFrame([(w,) for w in [*words, None]], "w string"), spark.createDataFrame([(w,) for w in known], "w string"))
    assert {r["word"]: r["corrected"] for r in got.collect()} == want and len(want) > 40


# Text, and the kinds and strengths that it asks for, worked out by hand.
SIGNATURES = [
    ("활력징후를 측정하고 즉시 기록한다.", [("measure", "immediate_required"), ("record", "immediate_required")]),
    ("투여를 중단한다", [("stop", "required")]),
    ("약물을 투여하고, 통증을 확인할 수 있다", [("verify", "optional"), ("administer", "required")]),
    ("시행 전, 동의서를 작성한다", [("record", "required")]),
    ("제거하지 않는다; 연결을 권고한다", [("remove", "prohibited"), ("connect", "recommended")]),
    ("낙상에 주의한다", [("caution", "caution")]),
    ("낙상에 반드시 주의한다. 채혈 여부를 검토한다", [("caution", "required"), ("collect", "consider")]),
    ("흡연을 금지한다", [("prohibit", "prohibited")]),
    ("물품을 준비해야 한다", [("prepare", "required")]),
    ("", []),
    ("쉰다", []),
]


def test_signatures_of_actions(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SIGNATURES)], "i int, t string").select("i", A.signatures(F.col("t")).alias("s")).collect()
    assert {r["i"]: [(s["kind"], s["strength"]) for s in r["s"]] for r in got} == {i: want for i, (_, want) in enumerate(SIGNATURES)}
