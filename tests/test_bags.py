"""Latin words by their bytes are those of the patterns, whichever way a text is set in words."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions.latin import words
from quillspark.functions.text import anchors, lexical_tokens, may_name, minimal_tokens
from quillspark.operators import scan
from quillspark.queries import common

FIXED = ["", None, "1.2.3.4 a1.5 -5 12.5abc 1-2.5", "x-y--z 9-a", "1.", ".1", "Çé1 İstanbul \u212a9", "secret create", "the PCN-tube", "pcn irrigation", "경피적 신루 relief", "vanco 12.5"]


def made(n, letters="ab19-. \u00e9\ud55c"):
    rng = random.Random(3)
    return [*FIXED, *["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)]]


@pytest.mark.parametrize("pattern, numbers", [(r"[a-z][a-z0-9-]*", False), (r"[a-z][a-z0-9-]*|[0-9]+(?:\.[0-9]+)?", True)])
def test_words_are_the_matches(pattern, numbers):
    texts = made(3000)
    for at, size in ((0, len(texts)), (700, 900), (0, 2), (2, 1), (5, 0)):
        got, owner = words(pa.array(texts, "string").slice(at, size), numbers)
        assert sorted(zip(owner.tolist(), got.to_pylist())) == sorted((i, w) for i, t in enumerate(texts[at : at + size]) for w in re.findall(pattern, t or ""))


@pytest.mark.parametrize("tokens, latin", [(lexical_tokens, "lexical"), (minimal_tokens, "minimal")])
def test_same_bags_either_way(spark, monkeypatch, tokens, latin):
    docs = spark.createDataFrame(list(enumerate(made(400))) + [(7, "secret create"), (7, "a b")], "id long, t string").repartition(3)
    monkeypatch.setattr(scan, "TEXT_BYTES", 64)
    plain = scan.Bags(docs, "id", F.col("t"), tokens)
    own = scan.Bags(docs, "id", F.col("t"), tokens, latin=common.latin(latin, F.col("t")))
    assert (own.n, own.avgdl) == (plain.n, plain.avgdl)
    assert sorted(own.df.read().collect()) == sorted(plain.df.read().collect())
    every = spark.createDataFrame([(1, "a 1.5 b1 9 pcn secret vanco"), (2, "경피적 한 a-")], "q long, t string")
    scores = [sorted(b.scores(b.asked(every, "q", tokens(F.col("t")))).collect()) for b in (own, plain)]
    assert scores[0] == scores[1] and len(scores[0]) > 50


def test_no_anchor_is_missed(spark):
    texts = spark.createDataFrame([(t,) for t in [*made(0), "vancomycin-resistant enterococci", "Percutaneous  nephrostomy", "xpcn", "유치도뇨관"]], "t string")
    rows = texts.select("t", anchors(F.col("t")).alias("a"), may_name(F.col("t")).alias("m")).collect()
    assert all(r["m"] for r in rows if r["a"]) and {r["t"]: r["m"] for r in rows}["secret create"] is False
    assert sum(bool(r["a"]) for r in rows) == 7
