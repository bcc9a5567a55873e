"""Words of questions within texts: counts by plain search, in rows of a bounded number of questions, and no row for a pair."""

import random

import pyarrow as pa
import pytest

from quillspark.operators import contained, vectors


@pytest.mark.parametrize("bits", [18, 4])
def test_counts_are_those_of_plain_search(monkeypatch, bits):
    monkeypatch.setattr(contained, "BITS", bits)
    monkeypatch.setattr(contained, "QUESTIONS", 3)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abé가-") for _ in range(rng.randint(1, 10)))
    terms = [list(dict.fromkeys(word() for _ in range(rng.randint(0, 12)))) for _ in range(20)]
    texts = [None, "", "a"] + ["".join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)]
    asked = pa.table({"query_id": pa.array([10 * i for i in range(20)]), "terms": pa.array(terms, pa.list_(pa.string()))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "t"])
    (made,) = contained.holding(asked)([batch])
    rows = made.to_pylist()
    assert rows and max(len(r["words"]) for r in rows) <= 3
    got = {(r["chunk_id"], w["query_id"]): w["lexical"] for r in rows for w in r["words"]}
    want = {(i, 10 * q): n for i, t in enumerate(texts) if t is not None for q, own in enumerate(terms) if (n := sum(w in t for w in own))}
    assert got == want


def test_no_question_and_no_word():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["abc"])], names=["id", "t"])
    kind = pa.list_(pa.string())
    for terms in ([], [None], [[]], [["x"]]):
        (made,) = contained.holding(pa.table({"query_id": pa.array(range(len(terms)), pa.int64()), "terms": pa.array(terms, kind)}))([batch])
        assert made.num_rows == 0


def test_words_of_a_row_are_the_same_as_pairs(spark, monkeypatch):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.choice((0.0, 1.0, 2.0)) for _ in range(4)]) for i in range(200)], "chunk_id long, v array<double>")
    q = v.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "v AS q")
    words = {i: [(a, rng.randint(1, 3)) for a in range(0, 240, 20) if rng.random() < 0.3] for i in range(220)}  # questions and rows without a vector, too
    pairs = spark.createDataFrame([(a, i, n) for i, own in words.items() for a, n in own], "query_id long, chunk_id long, lexical long")
    rows = spark.createDataFrame([(i, own[k : k + 2]) for i, own in words.items() for k in range(0, len(own), 2)], f"chunk_id long, {contained.WORDS}")
    monkeypatch.setattr(vectors, "SOME", 2)
    one, two, none = (sorted(map(tuple, vectors.blended(v, q, x, 12).collect())) for x in (pairs, rows, rows.limit(0)))
    assert one == two and any(r[3] for r in one)
    assert len(none) == 60 and all(r[3] == 0 and r[4] == r[5] == r[6] for r in none)
