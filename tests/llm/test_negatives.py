import math
import random

import numpy as np
import pytest

from quillspark.llm import negatives


def brute(rows, every, scale=256, positives=5, keep=3, low=50, high=95):
    good = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v])
        good[vec_id] = min(good.get(vec_id, own), own)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        score = {b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))) for b, (_, w) in good.items() if b != a and len(w) == len(v)}
        for p in sorted((b for b in score if good[b][0] == label), key=lambda b: (-score[b], b))[:positives]:
            hard = sorted((b for b in score if good[b][0] != label and low * score[p] <= 100 * score[b] <= high * score[p]), key=lambda b: (-score[b], b))
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(hard[:keep])]
    return sorted(out)


def rows(seed, n, dims, spread, labels=4):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(labels), [spread(rnd) for _ in range(dims)]) for i in range(n)]


CASES = {
    "unit": (rows(1, 400, 8, lambda r: r.gauss(0, 0.4)), {}),
    "ties": (rows(2, 500, 2, lambda r: r.choice([0.25, 0.5, 1.0]), 3), {}),
    "alike": ([(i, i % 2, [1.0, 2.0]) for i in range(300)] + [(i, 1, [0.8, 1.5]) for i in range(300, 320)], {}),
    "wide": (rows(3, 150, 3, lambda r: r.gauss(0, 3e4)), {"keep": 7}),
    "huge": (rows(4, 80, 2, lambda r: r.uniform(5e6, 1.2e7)), {}),
    "negative": (rows(5, 120, 3, lambda r: -abs(r.gauss(0, 1))), {"positives": 2}),
    "shapes": ([(i, i % 3, [0.5 + i / 100] * (i % 4)) for i in range(200)], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_mine_matches_brute_force(spark, name):
    own, more = CASES[name]
    df = spark.createDataFrame(own, "vec_id long, label int, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in negatives.mine(df, 10, **more).collect())
    assert got == brute(own, 10, **more) and (got or name == "negative")


def test_small_blocks_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "CELL", 2)
    own = rows(6, 700, 4, lambda r: r.choice([0.1, 0.4, 0.7]))
    df = spark.createDataFrame(own, "vec_id long, label int, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in negatives.mine(df, 10).collect()) == brute([(a, b, [float(np.float32(x)) for x in v]) for a, b, v in own], 10)


def test_nulls_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    own = rows(7, 60, 3, lambda r: r.random()) + [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0] * 3), (101, 1, None), (102, 1, [1.0, None, 1.0]), (103, 2, [nan, 1.0, 1.0]), (104, 2, [inf, 0.0, 0.0]), (10, 0, [0.1] * 3), (10, 0, [0.1] * 3), (11, 3, [0.9] * 3), (20, 1, [])]
    df = spark.createDataFrame([(*r, 1) for r in own], "vec_id long, label int, embedding array<double>, score int").repartition(4)
    assert sorted(tuple(r) for r in negatives.mine(df, 10).collect()) == brute(own, 10)
    assert negatives.mine(df.limit(0), 10).count() == 0 and negatives.mine(df.filter("vec_id = 10"), 10).count() == 0
