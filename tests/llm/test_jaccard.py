import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import jaccard
from quillspark.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, size=4, percent=85):
    sets = []
    for t in texts:
        w = (t or "").translate(LOWER).encode().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in held[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            held[g].append(i)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [a + b for a in "abcdefghijklm" for b in "nopqrstuvwxyz"]
    out = [None, "", " \n", "One", "one", "one two", "ONE two", "a b c d", "a b c D"]
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 25])):
            out.append(" ".join(w if rnd.random() > rate else rnd.choice(vocab) + "x" for w in base for rate in [0.02]))
    line = " ".join(rnd.choice(vocab) for _ in range(12))
    out += [line + " " + " ".join(rnd.choice(vocab) * 2 for _ in range(rnd.randint(3, 30))) for _ in range(60)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("limit", "indexed", "hot", "rule"), [(2_000, 4_096, 256, (4, 85)), (9, 20, 3, (4, 85)), (9, 20, 3, (5, 80)), (2_000, 4_096, 256, (1, 60))])
def test_components_match_brute_force(spark, monkeypatch, limit, indexed, hot, rule):
    monkeypatch.setattr(jaccard, "LIMIT", limit)
    monkeypatch.setattr(jaccard, "INDEXED", indexed)
    monkeypatch.setattr(jaccard, "HOT", hot)
    own = corpus(limit)
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.report(df, rule=jaccard.Rule(*rule)).collect()}
    assert [got[i] for i in range(len(own))] == brute(own, *rule)


def test_repeated_ids_empty_table_and_representatives(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (3, "A b c d e f", "y"), (9, None, "z"), (None, "q r s t", "w"), (7, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in jaccard.report(df).collect() if r["doc_id"])
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 9)]
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns and kept.count() == 4
    assert jaccard.report(df.limit(0)).count() == 0 and jaccard.representatives(df.limit(0)).count() == 0


def test_rtree_keeps_all_pairs_that_reach_the_threshold():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 280, replace=False), rnd.integers(0, 2**63, rnd.integers(0, 40), dtype=np.uint64)])) for _ in range(80)]
    vectors = jaccard.points([jaccard.point(s, 64) for s in sets], 64)
    sizes = np.array([len(s) for s in sets])
    found = {(int(a), int(b)) for q, p in jaccard.CountRTree(vectors, sizes).candidates(vectors, sizes) for a, b in zip(q, p, strict=True)}
    for a in range(80):
        for b in range(80):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                assert (a, b) in found


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).distinct().collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 140))
