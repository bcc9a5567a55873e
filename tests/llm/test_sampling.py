import hashlib
import math
import random
from collections import Counter

import numpy as np
import xxhash
from corpora import SCHEMA, rows, texts
from pyspark.sql import functions as F

from quillspark.llm import sampling

M = 2**64 - 1
ODD = 0x9E3779B97F4A7C15


def terms(t, n=5):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    n, out = min(n, len(own)), Counter()
    for i in range(len(own) - n + 1 if n else 0):
        x = 0
        for w in own[i : i + n]:
            x = ((x ^ (x >> 29)) * ODD + xxhash.xxh64_intdigest(w)) & M
        x = ((x ^ (x >> 31)) * ODD) & M
        out[x ^ (x >> 32)] += 1
    return out


def brute(t, s, n=5):
    """The fingerprint, term by term and sample by sample, from the formula."""
    own, out = terms(t, n), []
    if not own:
        return "0" * 4 * s.samples
    for times in s.times.tolist():
        best = None
        for h, w in own.items():
            d = ((h * times) & M) >> 48
            k = math.floor(math.log(w) / s.r[d] + s.b[d]) if w > 1 else 0
            key = np.float32(s.base[d] - s.r[d] * k), ((h & 0xFFFFFFFF) + k * ODD) & 0xFFFFFFFF
            best = min(best, key) if best else key
        out.append((((best[1] * ODD) & M) >> 48) | 1)
    return "".join(f"{x:04x}" for x in out)


def edited_text(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_edited_matches_brute_force(spark):
    own = texts(n=25)
    own += ["\U0001f600é" * 30, "A b C d E f", "a B c D e F"]
    s = sampling.Sampler(16)
    for parts in ("1", "5", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["doc_id"]: r for r in sampling.edited(spark.createDataFrame(rows(own), SCHEMA).repartition(4), samples=16).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted(got) == list(range(len(own)))
        for i, t in enumerate(own):
            t, after, r = t or "", own[(i + 1) % len(own)] or "", got[i]
            changed = edited_text(t, after)
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest(), i
            if parts == "5":
                prints = [brute(x, s) for x in (t, changed, after)]
                assert [r["fingerprint"], r["edited_fingerprint"]] == prints[:2], i
                alike = lambda x, y: sum(x[k : k + 4] == y[k : k + 4] for k in range(0, 64, 4)) / 16
                assert (r["near_edited"], r["near_next"]) == (alike(*prints[:2]), alike(prints[0], prints[2])), i


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rnd = random.Random(9)
    s = sampling.Sampler(1024, 1)
    errors = []
    for _ in range(40):
        vocabulary = [f"w{k}" for k in range(rnd.randint(3, 60))]
        a = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 400))]
        b = [x if rnd.random() < 0.6 else rnd.choice(vocabulary) for x in a][: rnd.randint(1, 400)]
        p, q = Counter(a), Counter(b)
        exact = sum((p & q).values()) / sum((p | q).values())
        x, y = s.signatures([" ".join(a).encode(), " ".join(b).encode()])
        errors.append((x == y).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.07


def test_fingerprint_and_likeness(spark, docs, no_docs):
    got = sampling.fingerprint(docs.withColumn("fingerprint", F.lit(1)), samples=32)
    assert got.columns == [*docs.columns, "fingerprint"]
    found = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    own = texts()
    by_text = {}
    for i, t in enumerate(own):
        assert by_text.setdefault(t, found[i]) == found[i] and len(found[i]) == 128
    assert found[0] == found[1] == found[3] == "0" * 128 and "0000" not in found[2]
    pair = spark.createDataFrame([("0001000200030004", "0001000200040004")], "a string, b string").select(sampling.likeness(F.col("a"), F.col("b")).alias("x")).first()
    assert pair["x"] == 0.75
    assert sampling.fingerprint(no_docs).count() == 0 and sampling.edited(no_docs).count() == 0


def test_order_of_ids_with_ties_nulls_and_one_row(spark):
    one = sampling.edited(spark.createDataFrame([(5, "one two three four five six")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    own = [(None, "n"), (7, "bbbb"), (7, "aaaa"), (7, "aaaa"), (-3, "cc"), (2**62, None)]
    got = sampling.edited(spark.createDataFrame(own, "doc_id long, text string, part string".rsplit(",", 1)[0])).collect()
    order = [(None, "n"), (-3, "cc"), (7, "aaaa"), (7, "aaaa"), (7, "bbbb"), (2**62, "")]
    want = sorted((str(i), hashlib.sha256(edited_text(t, order[(k + 1) % 6][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want
