import math
import random

import pytest

from quillspark.llm import language

PARTS = {"aa": ["ka", "lo", "mi", "re", "el"], "bb": ["sch", "ung", "keit", "ver", "el"], "cc": ["eau", "tion", "mé", "oi", "el"]}
SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def rows(n: int = 220):
    rnd = random.Random(8)
    out = []
    for i in range(n):
        name = rnd.choice(sorted(PARTS))
        words = ["".join(rnd.choice(PARTS[name if rnd.random() < 0.8 else "aa"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 120))]
        out.append((i, " ".join(words), name, 7.0, "clash"))
    extra = [None, "", "12 34 !!", "K", "zzz qqq", "KALO mire! " * 400, "Ω", out[3][1]]
    return [*out, *[(n + k, t, None, 7.0, "clash") for k, t in enumerate(extra)], out[5], out[5]]


def brute_bits(text: str, sample: bytes) -> float:
    """Weighed phrases: each block is parsed into longest matches, found by search in the sample."""
    letters = language.letters_of(text.encode())
    count = 0
    for at in range(0, max(1, len(letters)), language.BLOCK):
        held = b""
        count += 1
        for c in letters[at : at + language.BLOCK]:
            held += bytes([c])
            if held not in sample:
                count += 1
                held = bytes([c]) if bytes([c]) in sample or c == 32 else b""
    return count * math.log2(len(sample) + 2)


def test_predictions_match_brute_force(spark):
    own = rows()
    df = spark.createDataFrame(own, SCHEMA).repartition(3)
    samples = language.sample(df)
    got = language.predict(df.select("doc_id", "text"), samples).collect()
    assert len(got) == len(own)
    texts = {i: t for i, t, *_ in own}
    for r in got:
        t = texts[r["doc_id"]]
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bits = sorted((brute_bits(t, x) - math.log2(share), name) for name, (x, share) in samples.items())
        assert r["lang_pred"] == bits[0][1], (t, bits)
        assert r["score"] == pytest.approx(1 - bits[0][0] / bits[1][0])


def test_samples_hold_no_text_that_is_held_out(spark):
    own = [(i, f"only{i}word " * 3, "en", 0.0, "") for i in range(200)]
    df = spark.createDataFrame(own, SCHEMA)
    held = {r["doc_id"] for r in df.filter(language.held_out(df["doc_id"])).collect()}
    text = language.sample(df)["en"][0].decode()
    assert held and not any(language.letters_of(own[i][1].encode()).decode() == text for i in held)
    changed = spark.createDataFrame([(i, "changed wholly" if i in held else t, "xx" if i in held else n, s, p) for i, t, n, s, p in own], SCHEMA)
    assert language.sample(changed) == language.sample(df)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(rows(40), SCHEMA)
    samples = language.sample(df)
    assert language.sample(df.limit(0)) == {}
    assert language.predict(df.limit(0), samples).count() == 0
    got = language.predict(df, samples)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == df.count()
    assert {r["lang_pred"] for r in got.collect()} <= {"und", *PARTS}


@pytest.mark.parametrize("group", [1, 2])
def test_languages_in_groups_give_the_same(spark, group):
    df = spark.createDataFrame(rows(80), SCHEMA).repartition(3)
    samples = language.sample(df)
    want = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.predict(df, samples).collect())
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.predict(df, samples, group=group).collect()) == want


def test_no_language_is_left_out(spark):
    own = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" * 9, f"l{i:03}", 0.0, "") for i in range(520)]
    samples = language.sample(spark.createDataFrame(own, SCHEMA))
    assert len(samples) == 520 - sum(r[0] for r in spark.createDataFrame(own, SCHEMA).selectExpr("int(crc32(string(doc_id)) % 4 = 2)").collect())
