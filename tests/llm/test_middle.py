import hashlib
import random
import re

from corpora import SCHEMA, rows, texts
from pyspark.sql import functions as F

from quillspark.llm import middle


def brute(doc_id, t, rate=100, spm=50):
    t = t or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    g = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or g[2] % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((g[0] % (n + 1), g[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if g[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


HARD = ["\n", "\n\n", "a\n", "\na", "é\n\nü", "<P>", "x<S>\ny", "<\nP>\n<S\n>", "\U0001f600\n" * 40, "\r\n\r\n", "\0\n\x85 ", "l\n" * 30_000 + "end", "one line " * 20_000]


def test_transform_matches_brute_force_and_rebuilds(spark):
    rnd = random.Random(3)
    own = texts() + HARD + ["\n".join(rnd.choice(["", "a b", "été", "\t"]) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    own += own[6:9]
    made = middle.transform(spark.createDataFrame(rows(own), SCHEMA).repartition(3))
    assert made.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "spans"]
    got = {r["doc_id"]: r for r in made.withColumn("again", middle.restored(F.col("fim_output"), F.col("fim_form"))).collect()}
    for i, t in enumerate(own):
        r = got[i]
        assert (r["fim_lines"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) == brute(i, t), i
        assert r["again"] == (t or "") and r["text"] == t
    assert {r["fim_form"] for r in got.values()} == set(middle.FORMS)


def test_rates_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a\nb", 1), (None, "a\nb", 1), (3, None, 2)], "doc_id long, text string, fim_form int")
    got = middle.transform(df).collect()
    assert [tuple(r[c] for c in ("fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")) for r in got] == [brute(None, "a\nb"), brute(None, "a\nb"), brute(3, None)]
    assert middle.transform(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"{i}\nx\ny\n") for i in range(300)], "doc_id long, text string")
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        for r in middle.transform(many, rate=rate, suffix_first=spm).collect():
            assert (r["fim_lines"], r["fim_form"], r["fim_prefix_chars"], r["fim_middle_chars"], r["fim_output"]) == brute(r["doc_id"], r["text"], rate, spm)


def test_place_finds_each_bit():
    rnd = random.Random(1)
    for width in (1, 2, 3, 64, 1000):
        some = sorted(rnd.sample(range(width), rnd.randint(1, width)))
        bits = sum(1 << k for k in some)
        assert [middle.place(bits, r, width) for r in range(len(some) + 1)] == [*some, width]
