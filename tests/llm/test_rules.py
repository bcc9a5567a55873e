import re
from collections import Counter

from corpora import SCHEMA, texts

from quillspark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measurements_match_brute_force(docs):
    got = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    for i, t in enumerate(texts()):
        assert tuple(got[i][m] for m in rules.MEASURES[:5]) == brute(t), i
    assert len(got) == docs.count()


def test_policies_and_ablations(spark, docs):
    book = rules.apply_policy(rules.ledger(docs), "v2").cache()
    for r in book.collect():
        words, repeat = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (words < 20 or 100 * repeat > 30 * words)
        assert r["kept"] == (r["failed_bits"] & rules.POLICIES["v2"] == 0)
    rejected = book.filter("NOT kept").count()
    by_rule = {r["rule"]: r for r in rules.ablations(book, "v2").collect()}
    assert by_rule["few_words"]["n_kept_without"] == book.count() - rejected + by_rule["few_words"]["n_only"]


def test_keep_passes_columns_through(spark, docs, no_docs):
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert rules.keep(no_docs).count() == 0 and rules.ledger(no_docs).count() == 0
    junk = spark.createDataFrame([(1, "# a $ b % c " * 10, None, None, 0, "", ""), (2, "SHOUT!! " * 30, None, None, 0, "", ""), (3, " ".join(f"w{i}" for i in range(40)), None, None, 0, "", "")], SCHEMA)
    assert [r["doc_id"] for r in rules.keep(junk).collect()] == [3]
