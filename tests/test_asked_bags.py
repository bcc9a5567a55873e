"""Bags for known questions hold the words of these alone, and rank as bags with all words do."""

from pyspark.sql import functions as F

from quillspark.functions.text import lexical_tokens
from quillspark.operators.scan import Bags
from quillspark.queries import common

TEXTS = ["the cat and a dog", "a dog 12 and 1.5", None, "", "수혈 전 확인 the cat", "cat cat cat", "nothing at all of it", "foley the dog"]


def test_same_ranking_from_fewer_words(spark, tmp_path, monkeypatch):
    docs = [(i % 30, TEXTS[i % len(TEXTS)]) for i in range(40)]  # ids repeat
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a cat or the dog"), (2, "수혈 확인 12"), (3, None), (4, "unheard")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    for name, tokens in (("lexical", lexical_tokens), ("minimal", common.minimal)):
        own = common.asked_bags(spark, at, name, tokens)
        items = common.table(spark, at, "benchmark")
        asked = {r.w for r in items.select(F.explode(tokens(F.col("text"))).alias("w")).collect()}
        assert {r.term for r in own.df.read().collect()} <= asked
        whole = Bags(common.table(spark, at, "documents"), "doc_id", F.col("text"), tokens, latin=common.latin(name, F.col("text")))
        assert (own.n, own.avgdl) == (whole.n, whole.avgdl) and own.df.read().count() < whole.df.read().count()
        one, two = (sorted(map(tuple, b.top(b.asked(items, "item_id", tokens(F.col("text"))), 10).collect())) for b in (own, whole))
        assert one and one == two


def test_bags_with_all_words_are_taken_if_there_or_if_items_have_too_many(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "the cat"), (2, "a dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "cat dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = str(tmp_path)
    monkeypatch.setattr(common, "ENTRIES", 1)
    assert common.asked_bags(spark, at, "lexical", lexical_tokens).only is None
    assert common.asked_bags(spark, at, "lexical", lexical_tokens) is common.shared_bags(spark, at)
