"""Gold is found once for all queries, by one reading of the documents."""

from quillspark.queries import common
from quillspark.queries.release import m21_frozen


def test_gold_is_found_once(spark):
    sf = "/root/testdata/sf0.001"
    assert common.gold(spark, sf).inputFiles() == common.gold(spark, sf).inputFiles()
    assert "documents.parquet" not in m21_frozen(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("documents.parquet" in f for f in m21_frozen(spark, sf).inputFiles())
