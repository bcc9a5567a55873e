"""Cases that a review found: each failed before."""

import duckdb
import pytest

from quillspark import queries

TURNS = [(1, 3, "user", "avecrechque"), (2, 3, "user", "avec"), (3, 3, "user", "zapicco"), (4, 3, "user", "vre")]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("given"))
    turns = [(100 * k + c, t, r, x) for k in range(34) for c, t, r, x in TURNS]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    items = [(i, "A single statement of some length.") for i in range(18)] + [(i, "One statement stands here. Another stands there.") for i in range(18, 36)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", ["p03_domain", "m19_uat_contract", "v13_paraphrase", "v14_decision"])
def test_same_rows_as_sql(spark, given, name):
    con = duckdb.connect()
    for own in ("conversations", "benchmark"):
        con.sql(f"CREATE VIEW {own} AS SELECT * FROM '{given}/{own}.parquet/*.parquet'")
    df = queries.all_queries()[name](spark, given)
    columns = ", ".join(df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(f"SELECT {columns} FROM ({queries.all_oracles()[name]})").fetchall()))
