"""What the query modules share: tables, the standard inputs, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import lexical_tokens, may_name, sentences
from quillspark.operators import bm25
from quillspark.operators.impacts import Impacts
from quillspark.operators.scan import ENTRIES, Bags
from quillspark.session import blocks, spread, write_shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is one of ids (one column): ids are sent to the rows in blocks, so that no other row is exchanged.

    They are written first: blocks go by their size, which Catalyst can't tell behind joins.
    """
    ids = write_shared(ids.toDF(key).distinct(), "ids")
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(own), key, "left_semi") for own in blocks(ids, key)])


def hit_documents(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """The documents of hits (with chunk_id)."""
    return among(table(spark, sf_dir, "documents"), "doc_id", hits.select("chunk_id"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of our own examples."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same table as a SQL CTE body."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(one(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) v({names}))"


def planted(spark: SparkSession, sf_dir: str, rows: list[tuple], apart: str = " ") -> DataFrame:
    """id, q: every turn of the conversations with one of the rows (id from 1 on, text) before or after its text."""
    n, own = len(rows), F.broadcast(literal(spark, [(k, r[1]) for k, r in enumerate(rows)], "k long, example string"))  # as many rows as are written here
    turns = table(spark, sf_dir, "conversations").select((1000 * F.col("conv_id") + F.col("turn")).alias("id"), "text")
    both = turns.join(own, F.col("id") % n == F.col("k"))
    return both.select("id", F.when(F.floor(F.col("id") / n) % 2 == 0, F.concat_ws(apart, "example", "text")).otherwise(F.concat_ws(apart, "text", "example")).alias("q"))


def sql_planted(rows: list[tuple], apart: str = "' '") -> str:
    """The same as a SQL CTE body."""
    own, n = values([(k, r[1]) for k, r in enumerate(rows)], "k, example"), len(rows)
    turns = "SELECT 1000 * conv_id + turn AS id, text FROM conversations"
    return f"(SELECT id, CASE WHEN (id // {n}) % 2 = 0 THEN example || {apart} || text ELSE text || {apart} || example END AS q FROM ({turns}) JOIN {own} ON id % {n} = k)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.tokenized(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


#: What a session's queries share: written tables and indexes, the latest SHARED of them.
_SHARED: dict[tuple, object] = {}
SHARED = 16


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object], tables: tuple[str, ...] = ("documents",)):
    """What make() gives, made once for a session and a state of the tables (length, files and time)."""
    state = _state(spark, sf_dir, name, tables)
    if state not in _SHARED:
        made = make()
        while len(_SHARED) >= SHARED:
            _SHARED.pop(next(iter(_SHARED)))
        _SHARED[state] = made
    return _SHARED[state]


def _state(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...]) -> tuple:
    state: tuple = (spark.sparkContext.applicationId, name, sf_dir)
    for own in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{own}.parquet")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        told = files.getContentSummary(where)
        state += (told.getLength(), told.getFileCount(), files.getFileStatus(where).getModificationTime())
    return state


def shared_index(spark: SparkSession, sf_dir: str, name: str = "lexical", tokens: Callable[[Column], Column] = lexical_tokens) -> DataFrame:
    """The postings of the documents, written to the shared folder once for a session and a state of the table."""

    def make() -> DataFrame:
        docs = bm25.tokenized(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), tokens)
        return write_shared(bm25.postings(docs), f"postings-{name}")

    return shared(spark, sf_dir, f"postings-{name}", make)


def shared_impacts(spark: SparkSession, sf_dir: str, name: str = "lexical", tokens: Callable[[Column], Column] = lexical_tokens) -> Impacts:
    """The impact-ordered index of the same postings."""
    return shared(spark, sf_dir, f"impacts-{name}", lambda: Impacts(shared_index(spark, sf_dir, name, tokens)))


def latin(name: str, text: Column) -> tuple[Column, bool] | None:
    """Of which texts the tokens (lexical, minimal) are Latin words, and whether numbers are tokens too."""
    return {"lexical": (~may_name(text), False), "minimal": (~text.rlike("[가-힣]"), True)}.get(name)


def shared_bags(spark: SparkSession, sf_dir: str, name: str = "lexical", tokens: Callable[[Column], Column] = lexical_tokens) -> Bags:
    """The documents as bags of words, written once for a session and a state of the table."""
    return shared(spark, sf_dir, f"bags-{name}", lambda: _bags(spark, sf_dir, name, tokens))


def _bags(spark: SparkSession, sf_dir: str, name: str, tokens: Callable[[Column], Column], only: pa.Array | None = None) -> Bags:
    return Bags(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), tokens, latin=latin(name, F.col("text")), only=only)


def asked_bags(spark: SparkSession, sf_dir: str, name: str, tokens: Callable[[Column], Column]) -> Bags:
    """Bags for the items' questions: those with all words if the session has them or the items have more than ENTRIES words, else with the items' words alone."""

    def make() -> Bags:
        words = write_shared(table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("w")).distinct(), "asked-words")
        if words.count() > ENTRIES:
            return shared_bags(spark, sf_dir, name, tokens)
        return _bags(spark, sf_dir, name, tokens, words.toArrow().column("w").combine_chunks())

    whole = _SHARED.get(_state(spark, sf_dir, f"bags-{name}", ("documents",)))
    return whole or shared(spark, sf_dir, f"bags-asked-{name}", make, ("documents", "benchmark"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = shared_bags(spark, sf_dir)
    return bags.scores(bags.asked(table(spark, sf_dir, "benchmark"), "item_id", lexical_tokens(F.col("text"))))


#: Ranks of a ranking that queries share.
RANKS = 10


def _shared_top(spark: SparkSession, sf_dir: str, k: int, name: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """The best k documents of each item, by one pass over the bags of words; up to RANKS of them are searched once for all queries."""

    def best(most: int) -> DataFrame:
        bags = asked_bags(spark, sf_dir, name, tokens)
        return bags.top(bags.asked(table(spark, sf_dir, "benchmark"), "item_id", tokens(F.col("text"))), most)

    if k > RANKS:
        return best(k)
    return shared(spark, sf_dir, f"top-{name}", lambda: write_shared(best(RANKS), f"top-{name}"), ("documents", "benchmark")).filter(F.col("rank") <= k)


def bm25_top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return _shared_top(spark, sf_dir, k, "lexical", lexical_tokens)


def minimal(text):
    from quillspark.functions.text import minimal_tokens

    return minimal_tokens(text)


def bm25_minimal_top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return _shared_top(spark, sf_dir, k, "minimal", minimal)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, chunk_id: documents that hold a sentence of more than 20 characters of the item. Found once for all queries.

    The items' sentences are sent to the documents in blocks, so that no sentence of a document is exchanged.
    """

    def long(name: str, key: str, own: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias(own), F.explode(F.array_distinct(sentences(F.col("text")))).alias("s")).filter(F.length("s") > 20)

    def make() -> DataFrame:
        docs, asked = long("documents", "doc_id", "chunk_id"), write_shared(long("benchmark", "item_id", "query_id"), "gold-asked")
        met = reduce(DataFrame.unionByName, [docs.join(F.broadcast(some), "s") for some in blocks(asked, "s")])
        return write_shared(met.select("query_id", "chunk_id").distinct(), "gold")

    return shared(spark, sf_dir, "gold", make, ("documents", "benchmark"))


__all__ = ["bm25_minimal_top", "bm25_scores", "bm25_top", "corpus", "gold", "hit_documents", "lexical_tokens", "literal", "table", "values"]


def sql_tokens(text: str, pattern: str = "[a-z][a-z0-9-]*|[가-힣]{2,}") -> str:
    return f"regexp_extract_all(lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), '{pattern}')"


def sql_sentences(text: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def sql_bm25(name: str = "bm", pattern: str = "[a-z][a-z0-9-]*|[가-힣]{2,}") -> str:
    """CTEs {name}_docs, {name}_stats, {name}_tf, {name}_df, {name}_q, {name}_scores(query_id, chunk_id, score)."""
    n = name
    return f"""
{n}_docs AS (SELECT doc_id AS chunk_id, {sql_tokens("text", pattern)} AS toks FROM documents),
{n}_stats AS (SELECT count(*) AS n, greatest(1.0, avg(len(toks))) AS avgdl FROM {n}_docs),
{n}_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM {n}_docs) GROUP BY ALL),
{n}_df AS (SELECT term, count(*) AS df FROM {n}_tf GROUP BY term),
{n}_q AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens("text", pattern)}) AS term FROM benchmark),
{n}_scores AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {n}_q JOIN {n}_tf USING (term) JOIN {n}_df USING (term), {n}_stats GROUP BY query_id, chunk_id),
{n}_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {n}_scores) WHERE rank <= 10)"""


MINIMAL = "[a-z][a-z0-9-]*|[가-힣]+|[0-9]+(?:\\.[0-9]+)?"

SQL_GOLD = f"""
gold AS (
  SELECT DISTINCT query_id, chunk_id FROM
    (SELECT item_id AS query_id, unnest({sql_sentences("text")}) AS s FROM benchmark) q JOIN
    (SELECT doc_id AS chunk_id, unnest({sql_sentences("text")}) AS s FROM documents) d USING (s) WHERE length(s) > 20)"""


def sql_metrics(ranking: str, name: str = "met") -> str:
    """CTE {name}: the metrics of each question with gold."""
    cut = (1, 3, 5, 10)
    m = ", ".join(f"count(*) FILTER (rank <= {k} AND g.chunk_id IS NOT NULL) AS m{k}, count(*) FILTER (rank <= {k}) AS r{k}" for k in cut)
    out = ", ".join([f"(coalesce(m{k}, 0) > 0)::INT::DOUBLE AS hit_at_{k}" for k in cut] + ["round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr"] + [f"round(coalesce(m{k}, 0) / gold_n, 6)::DOUBLE AS recall_at_{k}" for k in cut] + [f"round(coalesce(m{k} / nullif(r{k}, 0), 0), 6)::DOUBLE AS precision_at_{k}" for k in cut])
    return f"""
{name} AS (
  SELECT t.query_id, {out}
  FROM (SELECT query_id, count(*) AS gold_n FROM gold GROUP BY query_id) t LEFT JOIN
    (SELECT r.query_id, {m}, min(rank) FILTER (g.chunk_id IS NOT NULL) AS first
     FROM {ranking} r LEFT JOIN gold g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id GROUP BY r.query_id) x USING (query_id))"""
