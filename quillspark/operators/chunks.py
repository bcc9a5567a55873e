"""Documents into blocks and chunks, and the state of a corpus of chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def line_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-empty lines in order, each with the one before and after."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(lines).alias("n"), F.posexplode(lines).alias("idx", "text"))
    return rows.select("doc_id", "idx", F.when(F.col("idx") > 0, F.col("idx") - 1).alias("prev_idx"), F.when(F.col("idx") < F.col("n") - 1, F.col("idx") + 1).alias("next_idx"), "text")


def stride_chunks(docs: DataFrame, size: int = 110, overlap: int = 20) -> DataFrame:
    """Windows of `size` words that share `overlap` words with the next; doc_id, idx, text."""
    words = F.split(X.clean(F.col("text")), " ")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0)))
    rows = docs.select("doc_id", words.alias("w")).select("doc_id", "w", F.explode(starts).alias("idx"))
    return rows.select("doc_id", "idx", F.array_join(F.slice("w", F.col("idx") * step + 1, F.lit(size)), " ").alias("text"))


def semantic_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, ordinal, section, text. Blank lines, headings and table paragraphs start blocks; a heading lasts to the end of the page.

    pages: doc_id, text. All within a document's own rows: arrays of lines are folded, nothing is shuffled.
    """
    paragraphs = F.split("text", "\n\n")
    state = "struct<section:string,out:array<struct<section:string,text:string>>>"
    start = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,text:string>>").alias("out")).cast(state)

    def block(section: Column, text: Column) -> Column:
        return F.array(F.struct(section.alias("section"), text.alias("text")))

    def paragraph(acc: Column, p: Column) -> Column:
        lines = F.split(p, "\n")
        inner = F.struct(acc["section"].alias("section"), F.lit(None).cast("string").alias("buffer"), acc["out"].alias("out"))

        def line(a: Column, x: Column) -> Column:
            heading = X.looks_like_heading(x)
            return F.when(
                heading,
                F.struct(F.trim(x).alias("section"), x.alias("buffer"), F.when(a["buffer"].isNotNull(), F.concat(a["out"], block(a["section"], a["buffer"]))).otherwise(a["out"]).alias("out")),
            ).otherwise(F.struct(a["section"].alias("section"), F.when(a["buffer"].isNull(), x).otherwise(F.concat_ws("\n", a["buffer"], x)).alias("buffer"), a["out"].alias("out")))

        folded = F.aggregate(lines, inner, line)
        plain = F.struct(folded["section"].alias("section"), F.when(folded["buffer"].isNotNull(), F.concat(folded["out"], block(folded["section"], folded["buffer"]))).otherwise(folded["out"]).alias("out"))
        table = F.struct(acc["section"].alias("section"), F.concat(acc["out"], block(acc["section"], p)).alias("out"))
        return F.when(F.contains(p, F.lit(" | ")), table).otherwise(plain)

    blocks = F.aggregate(paragraphs, start, paragraph, lambda a: a["out"])
    rows = pages.select("doc_id", F.posexplode(F.transform(blocks, lambda b: F.struct(b["section"].alias("section"), F.trim(b["text"]).alias("text")))).alias("p", "b"))
    return rows.select("doc_id", (F.col("p") + 1).alias("ordinal"), F.col("b.section").alias("section"), F.col("b.text").alias("text"))


#: Where a text is cut, the strongest first; '' is between any two characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def word_count(text: str) -> int:
    return len(text.split())


def _cut(text: str, size: int, separators: tuple[str, ...], length: Callable[[str], int]) -> Iterator[str]:
    """Pieces under size, cut at the strongest separator that helps; a separator stays at the head of what follows."""
    strongest = next((k for k, x in enumerate(separators) if x == "" or x in text), len(separators))
    if strongest == len(separators):
        yield text
        return
    mark, weaker = separators[strongest], separators[strongest + 1 :]
    first, *rest = text.split(mark) if mark else list(text) or [""]
    for piece in [first, *[mark + x for x in rest]]:
        if piece and (length(piece) < size or not weaker):
            yield piece
        elif piece:
            yield from _cut(piece, size, weaker, length)


def split_recursively(text: str, size: int = 110, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = word_count) -> list[str]:
    """Pieces joined up to size; a chunk begins with the last pieces of the one before, up to overlap."""
    out: list[str] = []
    held: deque[tuple[str, int]] = deque()
    total = fresh = 0

    def close() -> None:
        if fresh and (chunk := "".join(p for p, _ in held).strip()):
            out.append(chunk)

    for piece in _cut(text, size, separators, length):
        n = length(piece)
        if held and total + n > size:
            close()
            fresh = 0
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((piece, n))
        total += n
        fresh += 1
    close()
    return out


def recursive_chunks(docs: DataFrame, size: int = 110, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = word_count) -> DataFrame:
    """doc_id, idx, text: recursive splitting of docs (doc_id, text), with any measure of length, such as a model's tokens."""

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = split_recursively(text or "", size, overlap, separators, length)
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int64()), pa.array(chunks, pa.string())], names=["doc_id", "idx", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, idx long, text string")


def quality(chunks: DataFrame, key: str, tokens: Callable[[Column], Column], most: int = 110) -> DataFrame:
    """Empty, over-long and duplicate chunks, and the longest, by key."""
    norm = F.lower(X.clean(F.col("text")))
    n = F.size(tokens(F.col("text")))
    return chunks.groupBy(key).agg(F.count_if(norm == "").alias("empty_n"), F.count_if(n > most).alias("over_limit_n"), (F.count_if(norm != "") - F.count_distinct(F.when(norm != "", norm))).alias("duplicate_n"), F.max(n).cast("long").alias("max_tokens"))


def edge_labels(pages: DataFrame, document: str = "source", page: str = "doc_id") -> DataFrame:
    """Short lines among the first or last three of two pages or more of a document."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edges = F.array_distinct(F.concat(F.slice("ls", 1, 3), F.slice("ls", F.greatest(F.size("ls") - 2, F.lit(1)), F.lit(3))))
    rows = pages.select(document, page, lines.alias("ls")).select(document, page, F.explode(edges).alias("label")).filter(X.page_label_candidate(F.col("label")))
    return rows.groupBy(document, "label").agg(F.count_distinct(page).alias("pages")).filter("pages >= 2")


def running_headers(pages: DataFrame, document: str = "source") -> DataFrame:
    """Whether the first line of a page is a header that other pages of its document have too."""
    rows = pages.select(document, "doc_id", F.coalesce(F.try_element_at(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit("")).alias("first"))
    shaped = rows.withColumn("shape", X.looks_like_running_header(F.col("first")))
    counts = shaped.filter("shape").groupBy(document, F.lower("first").alias("low")).agg(F.count("*").alias("n")).filter("n >= 2")
    return shaped.withColumn("low", F.lower("first")).join(counts, [document, "low"], "left").select(document, "doc_id", (F.col("shape") & F.col("n").isNotNull()).alias("is_header"))


def inherited_titles(chunks: DataFrame) -> DataFrame:
    """For each body chunk the titles since the body chunk before, joined. chunks: doc_id, idx, text, is_title."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    body = ~F.col("is_title")
    island = chunks.withColumn("consumer", F.min(F.when(body, F.col("idx"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    titles = island.filter("is_title AND consumer IS NOT NULL").groupBy("doc_id", F.col("consumer").alias("idx")).agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])), " ").alias("inherited"))
    return chunks.filter(body).join(titles, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("inherited", F.lit("")).alias("inherited"))


def statistics(chunks: DataFrame, key: str, tokens: Callable[[Column], Column]) -> DataFrame:
    n = F.size(tokens(F.col("text")))
    norm = X.clean(F.col("text"))
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if(norm == "").alias("empty_n"), F.count_if(F.length(norm) < 8).alias("short_n"), F.min(n).cast("long").alias("min_tokens"), F.round(F.avg(n), 3).alias("avg_tokens"), F.max(n).cast("long").alias("max_tokens"))


def linked_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Table rows to chunks of their page by shared tokens: those with a quarter of the best share or more.

    rows: page, row_id, tokens; chunks: page, chunk_id, tokens.
    """
    r = rows.select("page", "row_id", F.explode(F.array_distinct("tokens")).alias("t"))
    c = chunks.select("page", "chunk_id", F.explode(F.array_distinct("tokens")).alias("t"))
    shared = r.join(c, ["page", "t"]).groupBy("page", "row_id", "chunk_id").agg(F.count("*").alias("overlap"))
    best = shared.withColumn("best", F.max("overlap").over(Window.partitionBy("page", "row_id")))
    return best.filter(F.col("overlap") >= F.greatest(F.lit(1), F.ceil(F.col("best") * 0.25))).select("page", "row_id", "chunk_id", "overlap")
