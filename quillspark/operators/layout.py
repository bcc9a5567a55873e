"""Page layout from positioned words: lines, blocks, table grids, the text of a page, and records of its tables.

Words come as page, text, x0, x1, top, bottom (doubles, y grows downwards), in any order. All steps after the first exchange
keep to a page, whose words are bounded by what fits on a sheet, so pages are the unit that is spread over a cluster.

Words without a page, a text that isn't blank or all four coordinates take no part. Repeated words stay; ties are ordered by
their text. A page without words gives no row, tables without rows give empty results, other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import lexical_tokens

#: Words belong to one line while their tops differ by this much or less from one to the next.
LINE_STEP = 3.0
#: A wider gap between words of a line begins another segment.
SEGMENT_GAP = 9.0
#: A wider gap between lines begins another block.
BLOCK_GAP = 8.0
#: How far below a grid without body rows its text is looked for.
REGION = 300.0


def lines(words: DataFrame) -> DataFrame:
    """page, line, top, bottom, segments, block, is_table: lines from above, each with its segments from the left.

    A block is a table if its first line has two segments or more.
    """
    held = words.filter((F.trim("text") != "") & F.expr("page IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL"))
    down = Window.partitionBy("page").orderBy("top", "x0", "x1", "text")
    placed = held.select("page", "text", "x0", "x1", "top", "bottom").withColumn("step", F.coalesce((F.col("top") - F.lag("top").over(down) > LINE_STEP).cast("int"), F.lit(0)))
    placed = placed.withColumn("line", F.sum("step").over(down))
    across = Window.partitionBy("page", "line").orderBy("x0", "x1", "text")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("step", F.coalesce((F.col("x0") - reach > SEGMENT_GAP).cast("int"), F.lit(0))).withColumn("segment", F.sum("step").over(across))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    segments = placed.groupBy("page", "line", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), joined.alias("text"))
    rows = segments.groupBy("page", "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.struct("segment", "x0", "x1", "text"))).alias("segments"))
    below = Window.partitionBy("page").orderBy("line")
    rows = rows.withColumn("step", F.coalesce((F.col("top") - F.lag("bottom").over(below) > BLOCK_GAP).cast("int"), F.lit(0))).withColumn("block", F.sum("step").over(below))
    first = F.first(F.size("segments")).over(Window.partitionBy("page", "block").orderBy("line"))
    return rows.select("page", "line", "top", "bottom", "segments", "block", (first >= 2).alias("is_table"))


def cells(rows: DataFrame) -> DataFrame:
    """page, block, row, col, span, width, x0, x1, top, bottom, text: the cells of the tables among lines().

    The lines with the most segments set the columns: segments that overlap from one such line to another share one. Any other
    segment stands in the first column that doesn't end before it, and spans all that it overlaps.
    """
    whole = Window.partitionBy("page", "block")
    tables = rows.filter("is_table").select("page", "block", (F.col("line") - F.min("line").over(whole)).alias("row"), "top", "bottom", "segments", F.max(F.size("segments")).over(whole).alias("most"))
    grid = tables.filter(F.size("segments") == F.col("most")).select("page", "block", F.explode("segments").alias("s")).select("page", "block", "s.x0", "s.x1")
    across = Window.partitionBy("page", "block").orderBy("x0", "x1")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("step", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(0))).withColumn("col", F.sum("step").over(across))
    columns = grid.groupBy("page", "block", "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).groupBy("page", "block").agg(F.collect_list(F.struct("x0", "x1")).alias("columns"))
    found = tables.select("page", "block", "row", "top", "bottom", F.explode("segments").alias("s")).join(columns, ["page", "block"])
    width = F.size("columns")
    col = F.least(F.size(F.filter("columns", lambda c: c["x1"] < F.col("s.x0"))) + 1, width)
    span = F.greatest(F.size(F.filter("columns", lambda c: (c["x0"] < F.col("s.x1")) & (c["x1"] > F.col("s.x0")))), F.lit(1))
    found = found.select("page", "block", "row", col.alias("col"), span.alias("span"), width.alias("width"), "s.x0", "s.x1", "top", "bottom", "s.text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return found.groupBy("page", "block", "row", "col", "width").agg(F.max("span").alias("span"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), joined.alias("text"))


def table_rows(found: DataFrame) -> DataFrame:
    """page, block, row, cells, x0, x1, top, bottom: rows of all columns, empty where a row has no cell of its own."""
    own = found.groupBy("page", "block", "row", "width").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("of"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    each = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.try_element_at("of", c), F.lit("")))
    return own.select("page", "block", "row", each.alias("cells"), "x0", "x1", "top", "bottom")


def page_text(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """page, text: blocks from above; lines outside tables are one paragraph until a table comes, a table is one of its own."""
    start = F.min("line").over(Window.partitionBy("page", "block"))
    marked = rows.withColumn("row", F.col("line") - start)
    told = marked.join(grid.select("page", "block", "row", F.array_join("cells", " | ").alias("told")), ["page", "block", "row"], "left")
    plain = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    told = told.select("page", "line", F.when(F.col("is_table"), F.col("block")).otherwise(-1).alias("kind"), F.coalesce("told", plain).alias("text"))
    below = Window.partitionBy("page").orderBy("line")
    told = told.withColumn("step", F.coalesce((F.col("kind") != F.lag("kind").over(below)).cast("int"), F.lit(0))).withColumn("run", F.sum("step").over(below))

    def joined(order: str, apart: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), apart)

    return told.groupBy("page", "run").agg(joined("line", "\n").alias("text")).groupBy("page").agg(joined("run", "\n\n").alias("text"))


def table_tokens(text: Column) -> Column:
    """The distinct words and numbers of a table's text."""
    return F.array_distinct(F.concat(lexical_tokens(text), F.regexp_extract_all(text, F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0))))


def records(rows: DataFrame, grid: DataFrame, chunks: DataFrame) -> DataFrame:
    """page, block, mode, row, text, chunks: what is kept of each table, with the positions of the chunks that it comes from.

    chunks: page, position, parent, text; those with a body of their own. Mode `cells`: each body row that isn't empty, linked
    to the chunks of its page that share at least a quarter of the best share of its tokens, or else to those of the whole
    table, or else to all of the page. Mode `fallback`, for a table of a header alone or a sparse one (three body rows or
    more, three quarters of which have one cell or none): the chunks of the parent with the largest share of its tokens, half
    at least, in the region of the table; of equal parents the first. A table that has neither chunks nor rows is left out.
    """
    at = ["page", "block"]
    filled = F.size(F.filter("cells", lambda c: c != ""))
    body = F.col("row") > 0
    shape = grid.groupBy(*at).agg(
        F.count_if(body).alias("body"),
        F.count_if(body & (filled <= 1)).alias("thin"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("top").alias("top"),
        F.max("bottom").alias("bottom"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.array_join(r["cells"], " ")), " ").alias("whole"),
    )
    thin = (F.col("body") == 0) | ((F.col("body") >= 3) & (F.col("thin") * 4 >= F.col("body") * 3))
    shape = shape.withColumn("thin", thin)
    known = chunks.select("page", "position", "parent", F.col("text").alias("chunk_text"), table_tokens(F.col("text")).alias("tokens"))

    # By cells: shares of tokens of rows and of whole tables, counted together; row -1 stands for the table.
    full = shape.filter(~F.col("thin"))
    own = grid.filter(body & (filled > 0)).join(full.select(*at), at).select(*at, "row", F.array_join(F.filter("cells", lambda c: c != ""), " ").alias("text"))
    asked = own.unionByName(full.select(*at, F.lit(-1).alias("row"), F.col("whole").alias("text")))
    shared = asked.select(*at, "row", F.explode(table_tokens(F.col("text"))).alias("t")).join(known.select("page", "position", F.explode("tokens").alias("t")), ["page", "t"]).groupBy(*at, "row", "position").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy(*at, "row"))
    linked = shared.withColumn("best", best).filter(F.col("n") * 4 >= F.col("best")).groupBy(*at, "row").agg(F.array_sort(F.collect_list("position")).alias("chunks"))
    all_of = known.groupBy("page").agg(F.array_sort(F.collect_list("position")).alias("any"))
    of_table = linked.filter("row = -1").select(*at, F.col("chunks").alias("table_chunks"))
    by_cells = own.join(linked, [*at, "row"], "left").join(of_table, at, "left").join(all_of, "page")
    by_cells = by_cells.select(*at, F.lit("cells").alias("mode"), "row", "text", F.coalesce("chunks", "table_chunks", "any").alias("chunks"))

    # By region: the text from the table down, as wide as it, against the chunks of each parent.
    sparse = shape.filter("thin").select(*at, "x0", "x1", "top", (F.col("bottom") + REGION).alias("down"))
    pieces = rows.select("page", F.col("top").alias("y0"), F.col("bottom").alias("y1"), F.explode("segments").alias("s"))
    inside = sparse.join(pieces, "page").filter((F.col("y0") >= F.col("top")) & (F.col("y1") <= F.col("down")) & (F.col("s.x0") <= F.col("x1")) & (F.col("s.x1") >= F.col("x0")))
    region = inside.select(*at, F.explode(table_tokens(F.col("s.text"))).alias("t")).distinct()
    parents = known.groupBy("page", "parent").agg(F.count("*").alias("members"), F.min("position").alias("first")).filter("members >= 2")
    held = known.join(parents, ["page", "parent"]).select("page", "parent", "first", F.explode("tokens").alias("t")).distinct()
    size = held.groupBy("page", "parent", "first").agg(F.count("*").alias("size"))
    met = region.join(held, ["page", "t"]).groupBy(*at, "parent").agg(F.count("*").alias("n")).join(size, ["page", "parent"]).filter(F.col("n") * 2 >= F.col("size"))
    chosen = met.groupBy(*at).agg(F.max_by("parent", F.struct(F.col("n") / F.col("size"), -F.col("first"))).alias("parent"))
    nth = F.row_number().over(Window.partitionBy(*at).orderBy("position"))
    by_region = chosen.join(known, ["page", "parent"]).select(*at, F.lit("fallback").alias("mode"), nth.alias("row"), F.col("chunk_text").alias("text"), F.array("position").alias("chunks"))
    return by_cells.unionByName(by_region)
