"""An inverted file of vectors for cosine search: cells around centroids, of which a search probes a few, or as many as it must.

Centroids are fitted by spherical k-means on a bounded sample: the SAMPLE rows with the least hash of their id. Every row is
stored, in the cell of the centroid with the largest cosine. A rebuild stores rows in batches and holds the number stored
against the number expected after each; a difference is an error. A cell of many rows is dealt out over several groups of
at most GROUP rows or so, each of which meets the cell's questions.

A search probes the cells nearest to a question, a share of all. An exact search goes on: with the angle between a question
and a centroid, less the widest angle of a row of that cell, no row of the cell can be nearer; cells that could hold a row
as good as the question's k-th best are probed as well, so that no row of the exact ranking is lost.

Scores are rounded to 6 decimals, ties go to the smaller id. Rows with a null id or vector, or a component that is null or
not finite, take no part; all vectors must have the length of the centroids, others are not stored. A zero vector has the
cosine 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.vectors import best_of, finite, matrices
from quillspark.session import Written, spread

#: Rows of the sample, rounds of k-means, cells at most, the share of cells that a search probes, rows of a group.
SAMPLE, ROUNDS, CELLS, PROBES, GROUP = 16_384, 8, 4096, 0.6, 8192


class Index:
    """The stored batches, the centroids, and for each cell its rows and the least cosine to its centroid."""

    def __init__(self, batches: list[tuple[int, int, Written]], centroids: np.ndarray) -> None:
        self.batches, self.centroids = batches, centroids
        self.spark = batches[0][2].spark

    def rows(self) -> DataFrame:
        out = self.batches[0][2].read()
        for _, _, more in self.batches[1:]:
            out = out.unionByName(more.read())
        return out


def unit(matrix: np.ndarray) -> np.ndarray:
    size = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample; an empty cell keeps its centroid."""
    x = unit(sample)
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = (total * total).sum(1) > 0
        c[some] = unit(total[some])
    return c


def build(vectors: DataFrame, cells: int | None = None, batches: int = 1, sample: int = SAMPLE) -> Index:
    """The index of vectors (chunk_id, v). cells: the square root of the rows, CELLS at most."""
    own = finite(vectors, "chunk_id", "v")
    some = own.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
    dims = len(some[0]["v"]) if some else 0
    n = own.count()
    k = max(1, min(cells or int(n**0.5), CELLS, len(some)))
    c = centroids_of(np.array([r["v"] for r in some if len(r["v"]) == dims]).reshape(-1, dims), k) if some else np.zeros((1, 0))
    fits = own.filter(F.size("v") == dims)
    stored, seen = [], 0
    for batch in range(batches):
        part = fits.filter(F.pmod("id", F.lit(batches)) == batch)
        expected = part.count()
        table = Written(_placed(spread(part), c).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "inverted-file")
        seen += expected
        stored.append((batch, expected, table))
        held = Index(stored, c).rows().count()
        if held != seen:
            raise ValueError(f"{held} vectors are stored after batch {batch}, {seen} were expected")
    return Index(stored, c)


def rebuilt(index: Index) -> DataFrame:
    """batch, expected, stored: what each batch should have stored and how many rows the index held after it."""
    held = index.spark.createDataFrame([(b, n) for b, n, _ in index.batches], "batch long, expected long")
    counts = [t.read().agg(F.count("*").alias("n")).select(F.lit(b).cast("long").alias("batch"), "n") for b, _, t in index.batches]
    every = counts[0]
    for x in counts[1:]:
        every = every.unionByName(x)
    return held.join(every, "batch").select("batch", "expected", F.sum("n").over(Window.orderBy("batch")).alias("stored"))  # a row for each batch


def _placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cell, near (the cosine to its centroid), id and v (of unit length) of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, ids, matrix in matrices(batch):
                x = unit(matrix)
                near = x @ centroids.T
                cell = near.argmax(1)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(x)), cell]), pa.array(ids), values], names=["cell", "near", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "cell int, near double, id long, v array<double>")


def _asked(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, v of unit length and, for each cell, the cosine to its centroid and its place in the question's order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for batch in batches:
            for dims, _, ids, matrix in matrices(batch):
                if dims == centroids.shape[1]:
                    near = unit(matrix) @ centroids.T
                    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
                    for at in range(len(ids)):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, ids[at])), pa.array(np.arange(k, dtype=np.int32)), pa.array(near[at]), pa.array(place[at].astype(np.int32))], names=["query_id", "cell", "toward", "place"])

    return queries.mapInArrow(run, "query_id long, cell int, toward double, place int")


def _probed(index: Index, wanted: DataFrame, k: int, cells: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: the best k of each question among the cells wanted for it (query_id, q, cell)."""
    parts = F.ceil(F.col("n") / F.lit(GROUP)).cast("long")
    sizes = cells.select("cell", parts.alias("parts"))
    rows = index.rows().join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "v")  # CELLS rows at most
    asked = wanted.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("query_id").alias("id"), F.col("q").alias("v"))

    def match(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            (_, _, ids, x), (_, _, asked_ids, q) = (next(matrices(t.combine_chunks().to_batches()[0], 2, 3)) for t in (left, right))
            step = max(1, (4 << 20) // len(ids))
            parts_ = []
            for at in range(0, len(asked_ids), step):
                score = np.round(unit(q[at : at + step]) @ unit(x).T, 6) + 0.0
                place, col = (z.ravel() for z in np.indices(score.shape))
                keep = best_of(place, score.ravel(), ids[col], k)
                parts_.append((asked_ids[at + place[keep]], ids[col[keep]], score.ravel()[keep]))
            out = [np.concatenate(z) for z in zip(*parts_, strict=True)]
        return pa.table([pa.array(z) for z in out], names=["query_id", "chunk_id", "score"])

    return rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(match, "query_id long, chunk_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, probes: float = PROBES, exact: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best of each question. queries: query_id, q. probes: the share of cells."""
    own = finite(queries, "query_id", "q")
    cells = Written(index.rows().groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")), "inverted-cells").read()
    order = Written(_asked(own, index.centroids), "inverted-order").read()
    first = max(1, round(probes * len(index.centroids)))
    q = own.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    if not exact:
        return _ranked(_probed(index, order.filter(F.col("place") < first).join(q, "query_id").select("query_id", "q", "cell"), k, cells), k)
    first = max(1, round(len(index.centroids) ** 0.5))
    found = Written(_ranked(_probed(index, order.filter(F.col("place") < first).join(q, "query_id").select("query_id", "q", "cell"), k, cells), k), "inverted-first").read()
    bar = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("bar"))
    clip = lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    reach = F.cos(F.greatest(F.lit(0.0), clip(F.col("toward")) - clip(F.col("least"))))
    # Zero vectors lie at no angle: a cell that holds one can have the score 0.
    able = F.when(F.col("least") <= 0, F.greatest(reach, F.lit(0.0))).otherwise(reach) >= F.col("bar") - 1e-5
    more = order.filter(F.col("place") >= first).join(F.broadcast(cells), "cell").join(bar, "query_id", "left").filter(able | F.col("bar").isNull())
    rest = _probed(index, more.join(q, "query_id").select("query_id", "q", "cell"), k, cells)
    return _ranked(found.select("query_id", "chunk_id", "score").unionByName(rest), k)
