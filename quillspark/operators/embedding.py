"""Vectors of texts by any vectoriser, in batches that a run can resume.

A vectoriser is made anew in each task: make() gives a function from a list of texts to a matrix with a row for each. The
default hashes words and runs of three letters to signed places, so that it needs no model and gives the same everywhere.
Rows are dealt to batches by their id. A batch is written whole or not at all; a run skips the batches that are there, so
that one that broke off goes on where it stopped and ends with the rows of an unbroken run. Batches of other vectorisers or
numbers of batches have folders of their own. Null text is empty; a text without words has the zero vector.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Vectoriser(Protocol):
    """name: tells what it gives apart from what others give; dims: the length of its vectors."""

    name: str
    dims: int

    def make(self) -> Callable[[list[str]], np.ndarray]: ...


@dataclass(frozen=True)
class Hashing:
    dims: int = 384

    @property
    def name(self) -> str:
        return f"hashing-{self.dims}"

    def make(self) -> Callable[[list[str]], np.ndarray]:
        dims = self.dims

        def vectors(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for k, text in enumerate(texts):
                words = _WORD.findall(text.lower())
                features = [f for w in words for f in (w, *(f"{w[i:i + 3]}#" for i in range(len(w) - 2)))]
                if features:
                    h = np.array([xxhash.xxh64_intdigest(f) for f in features], np.uint64)
                    np.add.at(out[k], (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63) == 1, -1.0, 1.0))
                    if not out[k].any():  # all features cancelled out
                        out[k, int(h[0] % np.uint64(dims))] = 1.0
            size = np.sqrt((out * out).sum(1, keepdims=True))
            return np.divide(out, size, out=out, where=size > 0)

        return vectors


def vectors_of(rows: DataFrame, id_: str, text: str, by: Vectoriser) -> DataFrame:
    """id and v, of rows."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = by.make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = np.asarray(work([t or "" for t in part.column(1).to_pylist()]), np.float64)
                if made.shape != (part.num_rows, by.dims):
                    raise ValueError(f"{by.name} gave {made.shape}, not {(part.num_rows, by.dims)}")
                values = pa.ListArray.from_arrays(np.arange(0, made.size + 1, by.dims, dtype=np.int32), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=[id_, "v"])

    return rows.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, v array<double>")


def embed(rows: DataFrame, id_: str, text: str, by: Vectoriser, store: str, batches: int = 16) -> DataFrame:
    """id and v of all rows, from the batches in the store; those that aren't there yet are made first."""
    spark = rows.sparkSession
    folder = f"{store}/{by.name}-{batches}"
    for k in range(batches):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch-{k}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            part = rows.filter(F.pmod(F.xxhash64(id_), F.lit(batches)) == k)
            vectors_of(part, id_, text, by).write.mode("overwrite").parquet(f"{folder}/batch-{k}")
    return spark.read.parquet(*[f"{folder}/batch-{k}" for k in range(batches)])
