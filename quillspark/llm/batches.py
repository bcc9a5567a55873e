"""Arrow batches of texts: cut to a size in bytes, so that a task's memory doesn't follow the number of rows in a batch."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a kernel works on at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch with about `most` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 16
    yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def append_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes | None]], list]], fields: list[T.StructField], most: int = SLICE_BYTES) -> DataFrame:
    """df with more columns, made from its text column.

    make() runs once in a task; what it returns gets texts as UTF-8 bytes (or None) and returns one list or array a field.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text)
    names = [*df.columns, *[f.name for f in fields]]
    arrow = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at, most):
                made = work(as_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, type=t) for x, t in zip(made, arrow, strict=True)]], names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def worker_cache(key: object, make: Callable[[], object], most: int = 4) -> object:
    """make()'s result, kept in the Python worker for its next tasks; the oldest of more than `most` go."""
    held = sys.modules.setdefault("_quillspark_worker_cache", types.ModuleType("_quillspark_worker_cache")).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) >= most:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]
