"""Small helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text handled at a time inside a task, in UTF-8 bytes.
CHUNK_BYTES = 2 << 20


def with_new(df: DataFrame, *fields: tuple[str, T.DataType], drop: tuple[str, ...] = ()) -> T.StructType:
    """The schema of ``df`` without ``drop`` plus new nullable fields (replacing equal names)."""
    gone = {n.lower() for n, _ in fields} | {d.lower() for d in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    return T.StructType(kept + [T.StructField(n, t, True) for n, t in fields])


def appended(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """Columns of ``batch`` in the order of ``schema``, new ones from ``new``."""
    names = schema.names
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text (a longer text alone)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column, null as empty."""
    values = batch.column(column)
    if not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [v or b"" for v in values.to_pylist()]
