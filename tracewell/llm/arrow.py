"""Arrow-batch plumbing shared by the operators that run Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell import session
from tracewell.session import ship_package


SLICE_BYTES = 4 << 20  # what fn sees at once, give or take one long row


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batch in parts of about `most` bytes of text."""
    if not batch.num_rows:
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def give_back() -> None:
    """Returns a finished task's free memory to the system: workers live on, and several stand beside one JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def stash(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """session.stash(), written by Python workers where that is lighter."""
    return session.stash(df, name, parts, by_workers=True)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow() whose result stash() can write in the worker that makes it."""
    out = df.mapInArrow(run, schema)
    out._tracewell_rows = (df, run)
    return out


def map_rows(df: DataFrame, fn: Callable[[dict[str, list], dict], dict[str, list]], schema: T.StructType | str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Applies fn to each Arrow batch as lists by column (and a state dict that lives as long as the task); fn returns lists by column."""
    ship_package(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in (part for whole in batches for part in slices(whole, slice_bytes)):
            out = fn({name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}, state)
            if out and len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            out = batch = None
        give_back()

    return map_batches(df, run, schema)
