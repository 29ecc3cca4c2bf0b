"""Tables, shared scratch tables and Arrow batch slicing for the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import scratch_path

#: Text handed to one numpy pass, in bytes; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a
    lost executor costs no recomputation of what stands before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not yet used in ``df`` (case-insensitively), for working columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add: its own replace them."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def worker_state(key: str, make: Callable):
    """A value kept for the life of a Python worker, across its tasks.

    Task code is shipped by value, so its own module globals do not outlive
    a task; the store is therefore hung into ``sys.modules``.
    """
    store = sys.modules.setdefault("_murmur_worker_state", types.ModuleType("_murmur_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of a string column: about ``limit`` bytes and at most ``rows`` rows each."""
    sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
    start, held = 0, 0.0
    for i, size in enumerate(sizes):
        if i > start and (held + size > limit or i - start >= rows):
            yield start, i
            start, held = i, 0.0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def per_slice(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema, text: str = "text",
              limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Callable:
    """A ``mapInArrow`` function that applies ``fn`` to byte-bounded slices of
    each batch; ``fn`` returns the output columns of the slice's rows."""

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(text), limit, rows):
                cols = fn(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                     for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)

    return run


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8_size(col) -> F.Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
