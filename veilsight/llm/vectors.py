"""Vectors as whole numbers, in rows that hold bytes.

A vector that is null, or that holds a null, NaN or infinite component, is left out.  Of the others each component x
becomes floor(scale * x), x as double; what a long can't hold saturates at its ends.  Vectors
shorter than the longest one count as padded with zeros; an empty vector is all zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Whether neither the vector nor a component is null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(False))


def floors(vector: str | Column, scale: int) -> Column:
    """floor(scale * component) of each component, as array of longs."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column of longs as a matrix, padded with zeros to ``dim`` (or the longest)."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    dim = int(lengths.max(initial=0)) if dim is None else dim
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def packed(column: pa.Array, kind: type) -> tuple[pa.Array, pa.Array]:
    """Lengths and little-endian bytes of each row of a list column of longs, saturated to ``kind``."""
    ends = np.iinfo(kind)
    flat = np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), ends.min + 1, ends.max).astype(np.dtype(kind).newbyteorder("<"))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(lengths))) * flat.itemsize
    return pa.array(lengths.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


def unpacked(column: pa.Array, dim: int, kind: type, limit: int | None = None) -> np.ndarray:
    """The matrix of longs that ``packed`` wrote, padded with zeros to ``dim`` and saturated at ``limit``."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(column.to_pylist()), np.dtype(kind).newbyteorder("<")).astype(np.int64)
    if limit is not None:
        flat = np.clip(flat, -limit, limit)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def limit(dim: int, factor: int = 1) -> int:
    """The largest magnitude m for which dim * (factor * m)**2 fits a long: components saturate there."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // max(dim, 1)) // factor)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield _one(held)
                held, n = [], 0
    if n:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], names=held[0].schema.names)


def pack_table(df: DataFrame, keep: list[str], vector: str, scale: int) -> DataFrame:
    """``keep``'s columns as c0, c1, ... with n (components) and x (int32 bytes) of each usable vector; not written yet."""
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(vector).alias("v")).where(usable("v")).withColumn("v", floors("v", scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x = packed(b.column(len(keep)), np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), n, x], names=[*(f"c{i}" for i in range(len(keep))), "n", "x"])

    fields = [StructField(f"c{i}", rows.schema[f"c{i}"].dataType) for i in range(len(keep))]
    return rows.mapInArrow(run, StructType([*fields, StructField("n", IntegerType()), StructField("x", BinaryType())]))
