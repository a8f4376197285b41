"""Whitening of vectors by a QR factorization that is merged as a tree.

Entries are whole numbers, so sums are exact and rows are centred by them: (n * x - S) / n.  Each task
folds its rows into one triangular factor; factors are merged sixteen at a time, round by round, until one is
left.  The right singular vectors of that one are the components, and its singular values their
spreads; no covariance is formed.

The driver gets numbers by dimension alone: sums, the last factor and the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import store, vectors

SCALE, COMPONENTS = 256, 4
#: Factors merged by one task in a round.
FAN = 16
#: Rows that a task folds in at once.
ROWS = 1 << 14


class Model(NamedTuple):
    """Sums and number of the distinct vectors, components as columns, standard deviations (0: none), and the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    spread: np.ndarray
    trace: float


def _canonical(x: np.ndarray) -> list[bytes]:
    """Little-endian bytes of each row without the zeros at its end, so that padding makes no difference."""
    last = np.where((x != 0).any(1), x.shape[1] - np.argmax((x != 0)[:, ::-1], axis=1), 0) if x.shape[1] else np.zeros(len(x), int)
    return [r[:k].tobytes() for r, k in zip(x.astype("<i8"), last, strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n from the exact whole numbers n * x - S."""
    top = n * max(1, int(np.abs(x.astype(object)).max(initial=0))) + max(map(abs, sums), default=0)
    if top < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array((x.astype(object) * n - np.array(sums, object)) / n, np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over dimensions of (n * x - S)^2, exact, and whether it fits a long."""
    top = n * max(1, int(np.abs(x.astype(object)).max(initial=0))) + max(map(abs, sums), default=0)
    if top * top * max(1, x.shape[1]) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1), np.ones(len(x), bool)
    d = x.astype(object) * n - np.array(sums, object)
    exact = (d * d).sum(1)
    fits = np.array([v < 1 << 63 for v in exact], bool)
    return np.where(fits, exact, 0).astype(np.int64), fits


def _fold(rows: np.ndarray, r: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def _distinct(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Each distinct vector of whole numbers once, as bytes, with its length."""
    rows = df.select(F.col(vector).alias("v")).where(vectors.usable("v")).select(vectors.floors("v", scale).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.full(b.num_rows, 0, np.int32)
            x = vectors.matrix(b.column(0))
            n[:] = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(_canonical(x), pa.binary())], names=["n", "x"])

    # partial aggregation drops a vector's copies in each task before they are shuffled
    return rows.mapInArrow(run, "n int, x binary").groupBy("x").agg(F.max("n").alias("n"))


def _sums(fit: DataFrame, dim: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in vectors.gathered(batches, ROWS):
            x = vectors.unpacked(b.column(0), dim, np.int64)
            low, high = x & 0xFFFFFFFF, x >> 32  # neither sum can leave a long
            total = [t + int(h) * (1 << 32) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * dim
    for r in rows:  # one row a dimension
        out[r["i"]] = int(r["s"])
    return out


def _last_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows."""
    dim = len(sums)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in vectors.gathered(batches, ROWS):
            r = _fold(centred(vectors.unpacked(b.column(0), dim, np.int64), n, sums), r)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for raw in table.sort_by("node").column("r").to_pylist():  # FAN factors at most
            r = _fold(np.frombuffer(raw).reshape(-1, dim), r)
        return pa.table({"node": pa.array([table.column("node")[0].as_py() // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = store.table(fit.select("x").mapInArrow(leaf, "node long, r binary"), "factors")
    top = factors.agg(F.max("node")).first()[0]
    while top:
        factors, before = store.table(factors.groupBy(F.floor(F.col("node") / FAN).cast("long")).applyInArrow(merge, "node long, r binary"), "factors"), factors
        store.drop(before)
        top //= FAN
    return np.frombuffer(factors.first()["r"]).reshape(-1, dim)


def _whitened(x: np.ndarray, m: Model) -> np.ndarray:
    """Rows projected on the components over their spreads; NaN where a component has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m.spread > 0, centred(x, m.n, m.sums) @ m.directions / m.spread, np.nan)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> tuple[Model, DataFrame]:
    """The model, and the table of distinct vectors (columns x, n) it was made from.

    A component whose singular value is within rounding of zero has spread 0.  Signs: the largest entry by magnitude is positive."""
    rows = store.table(_distinct(df, vector, scale), "distinct", codec="zstd")
    dim, n = rows.agg(F.max("n"), F.count("*")).first()
    dim = dim or 0
    if not dim:
        return Model(n, [], np.zeros((0, 0)), np.zeros(0), 0.0), rows
    sums = _sums(rows, dim)
    r = _last_factor(rows, n, sums)
    _, s, right = np.linalg.svd(r)
    s = np.append(s, np.zeros(dim - len(s)))
    s[s <= max(n, dim) * np.finfo(float).eps * s[0]] = 0.0
    k = min(components, dim)
    directions = right[:k].T.copy()
    for j in range(k):
        if directions[np.argmax(np.abs(directions[:, j])), j] < 0:
            directions[:, j] *= -1
    return Model(n, sums, directions, s[:k] / np.sqrt(n), float((s * s).sum() / n)), rows


def identity_error(rows: DataFrame, m: Model) -> float | None:
    """Largest absolute entry of the whitened distinct vectors' covariance minus the identity, over components with spread.

    Spark's covariance is centred before it multiplies, task by task, and merged."""
    alive = [int(j) for j in np.flatnonzero(m.spread > 0)]
    if not alive:
        return None
    dim = len(m.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in vectors.gathered(batches, ROWS):
            w = _whitened(vectors.unpacked(b.column(0), dim, np.int64), m)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in alive], names=[f"w{j}" for j in alive])

    pairs = [(i, j) for i in alive for j in alive if i <= j]
    seen = rows.select("x").mapInArrow(run, ", ".join(f"w{j} double" for j in alive)).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(seen, pairs, strict=True))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Rows whose vector is null or has a null or non-finite entry are left out; rows with a null id or a repeated one stay.  Shorter vectors
    count as padded with zeros, and two that differ by such zeros alone as one.  What a long can't hold saturates; a deviation that
    doesn't fit one is null.  Vectors of fewer than ``components`` entries give as many components as they have.  A component without
    spread has whitened null, and explained 0, or null where no component has any; identity_error is over the others, null if there are none.
    An empty table, or one of empty vectors, gives no rows.  Other columns aren't looked at.
    """
    model, distinct = fit(df, vector, components, scale)
    id_type = df.schema[id_col].dataType
    schema = StructType([StructField(id_col, id_type), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    k = len(model.spread)
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    error, names = identity_error(distinct, model), schema.names
    explained = [None if model.trace == 0 else float(s * s / model.trace) for s in model.spread]
    store.drop(distinct)
    rows = df.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).where(vectors.usable("v")).select("i", vectors.floors("v", scale).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors.matrix(b.column(1), len(model.sums))
            w, (d, fits) = _whitened(x, model), deviations(x, model.n, model.sums)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(n, model.n)),
                    pa.array(d, mask=~fits).take(at),
                    pa.array(w.ravel(), mask=np.isnan(w).ravel()),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * n, pa.float64()),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)
