"""Product codes of vectors, with exact nearest entries by exponion search.

A vector's parts are coded one by one with codebooks of whole numbers.  An entry's neighbours are listed by
their distance from it.  The search for a part x starts at its previous entry a, at distance u.  With
b the best distance so far, no entry farther from a than u + b can be nearer than b, or as near (triangle
inequality), so the list is read up to that radius and no further; the radius shrinks as b does.
All distances are exact whole numbers, ties go to the lower index, and the radius is widened by more than the
square roots' rounding, so the result is that of a full search.

Each round reads one table and writes the next: rows with their new entries beside each task's sums of parts.
Sums are added up in Spark; the driver gets one row an entry.  A codebook has parts x entries x length
numbers, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

from . import store, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task codes at once.
ROWS = 1 << 15
#: Into so many pieces the rows of a label are dealt where its total is joined to them.
SALTS = 64


class Book:
    """Entries of one part position, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.c = entries.astype(np.int64)
        self.wide = int(np.abs(self.c).max(initial=0))
        d = self.c[:, None, :] - self.c[None, :, :]
        d2 = (d * d).sum(2)
        self.order = np.argsort(d2, axis=1, kind="stable")  # an entry and its equals come first
        self.root = np.sqrt(np.take_along_axis(d2, self.order, 1).astype(np.float64))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row, its squared distance, and how many distances were taken."""
        top = max(self.wide, int(np.abs(x).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 52 else np.int64  # doubles are exact below 2^53
        x, c = x.astype(kind), self.c.astype(kind)
        xx, cc = (x * x).sum(1), (c * c).sum(1)
        d = x - c[start]
        best, least = start.astype(np.int64), (d * d).sum(1)
        first = np.sqrt(least.astype(np.float64))
        by = np.argsort(start, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(start[by]) != 0, True)) + 1 if len(by) else []
        taken, begin = len(x), 0
        for end in ends:
            rows, a = by[begin:end], int(start[by[begin]])
            begin, at = end, 0
            while at < len(c) and len(rows):
                width = max(16, 4096 // len(rows))
                reach = (first[rows] + np.sqrt(least[rows].astype(np.float64))) * (1 + 1e-12) + 1e-6
                stop = min(at + width, int(np.searchsorted(self.root[a], reach.max(), "right")))
                if stop <= at:
                    break
                rows = rows[self.root[a, at] <= reach]
                near = self.order[a, at:stop]
                d = xx[rows, None] - 2 * (x[rows] @ c[near].T) + cc[near]
                low = d.min(1)
                index = np.where(d == low[:, None], near, len(c)).min(1)
                better = (low < least[rows]) | ((low == least[rows]) & (index < best[rows]))
                best[rows[better]], least[rows[better]] = index[better], low[better]
                taken += d.size
                at = stop
        return best, least.astype(np.int64), taken


def _assign(books: list[np.ndarray], length: int, sums: bool):
    """A function over batches of (id, label, n, x, codes)."""
    parts, entries, dim = len(books), len(books[0]), length * len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [Book(b) for b in books]
        total, count = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for b in vectors.gathered(batches, ROWS):
            x = vectors.unpacked(b.column(3), dim, np.int32, vectors.limit(dim, 2))
            before = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u2").reshape(-1, parts).astype(np.int64)
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p * length : (p + 1) * length])
                codes[:, p], d, _ = lists[p].nearest(part, before[:, p])
                error += d
                if sums:
                    by = np.argsort(codes[:, p], kind="stable")
                    heads = np.flatnonzero(np.append(True, np.diff(codes[by, p]) != 0))
                    total[p, codes[by[heads], p]] += np.add.reduceat(part[by], heads, axis=0)
                    count[p] += np.bincount(codes[:, p], minlength=entries)
            raw = codes.astype("<u2")
            kept = [*(b.column(i) for i in range(4)), pa.array([r.tobytes() for r in raw], pa.binary())]
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(error), pa.array(np.zeros(n, np.int32)), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                names=["c0", "c1", "n", "x", "codes", "error", "kind", "part", "entry", "count", "sums"],
            )
        if sums and count.any():
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(p), t) for t in (b.column(0).type, b.column(1).type, pa.int32(), pa.binary(), pa.binary(), pa.int64())), pa.array(np.ones(len(p), np.int32)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
                names=["c0", "c1", "n", "x", "codes", "error", "kind", "part", "entry", "count", "sums"],
            )

    return run


def _schema(id_type: DataType, label_type: DataType) -> StructType:
    from pyspark.sql.types import ArrayType

    fields = [("c0", id_type), ("c1", label_type), ("n", IntegerType()), ("x", BinaryType()), ("codes", BinaryType()), ("error", LongType()), ("kind", IntegerType()), ("part", IntegerType()), ("entry", IntegerType()), ("count", LongType()), ("sums", ArrayType(LongType()))]
    return StructType([StructField(n, t) for n, t in fields])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id_col``, code, error, label_error and codebooks_sha256 of each usable row.

    Vectors are padded with zeros to the longest, whose length is rounded up to a multiple of ``parts``.  Entries start as the
    rows with the smallest ids; null ids come last, equal ids in the order of their bytes; with fewer rows there are fewer entries.
    Components saturate where the sum of squares might not fit a long (2^27 at 64 components).  Repeated rows
    are rows of their own; an empty table gives none.  Other columns of ``df`` aren't looked at.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code byte tells 1 to 256 entries apart")
    from pyspark.sql.types import DecimalType

    rows = store.table(vectors.pack_table(df, [id_col, label], vector, scale), "vectors")
    longest = rows.agg(F.max("n")).first()[0]
    id_type, label_type = df.schema[id_col].dataType, df.schema[label].dataType
    out = StructType([StructField("c0", id_type), StructField("c1", label_type), StructField("code", StringType()), StructField("error", LongType())])
    if longest is None:
        return df.sparkSession.createDataFrame([], StructType([StructField(id_col, id_type), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())]))
    length = max(1, -(-longest // parts))
    dim = length * parts
    first = rows.orderBy(F.col("c0").asc_nulls_last(), "x").limit(entries).collect()  # at most 256 rows
    flat = np.zeros((len(first), dim), np.int64)
    for i, r in enumerate(first):
        flat[i, : r["n"]] = np.frombuffer(r["x"], "<i4")
    flat = np.clip(flat, -vectors.limit(dim, 2), vectors.limit(dim, 2))
    books = [flat[:, p * length : (p + 1) * length] for p in range(parts)]
    schema = _schema(id_type, label_type)
    state = rows.withColumn("codes", F.lit(b"\0\0" * parts))
    before = rows
    for _ in range(rounds):
        path = store.new_path(df.sparkSession, "codes")
        state.mapInArrow(_assign(books, length, True), schema).write.partitionBy("kind").parquet(path)
        both = df.sparkSession.read.schema(schema).parquet(path)
        wide = DecimalType(38, 0)
        sums = both.where("kind = 1").groupBy("part", "entry").agg(F.sum(F.col("count").cast(wide)).alias("count"), *[F.sum(F.col("sums")[i].cast(wide)).alias(f"s{i}") for i in range(length)])
        books = [b.copy() for b in books]
        for r in sums.collect():  # one row an entry
            books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // int(r["count"]) for i in range(length)]
        state = both.where("kind = 0").select("c0", "c1", "n", "x", "codes")
        store.drop(before)
        before = both
        before._veilsight_path = path

    assign = _assign(books, length, False)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in assign(batches):
            raw = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u2").reshape(-1, parts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in raw.astype(np.uint8)], pa.string()), b.column(5)], names=["c0", "c1", "code", "error"])

    coded = store.table(state.mapInArrow(last, out), "coded")
    store.drop(before)
    # a label that a third of all rows have is dealt to SALTS places, each with a copy of the label's one total
    totals = coded.groupBy(F.col("c1").alias("l")).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("c0", "code", "error"), F.lit(SALTS)).cast("int"))
    found = salted.join(totals, salted.c1.eqNullSafe(totals.l) & (salted.salt == totals.salt))
    return found.select(F.col("c0").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of ``op11``'s rows, by full search; for vectors of one length that ``parts`` divides."""
    base = f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
pieces AS MATERIALIZED (
  SELECT r, vec_id, label, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS v
  FROM kept, range({parts}) AS parts_(p)
),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM pieces WHERE r <= {entries})"""
    near = """
near{k} AS MATERIALIZED (
  SELECT r, p, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(v) AS v, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
    SELECT pieces.r, pieces.p, vec_id, label, v, e, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d
    FROM pieces JOIN book{k} AS b USING (p)) GROUP BY r, p
)"""
    step = """
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(v[i]) / count(*)) AS m FROM near{k}, range(1, 1 + (SELECT max(len(v)) FROM pieces)) AS at_(i) GROUP BY p, e, i) GROUP BY p, e
),
book{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m ON b.p = m.p AND b.e = m.e)"""
    steps = [near.format(k=k) + "," + step.format(k=k, n=k + 1) for k in range(rounds)]
    return f"""WITH {base},{",".join(steps)},{near.format(k=rounds)},
coded AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY r
),
said AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda m: m::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS s FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, said"""
