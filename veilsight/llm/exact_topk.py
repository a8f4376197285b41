"""Exact top-k by inner product, by distributed histogram selection.

Every query is scored against every row, in blocks of rows that hold many vectors each; scores are never
written.  Each round counts the scores of a query in 256 bins of the interval where its kth highest value must lie; the
bin that holds it becomes the next interval, until a bin is one score wide.  Then one pass keeps what
is above that value, and of what equals it as many rows as are missing, smallest ids first.

A task reports, for each query, its bins from the top down to the one that holds its own kth score (the kth of all can't be
below that), so at most k numbers.  Counts are added up in Spark; queries and their intervals stay in tables,
as their number grows with the rows'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import store, vectors

K, SCALE, BINS = 20, 64, 256
#: Vectors of a block hold so many bytes; the last block of a task is smaller.
BLOCK_BYTES = 1 << 18
#: Queries that one task of a pass may hold one after the other.
QUERY_BLOCKS = 8


def _blocks(dim: int):
    """A function over batches of (c0, n, x, is_query) that lays vectors side by side in blocks with a number of their own."""
    rows = max(1, BLOCK_BYTES // (4 * max(dim, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in vectors.gathered(batches, rows):
            x = vectors.unpacked(b.column(2), dim, np.int32, vectors.limit(dim))
            norm = int((x * x).sum(1).max(initial=0))
            ids = b.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(x)], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([known.tobytes()], pa.binary()), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([norm])],
                names=["chunk", "rows", "ids", "known", "x", "norm"],
            )
            number += 1

    return run


_CHUNK = StructType([StructField("chunk", LongType()), StructField("rows", IntegerType()), StructField("ids", BinaryType()), StructField("known", BinaryType()), StructField("x", BinaryType()), StructField("norm", LongType())])


def _queries(dim: int, every: int):
    """A function over blocks that picks the rows whose id ``every`` divides: where they stand, id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, known, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i4").reshape(-1, dim)
                at = np.flatnonzero(np.frombuffer(known, bool) & (ids % every == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["own_chunk", "own_row", "query_id", "x"])

    return run


def _laid(dim: int):
    """A function over queries that lays them side by side in blocks with a number of their own."""
    rows = max(1, BLOCK_BYTES // (4 * max(dim, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in vectors.gathered(batches, rows):
            columns = [b.column(i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b.num_rows], pa.int32()), *(pa.array([c], pa.binary()) for c in columns), pa.array([b"".join(b.column(3).to_pylist())], pa.binary())], names=["block", "queries", "own_chunk", "own_row", "query_id", "qx"])
            number += 1

    return run


_BLOCK = StructType([StructField("block", LongType()), StructField("queries", IntegerType()), *(StructField(n, BinaryType()) for n in ("own_chunk", "own_row", "query_id", "qx"))])


class _Side:
    """One pair of blocks after the other: scores of a block of queries with one block of rows."""

    def __init__(self, row: dict, dim: int, kind: type):
        self.block, self.dim, self.kind = row["block"], dim, kind
        self.q = np.frombuffer(row["qx"], "<i4").reshape(-1, dim).astype(kind)
        self.own_chunk, self.own_row, self.ids = (np.frombuffer(row[n], "<i8") for n in ("own_chunk", "own_row", "query_id"))
        self.low = np.array([s["low"] for s in row["state"]], np.int64)
        self.need = np.array([s["need"] for s in row["state"]], np.int64)

    def scores(self, row: dict) -> np.ndarray:
        """Inner products; a query's own row is far below all others."""
        c = np.frombuffer(row["x"], "<i4").reshape(-1, self.dim).astype(self.kind)
        s = (self.q @ c.T).astype(np.int64)
        mine = np.flatnonzero(self.own_chunk == row["chunk"])
        s[mine, self.own_row[mine]] = np.iinfo(np.int64).min
        return s


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):  # a row is a pair of blocks
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}


def _count(dim: int, kind: type, span: int, width: int):
    """A function over pairs of blocks: how many scores of a query are in which bin of its interval of ``span`` scores."""

    def told(side: _Side, seen: np.ndarray) -> pa.RecordBatch:
        above = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1] - seen  # in higher bins
        q, bin_ = np.nonzero((seen > 0) & (above < side.need[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), side.block)), pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(seen[q, bin_])], names=["block", "q", "bin", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, seen = None, None
        for row in _rows(batches):
            if side is None or side.block != row["block"]:
                if side is not None:
                    yield told(side, seen)
                side = _Side(row, dim, kind)
                seen = np.zeros((len(side.q), BINS), np.int64)
            s = side.scores(row)
            inside = (s >= side.low[:, None]) & (s < (side.low + span)[:, None])
            q, c = np.nonzero(inside)
            bins = (s[q, c] - side.low[q]) // width
            seen += np.bincount(q * BINS + bins, minlength=seen.size).reshape(seen.shape)
        if side is not None:
            yield told(side, seen)

    return run


def _pick(dim: int, kind: type):
    """A function over pairs of blocks: rows above each query's kth value, and the smallest ids that equal it."""

    def told(side: _Side, found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        q, s, known, ids = (np.concatenate([f[i] for f in found]) for i in range(4))
        tie = s == side.low[q]
        order = np.lexsort((ids, ~known, q, ~tie))  # ties first, of each query nulls last
        q, s, known, ids, tie = q[order], s[order], known[order], ids[order], tie[order]
        n = int(tie.sum())
        place = np.arange(n) - np.searchsorted(q[:n], q[:n])
        keep = np.append(place < side.need[q[:n]], np.ones(len(q) - n, bool))
        return q[keep], s[keep], known[keep], ids[keep]

    def batch(side: _Side, found: list) -> pa.RecordBatch:
        q, s, known, ids = told(side, found)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), side.block)), pa.array(q.astype(np.int32)), pa.array(side.ids[q]), pa.array(ids, mask=~known), pa.array(s)], names=["block", "q", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, found, held = None, [], 0
        for row in _rows(batches):
            if side is None or side.block != row["block"]:
                if found:
                    yield batch(side, found)
                side, found, held = _Side(row, dim, kind), [], 0
            s = side.scores(row)
            q, c = np.nonzero(s >= side.low[:, None])
            found.append((q, s[q, c], np.frombuffer(row["known"], bool)[c], np.frombuffer(row["ids"], "<i8")[c]))
            held += len(q)
            if held > 1 << 20:
                found = [told(side, found)]
                held = len(found[0][0]) // 2
        if found:
            yield batch(side, found)

    return run


def widths(bound: int, bins: int = BINS) -> list[int]:
    """Widths of the bins round by round for scores from -bound to bound; the last is 1."""
    out, w = [], 2 * bound + 1
    while w > 1:
        w = -(-w // bins)
        out.append(w)
    return out or [1]


def _next(counts: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """Each query's next interval: the bin with its kth value, and how many are missing in it."""
    bins = counts.groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
    lists = bins.groupBy("block", "q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))  # at most 256 bins
    at = lists.join(state, ["block", "q"])

    def step(acc: Column, b: Column) -> Column:
        done = acc["bin"] >= 0
        here = ~done & (b["n"] >= acc["need"])
        return F.struct(F.when(done, acc["bin"]).when(here, b["bin"]).otherwise(-1).alias("bin"), F.when(done | here, acc["need"]).otherwise(acc["need"] - b["n"]).alias("need"))

    found = at.withColumn("f", F.aggregate("bins", F.struct(F.lit(-1).alias("bin"), F.col("need").alias("need")), step))
    return found.select("block", "q", (F.col("low") + F.col("f.bin").cast("long") * F.lit(width)).alias("low"), F.col("f.need").alias("need"))


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows with the highest scores of each row whose id ``every`` divides.

    A score is the inner product of floor(scale * component).  Vectors null or with null or non-finite
    components take no part; shorter ones count as padded with zeros; components saturate where a score might not fit a long (2^28 at
    64 components).  A row isn't its own candidate; other rows with its id are.  Rows without an id are candidates, last among equal scores.
    Repeated queries are answered each.  An empty table, or one of one row, gives no rows.  Other columns aren't looked at.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = store.table(vectors.pack_table(source, ["id"], "v", scale), "vectors")
    longest, total = rows.agg(F.max("n"), F.count("*")).first()
    out = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()), StructField("vec_id", LongType()), StructField("score", LongType())])
    if longest is None or total < 2:
        return spark.createDataFrame([], out)
    dim = max(1, longest)
    chunks = store.table(rows.mapInArrow(_blocks(dim), _CHUNK), "chunks", codec="zstd")
    store.drop(rows)
    bound = chunks.agg(F.max("norm")).first()[0]  # no score is above the largest square of a length
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # exact in each
    asked = store.table(chunks.mapInArrow(_queries(dim, every), "own_chunk long, own_row int, query_id long, x binary"), "queries")
    n = asked.count()
    per_task = max(1, BLOCK_BYTES // (4 * dim)) * QUERY_BLOCKS
    blocks = store.table(asked.repartition(max(1, -(-n // per_task))).mapInArrow(_laid(dim), _BLOCK), "query-blocks")
    need = min(k, total - 1)
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("q"), F.lit(-bound).cast("long").alias("low"), F.lit(need).cast("long").alias("need"))

    def pairs(state: DataFrame) -> DataFrame:
        """Each block of queries beside each block of rows, one block of queries after the other."""
        lists = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("q", "low", "need"))).alias("state"))  # at most a block's queries
        left = store.table(blocks.join(lists, "block"), "asked")
        return left.hint("shuffle_replicate_nl").crossJoin(chunks)

    span = 2 * bound + 1
    for width in widths(bound):
        counts = pairs(state).mapInArrow(_count(dim, kind, span, width), "block long, q int, bin int, n long")
        state, span = store.table(_next(counts, state, width), "intervals"), width
    found = pairs(state).mapInArrow(_pick(dim, kind), "block long, q int, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= need).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 20, k: int = K, scale: int = SCALE) -> str:
    """DuckDB SQL of the same rows, for vectors of one length."""
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM kept AS q JOIN kept AS c ON q.r <> c.r WHERE q.vec_id % {every} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id ASC NULLS LAST))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {k}"""
