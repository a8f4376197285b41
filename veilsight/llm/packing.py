"""Best-fit packing under conflicts.

Documents of known sizes go into bins of ``capacity`` words.  A document longer than a bin is
cut into whole bins and a rest; every other piece goes, largest first, into the tightest bin that has
room and no conflict: no two pieces of one duplicate cluster share a bin, and at most
``per_source`` pieces of one source do.  Where that isn't given, each source may have twice its even share
of a bin (and two pieces at least), so bins get full however few the sources are.

Bins stand in the order of what room they have left, and each carries a bitmap of the sources that it takes
no more of and of the clusters it has.  The search starts at the first bin with enough room and goes on until
the bitmaps agree, or a bin is opened.  Runs of neighbouring bins keep the bits that all of them have, so a run
in which no bin can take the piece is stepped over at once.

Pieces are dealt by hash to shards of about ``shard_words`` words, packed independently, so a
source or cluster of any size is split and a task holds one shard's numbers only.  ``fill`` reports how
full the bins are.

Edge cases: a null or empty text has size 0 and takes no room, but a place; rows alike in
id, size, source and cluster are counted as copies and dealt one by one; null sources are one
source; rows without a cluster conflict with nobody by it; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
SHARD_WORDS = 1_000_000
#: Words that a document counts for beside its own when shards are cut, so that no shard has too many short ones.
DOCUMENT_WORDS = 16
#: Most bins of a run that is searched one by one.
RUN = 256


class OpenBins:
    """Bins by room left, then number, in runs that know the bits common to all their bins."""

    def __init__(self):
        self.runs: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []
        self.common: list[int] = []
        self.bits: list[int] = []  # of each bin

    def take(self, room: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Removes and returns the first bin with so much room and neither bit."""
        k, want = bisect_left(self.tops, (room, -1)), source | cluster
        while k < len(self.runs):
            if not self.common[k] & want:
                run, bits = self.runs[k], self.bits
                for at in range(bisect_left(run, (room, -1)), len(run)):
                    if not bits[run[at][1]] & want:
                        found = run.pop(at)
                        if run:
                            self.tops[k] = run[-1]
                        else:
                            del self.runs[k], self.tops[k], self.common[k]
                        return found
                common = -1
                for _, b in run:
                    common &= bits[b]
                self.common[k] = common
            k += 1
        return None

    def put(self, room: int, b: int) -> None:
        entry = (room, b)
        if not self.runs:
            self.runs, self.tops, self.common = [[entry]], [entry], [self.bits[b]]
            return
        k = min(bisect_left(self.tops, entry), len(self.runs) - 1)
        run = self.runs[k]
        insort(run, entry)
        self.tops[k] = run[-1]
        self.common[k] &= self.bits[b]
        if len(run) > 2 * RUN:
            self.runs[k : k + 1] = [run[:RUN], run[RUN:]]
            self.tops[k : k + 1] = [run[RUN - 1], run[-1]]
            self.common[k : k + 1] = [self.common[k]] * 2


def best_fit(size: list[int], source: list[int], cluster: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece; pieces come in the order they are packed.  A cluster of -1 is none."""
    open_, many = OpenBins(), collections.Counter()
    sources = 1 + max(source, default=0)
    out = []
    for n, s, c in zip(size, source, cluster, strict=True):
        mark = 1 << sources + c if c >= 0 else 0
        room, b = open_.take(n, 1 << s, mark) or (capacity, len(open_.bits))
        if b == len(open_.bits):
            open_.bits.append(0)
        many[b, s] += 1
        open_.bits[b] |= mark | (1 << s if many[b, s] >= per_source else 0)
        open_.put(room - n, b)
        out.append(b)
    return out


def even_share(size: np.ndarray, sources: int, capacity: int) -> int:
    """Twice as many pieces as a source would have of a bin full of pieces like these."""
    mean = max(1.0, float(size.mean())) if len(size) else 1.0
    return max(2, int(-(-2 * capacity // (mean * max(1, sources)))))


def _dense(values: np.ndarray, shared_only: bool = False) -> np.ndarray:
    """Small numbers for values; with ``shared_only``, -1 for those that are there once."""
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    if not shared_only:
        return number
    again = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
    return again[number]


def pack(items: DataFrame, capacity: int = CAPACITY, per_source: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``items``: doc_id, size, source, cluster.  One row a piece: doc_id, copy, piece (from 0),
    size, source, cluster, bin, offset in the bin."""
    units = items.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"))
    units = units.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = units.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    shards = max(1, -(-((total[0] or 0) + DOCUMENT_WORDS * (total[1] or 0)) // shard_words))
    copies = units.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    whole = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / capacity)
    pieces = copies.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole))).withColumn("piece_size", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)))
    turn = F.xxhash64(F.col("doc_id").cast("string"), "size", "source", "cluster", "copy", "piece")
    dealt = pieces.select(F.pmod(turn, F.lit(shards)).alias("shard"), turn.alias("turn"), "doc_id", "copy", "piece", F.col("piece_size").cast("long").alias("size"), "source", "cluster")

    def place(table):
        size, turn_ = np.array(table.column("size")), np.array(table.column("turn"))
        order = np.lexsort((turn_, -size))
        rows = table.take(pa.array(order))
        named = rows.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
        source = np.array(named.indices)
        known = np.array(rows.column("cluster").is_valid())
        marks = np.where(known, np.array(rows.column("cluster").fill_null(0)), 0)
        cluster = np.full(len(order), -1)
        cluster[known] = _dense(marks[known], shared_only=True)
        size = size[order]
        most = per_source or even_share(size, len(named.dictionary), capacity)
        bins = np.array(best_fit(size.tolist(), source.tolist(), cluster.tolist(), capacity, most), np.int64)
        by = np.argsort(bins, kind="stable")
        before = np.cumsum(size[by]) - size[by]
        first = np.flatnonzero(np.append(True, bins[by][1:] != bins[by][:-1]))
        offset = np.empty(len(by), np.int64)
        offset[by] = before - np.repeat(before[first], np.diff(np.append(first, len(by))))
        shard = np.array(rows.column("shard")).astype(np.int64)
        return pa.table({**{c: rows.column(c) for c in ("doc_id", "copy", "piece", "size", "source", "cluster")}, "bin": pa.array(shard << 32 | bins), "offset": pa.array(offset)})

    kind = items.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(place, f"doc_id {kind}, copy bigint, piece bigint, size bigint, source string, cluster bigint, bin bigint, offset bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, words and the share of the bins' room that words take."""
    bins = packed.groupBy("bin").agg(F.sum("size").alias("words"))
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), (F.sum("words") / (F.count(F.lit(1)) * capacity)).alias("share"))
