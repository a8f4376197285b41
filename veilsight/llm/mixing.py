"""Mixing sources to target weights by the cube method.

A source's target is its share, by weight, of ``budget`` percent of all sizes, at most
``most`` times its own size (what is over is shared again by weight).  A document's expected
number of uses is target / source size; the whole part is taken, and the fraction is an
inclusion probability that the cube method decides: within small groups of a source, the
probabilities of three documents at a time are moved along the null space of the constraints (total
size, number of documents) until one of them is 0 or 1, so both totals stay as they are.  Each
group leaves at most two fractions; these form new groups, level by level, until one group a
source is left, and only its last fractions are rounded (the landing).

The landing takes the rounding whose totals are nearest to the fractions', whatever the inclusion
probabilities of those few documents are.

Groups hold about ``GROUP`` rows dealt by hash, so a source of any size is split; only ids, sizes and
probabilities are shuffled, and however many sources there are, none is listed on the driver.  All choices come from hashes of the rows, so reruns agree.

Edge cases: null sources are a source, the last in order; null and empty texts have
size 0 and a source of size 0 a target of 0; rows alike in id, source and size are counted
together and get uses that differ by one at most; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (3, 1, 2)
BUDGET = 150
MOST = 2
GROUP = 2000
#: Fractions that the landing rounds together, beside the two that a flight leaves.
LANDING = 10


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Moves probabilities until at most two are fractions; sum(p) and sum(p * size) hold."""
    p = p.astype(float).copy()
    rng = np.random.default_rng(seed)
    live: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    size_, p_ = size.astype(float).tolist(), p.tolist()
    for i in range(len(p_)):
        if not 1e-9 < p_[i] < 1 - 1e-9:
            p_[i] = round(p_[i])
            continue
        live.append(i)
        if len(live) == 3:
            a, b, c = live
            u = (size_[c] - size_[b], size_[a] - size_[c], size_[b] - size_[a])
            _move(p_, live, (1.0, -1.0, 0.0) if not any(u) else u, next(draws))
            live = [k for k in live if 1e-9 < p_[k] < 1 - 1e-9]
            for k in (a, b, c):
                if k not in live:
                    p_[k] = float(round(p_[k]))
    return np.array(p_)


def _move(p: list[float], rows: list[int], u: tuple[float, ...], draw: float) -> None:
    up = min((1 - p[k]) / x if x > 0 else -p[k] / x for k, x in zip(rows, u, strict=True) if x)
    down = min(p[k] / x if x > 0 else (p[k] - 1) / x for k, x in zip(rows, u, strict=True) if x)
    step = up if draw < down / (up + down) else -down
    for k, x in zip(rows, u, strict=True):
        p[k] += step * x


def landing(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Rounds the last fractions (``LANDING`` and two at most): of all ways to round them, one whose
    total size and number of documents are nearest to what the fractions give."""
    p = p.astype(float).copy()
    live = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    if len(live):
        ways = (np.arange(1 << len(live))[:, None] >> np.arange(len(live)) & 1).astype(float)
        off = np.abs((ways - p[live]) @ size[live]) + 0.25 * max(1.0, float(size[live].mean())) * np.abs((ways - p[live]).sum(axis=1))
        best = np.flatnonzero(off <= off.min() + 1e-9)
        p[live] = ways[best[np.random.default_rng(seed).integers(len(best))]]
    return np.round(p)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``number``, from 0 in this order; rows are cut into ranges, whose counts are added up first."""
    cut = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut = store.table(cut, "ranges")  # ranges are of a sample, so they are made once
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    start = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy(*order)
    return cut.join(start, "_range").withColumn("number", F.col("_start") + F.row_number().over(own) - 1).drop("_range", "_start")


def targets(units: DataFrame, weights=WEIGHTS, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """One row a source: total size, target, uses (target over size) and number of rows.

    Sources below a level have their most, the others share what is left by weight; the level rises until
    it closes no more sources.  A round is one sum over the sources, of which the driver gets one row."""
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = store.table(numbered(rows, F.col("source").isNull(), F.col("source")).withColumn("weight", weight), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:
        under = F.col("source_size") < F.lit(level) * F.col("weight")
        r = rows.agg(F.coalesce(F.sum(F.when(under, F.col("source_size"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(~under, F.col("weight"))), F.lit(0)).alias("w"), F.count_if(under).alias("n")).first()
        left = Fraction(budget * total, 100) - most * r["s"]
        if r["n"] == closed or not r["w"]:
            break
        level, closed = float(left / (most * r["w"])), r["n"]
    share = float(left / r["w"]) if r["w"] else 0.0
    target = F.when(under, F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(share) * F.col("weight"))
    target = F.least(target, F.lit(float(most)) * F.col("source_size"))
    return rows.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("uses"), "source_rows")


def _decider(last: bool, level: int):
    def decide(table):
        size, turn = np.array(table.column("size")), np.array(table.column("turn"))
        # like sizes stand together, the largest first, so that what is left over is small
        order = np.lexsort((turn, -size))
        seed = (int(np.bitwise_xor.reduce(turn)) % (1 << 63)) + level
        p, size_ = np.array(table.column("p"))[order], size[order]
        # at the last level some fractions, not of the largest sizes, are left to the landing
        fly = np.ones(len(p), bool)
        if last:
            fly[np.linspace(len(p) // 4, len(p) - 1, min(LANDING, len(p))).astype(int)] = False
        p[fly] = flight(p[fly], size_[fly], seed)
        p = landing(p, size_, seed + 1) if last else p
        rows = table.take(pa.array(order))
        return pa.table({"doc_id": rows["doc_id"], "source": rows["source"], "size": rows["size"], "p": pa.array(p, pa.float64()), "groups": rows["groups"]})

    return decide


def uses(docs: DataFrame, weights=WEIGHTS, budget: int = BUDGET, most: int = MOST, group: int = GROUP) -> DataFrame:
    """One row for each distinct (doc_id, source, size), of n documents: ``whole`` uses of
    each and one more for ``extra`` of them, beside source_size and target."""
    units = docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    units = store.table(units, "units")
    goal = targets(units, weights, budget, most)
    known = units.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumn("whole", F.floor("uses").cast("long")).withColumn("_f", (F.col("uses") - F.floor("uses")) * F.col("n"))
    known = known.withColumn("base", F.floor("_f").cast("long")).withColumn("p", F.col("_f") - F.floor("_f"))
    most_rows = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    kind = "doc_id {0}, source string, size bigint, p double".format(docs.schema["doc_id"].dataType.simpleString())
    undecided = known.select("doc_id", "source", "size", "p", F.ceil(F.col("source_rows") / F.lit(float(group))).cast("long").alias("groups"))
    settled, level, left = None, 0, most_rows
    while True:
        last = left <= group
        salt = F.xxhash64(F.col("doc_id").cast("string"), "size", F.lit(level))
        dealt = undecided.withColumn("cell", F.pmod(salt, F.greatest(F.col("groups"), F.lit(1)))).withColumn("turn", salt)

        done = dealt.groupBy("source", "cell").applyInArrow(_decider(last, level), kind + ", groups bigint")
        done = store.table(done, f"flight{level}")
        whole = done.where(F.col("p").isin(0.0, 1.0))
        settled = whole if settled is None else settled.union(whole)
        if last:
            break
        undecided = done.where(~F.col("p").isin(0.0, 1.0)).withColumn("groups", F.ceil(2.0 * F.col("groups") / group).cast("long"))
        left, level = 2 * -(-left // group), level + 1
    chosen = settled.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("p").cast("long").alias("one"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    out = known.join(chosen, on).withColumn("extra", F.col("base") + F.col("one"))
    return out.select("doc_id", "source", "size", "n", "whole", "extra", "source_size", "target")


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, times and taken words."""
    found = uses(docs, **how)
    first = found.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    times = F.col("whole") + (F.col("k") <= F.col("extra")).cast("long")
    return first.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as many times as it is used; columns as they were."""
    names = docs.columns
    sized = docs.withColumn("_size", n_words("text"))
    found = store.table(uses(sized.select("doc_id", "source", F.col("_size").alias("size")), **how), "uses")
    plan = found.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "whole", "extra")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    rows = sized.join(plan, on)
    times = F.col("whole") + F.col("extra")
    if not found.where("n > 1").isEmpty():
        # documents alike in id, source and size are numbered within cells of about GROUP, after those of the cells before
        several = rows.where("n > 1").withColumn("_cell", F.pmod(F.xxhash64("text"), F.ceil(F.col("n") / F.lit(float(GROUP))).cast("long")))
        key = ["_d", "_s", "_z", "_cell"]
        ahead = Window.partitionBy("_d", "_s", "_z").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        start = several.groupBy(*key).count().select(*[F.col(c).alias(f"{c}2") for c in key], F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
        several = several.join(start, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in key]))
        several = several.withColumn("_k", F.col("_start") + F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text")))).drop("_start", "_cell", *[f"{c}2" for c in key])
        rows = rows.where("n = 1").withColumn("_k", F.lit(1).cast("long")).unionByName(several)
        times = F.col("whole") + (F.col("_k") <= F.col("extra")).cast("long")
    copies = rows.withColumn("_times", times).where("_times > 0")
    return copies.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*names)
