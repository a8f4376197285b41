"""Quality rules: base limits, then robust multivariate outliers.

``statistics`` counts over each whole text: words (runs of other bytes than ASCII white
space), their code points, symbols, repeated lines, and words that stand in an eight-word window
which the text has twice or more.  ``judge`` turns the counts into a vector of transformed rates
and estimates its location and scatter by the minimum covariance determinant, for each language
and source: from medians and median deviations, concentration steps keep the ``SUPPORT`` share of rows
nearest to the estimate, and a group takes a step's estimate if its determinant falls by it; they end when none does.  A document is rejected if its
Mahalanobis distance, scaled by its group's median distance, is over the chi-square quantile of ``ALONE``.

Each group's moments are shrunk towards its language's as if ``PRIOR`` typical rows of the language were in it,
and the language's in the same way towards those of all rows, so a group of any size has an estimate of its own
and none switches from one rule to another.

A concentration step is one Spark aggregation: moments by group and by a grid of distances, reduced on the
map side, whose running sums up to the support's edge are the next estimate.  No group is ever in one
task, and as quantiles are read from counts on fixed grids, verdicts don't depend on partitions.

Edge cases: a null or empty text has counts of 0 and fails the base limits; null languages
and sources are groups of their own; equal rows get equal verdicts; constant statistics have a
least scatter, so they never divide by zero; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .arrays import SPACE, Laid, mix, runs, utf8, window_hash

RUN_BYTES = 1 << 20
WINDOW = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KIND = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ",n_lines:bigint>"

SUPPORT = 0.75
#: Rows of the wider group that each group is shrunk by.
PRIOR = 30
#: Least fall of a log determinant that counts as one.
MOVES = 1e-3
#: Least standard deviation of a transformed rate: differences below it are nobody's fault.
FLOOR = 0.15
DIM = 4
#: Share of a normal group's rows that are let be.
ALONE = 0.9999
#: Grids: width for medians of rates, and steps a power of e for distances.
WIDTH, FINE = 1 / 128, 16
#: Broadcast estimates up to this many groups; more are joined by shuffling.
BROADCAST_GROUPS = 20_000
#: Tables of up to this many groups (by a grid of some hundred bins) are one partition.
TASK_GROUPS = 2_000


def _within(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 array over [begin, end)."""
    c = np.append(0, np.cumsum(total, dtype=np.int64))
    return c[end] - c[begin]


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros(len(offsets) - 1, np.int64) for _ in range(6)]
    for i, j in runs(offsets, RUN_BYTES):
        laid = Laid(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts, ends = laid.words()
        first = laid.first_of(starts)
        out[0][i:j] = np.diff(first)
        inside = ~SPACE[laid.buf]
        out[1][i:j] = _within(inside & (laid.buf & 0xC0 != 0x80), laid.begin, laid.end)
        out[2][i:j] = _within(SYMBOL[laid.buf], laid.begin, laid.end)
        # lines with a word, by their bytes
        cut = np.flatnonzero(laid.buf == 0x0A)
        begin = np.sort(np.concatenate([laid.begin, cut + 1]))
        end = np.sort(np.concatenate([laid.end, cut]))
        full = _within(inside, begin, end) > 0
        begin, end = begin[full], end[full]
        owner = np.searchsorted(laid.begin, begin, "right") - 1
        key = mix(laid.span_hash(begin, end) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        lines = np.bincount(owner, minlength=laid.n)
        out[3][i:j] = lines - np.bincount(owner[at], minlength=laid.n)
        out[5][i:j] = lines
        # windows of eight words that a text has twice or more
        windows = window_hash(laid.span_hash(starts, ends), WINDOW)
        owner = np.repeat(np.arange(laid.n), np.diff(first))
        n = len(windows)
        if n:
            whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n])
            key = mix(windows[whole] + owner[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(whole), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            step = np.zeros(len(starts) + 1, np.int64)
            step[whole[twice]] += 1
            step[whole[twice] + WINDOW] -= 1
            out[4][i:j] = _within(np.cumsum(step)[:-1] > 0, first[:-1], first[1:])
    return out


def statistics(docs: DataFrame, column: str = "stats", text: str = "text") -> DataFrame:
    """Adds a struct of the counts of each whole text."""

    @F.arrow_udf(KIND)
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = counts(*utf8(part))
            yield pa.StructArray.from_arrays([pa.array(c) for c in found], [*FIELDS, "n_lines"])

    return docs.withColumn(column, count(F.col(text)))


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


def vector(s: str) -> list[Column]:
    """Transformed rates: word length, symbols, repeated lines and repeated words."""
    words = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col(f"{s}.n_lines"), F.lit(1)).cast("double")
    return [
        F.log((F.col(f"{s}.word_chars") + 8.0) / (words + 1)),
        F.asinh(20.0 * F.col(f"{s}.n_symbols") / (words + 20)),
        F.asinh(2.0 * F.col(f"{s}.n_dup_lines") / (lines + 4)),
        F.asinh(2.0 * F.col(f"{s}.n_repeat_words") / (words + 20)),
    ]


def chi2_quantile(share: float, dim: int = DIM) -> float:
    """Wilson and Hilferty's approximation (within 1 % for the shares used here)."""
    z = NormalDist().inv_cdf(share)
    return dim * (1 - 2 / (9 * dim) + z * (2 / (9 * dim)) ** 0.5) ** 3


def solve(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse scatter and its log determinant from a count, sums and (lower) sums of products."""
    mean, cov, tri = np.asarray(sums) / max(n, 1e-9), np.zeros((DIM, DIM)), np.tril_indices(DIM)
    cov[tri] = np.asarray(products) / max(n, 1e-9)
    cov = cov + np.tril(cov, -1).T - np.outer(mean, mean) + np.eye(DIM) * FLOOR**2
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


_ESTIMATE = "struct<mean:array<double>,inv:array<double>,logdet:double>"


def _solved(n: pa.Array, sums: pa.Array, products: pa.Array) -> pa.Array:
    """One row a group: a small matrix each."""
    rows = []
    for k, a, b in zip(n.to_pylist(), sums.to_pylist(), products.to_pylist(), strict=True):
        mean, inv, logdet = solve(k, a, b)
        # rounded, so that the order in which sums were added can't move a verdict
        rows.append({"mean": np.round(mean, 9).tolist(), "inv": np.round(inv, 6).ravel().tolist(), "logdet": round(logdet, 6)})
    return pa.array(rows, pa.struct([("mean", pa.list_(pa.float64())), ("inv", pa.list_(pa.float64())), ("logdet", pa.float64())]))


def _distance(x: list[Column], e: str) -> Column:
    d = [x[i] - F.col(f"{e}.mean")[i] for i in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(DIM):
            total = total + d[i] * d[j] * F.col(f"{e}.inv")[i * DIM + j]
    return total


_TRI = list(zip(*np.tril_indices(DIM), strict=True))
_MOMENTS = ["n", *[f"s{i}" for i in range(DIM)], *[f"p{i}_{j}" for i, j in _TRI]]


def _moments(x: list[Column]) -> list[Column]:
    terms = [F.lit(1.0), *x, *[x[i] * x[j] for i, j in _TRI]]
    return [F.sum(t).alias(c) for t, c in zip(terms, _MOMENTS, strict=True)]


def _middle(counts: DataFrame, by: list[str], bin_: str, share: float) -> DataFrame:
    """For each group of ``counts`` (by, bin, rows) the bin (``edge``) up to which ``share`` of its rows lie.

    A group has as many bins as the grid, whatever its size."""
    bins = F.array_sort(F.collect_list(F.struct(F.col(bin_).cast("int").alias("bin"), F.col("rows").cast("double").alias("rows"))))
    sums = counts.groupBy(*by).agg(bins.alias("_bins"), F.sum(F.col("rows").cast("double")).alias("_all"))
    begin = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("int").alias("edge"))

    def step(acc: Column, b: Column) -> Column:
        upto = acc["upto"] + b["rows"]
        return F.struct(upto.alias("upto"), F.coalesce(acc["edge"], F.when(upto >= share * F.col("_all"), b["bin"])).alias("edge"))

    return sums.select(*by, F.aggregate("_bins", begin, step, lambda acc: acc["edge"]).alias("edge"))


def judge(docs: DataFrame, s: str = "stats", alone: float = ALONE, prior: float = PRIOR) -> DataFrame:
    """Adds base_failed, distance and kept.

    ``docs`` has the struct ``s`` of ``statistics``; it is read once for each step, so it
    should be a written table rather than a plan that counts words."""
    x = [F.col(f"_x{i}") for i in range(DIM)]
    # null-safe keys: a null language or source is told from any text by the JSON around it
    named = lambda df: df.select("*", F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}).alias("_lang"), F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}).alias("_key"))
    rows = named(docs.select("lang", "source", *[v.alias(f"_x{i}") for i, v in enumerate(vector(s))]))
    groups = store.table(rows.groupBy("_lang", "_key").agg(F.count(F.lit(1)).alias("size")), "groups")
    n_groups = groups.count()
    near = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df)
    one = (lambda df: df.coalesce(1)) if n_groups <= TASK_GROUPS else (lambda df: df)
    made = [groups]

    def small(df: DataFrame, name: str) -> DataFrame:
        """A table of groups, written; of few groups it is one file and one partition, so what is made of it needs no shuffles."""
        made.append(store.table(one(df), name))
        return one(made[-1])

    groups = one(groups)

    def medians(values: list[Column], rows: DataFrame, name: str) -> DataFrame:
        """Medians of each group, shrunk towards the language's, and these towards those of all."""
        bins = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(v / WIDTH).cast("int").alias("bin")) for i, v in enumerate(values)]))
        counts = small(rows.select("_lang", "_key", bins.alias("b")).groupBy("_lang", "_key", "b.i", "b.bin").agg(F.count(F.lit(1)).alias("rows")), "counts")
        value = ((F.col("edge") + 0.5) * WIDTH).alias("v")
        total = lambda by: counts.groupBy(*by, "i", "bin").agg(F.sum("rows").alias("rows"))
        every = _middle(total([]), ["i"], "bin", 0.5).select("i", value.alias("va"))
        in_lang = groups.groupBy("_lang").agg(F.sum("size").alias("in_lang"))
        lang = _middle(total(["_lang"]), ["_lang", "i"], "bin", 0.5).select("_lang", "i", value.alias("vl"))
        own = _middle(counts, ["_lang", "_key", "i"], "bin", 0.5).select("_lang", "_key", "i", value)
        size = groups.join(in_lang, "_lang").select("_key", "size", "in_lang")
        wide = (F.col("in_lang") * F.col("vl") + prior * F.col("va")) / (F.col("in_lang") + prior)
        got = own.join(lang, ["_lang", "i"]).join(every, "i").join(size, "_key").select("_key", "i", ((F.col("size") * F.col("v") + prior * wide) / (F.col("size") + prior)).alias("v"))
        return small(got.groupBy("_key").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"{name}{i}") for i in range(DIM)]), name)

    middle = medians(x, rows, "m")
    off = [F.abs(c - F.col(f"m{i}")) for i, c in enumerate(x)]
    spread = medians(off, rows.join(near(middle), "_key"), "a")
    start = middle.join(spread, "_key").select("_key", F.struct(F.array(*[F.col(f"m{i}") for i in range(DIM)]).alias("mean"), F.array(*[(1 / ((1.4826 * F.col(f"a{i}")) ** 2 + FLOOR**2)) if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]).alias("inv"), F.lit(float("inf")).alias("logdet")).alias("e"))
    now = small(start, "estimates")
    while True:
        bin_ = F.floor(F.log(_distance(x, "e") + 1e-3) * FINE).cast("int").alias("bin")
        cells = small(rows.join(near(now), "_key").groupBy("_lang", "_key", bin_).agg(*_moments(x)), "cells")
        edge = _middle(cells.withColumnRenamed("n", "rows"), ["_lang", "_key"], "bin", SUPPORT)
        inside = cells.join(edge, ["_lang", "_key"]).where(F.col("bin") <= F.col("edge")).groupBy("_lang", "_key").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
        lang = inside.groupBy("_lang").agg(*[F.sum(c).alias(f"l_{c}") for c in _MOMENTS])
        every = inside.groupBy(F.lit(1).alias("_all")).agg(*[F.sum(c).alias(f"a_{c}") for c in _MOMENTS])
        wide = {c: F.col(f"l_{c}") + prior * F.col(f"a_{c}") / F.col("a_n") for c in _MOMENTS}
        own = {c: F.col(c) + prior * wide[c] / wide["n"] for c in _MOMENTS}
        sums = inside.join(lang, "_lang").withColumn("_all", F.lit(1)).join(F.broadcast(every), "_all")  # one row
        new = sums.select("_key", own["n"].alias("n"), F.array(*[own[f"s{i}"] for i in range(DIM)]).alias("sums"), F.array(*[own[f"p{i}_{j}"] for i, j in _TRI]).alias("products"))
        new = new.select("_key", F.arrow_udf(_solved, _ESTIMATE)("n", "sums", "products").alias("new")).join(now, "_key")
        # an estimate is taken only if its determinant is smaller than the group's last: so each group comes to rest
        falls = F.col("new.logdet") < F.col("e.logdet") - MOVES
        after = small(new.select("_key", F.when(falls, F.col("new")).otherwise(F.col("e")).alias("e"), falls.alias("moved")), "estimates")
        now = after.select("_key", "e")
        if after.where("moved").isEmpty():
            break
    bin_ = F.floor(F.log(_distance(x, "e") + 1e-3) * FINE).cast("int").alias("bin")
    counts = small(rows.join(near(now), "_key").groupBy("_lang", "_key", bin_).agg(F.count(F.lit(1)).alias("rows")), "counts")
    half = _middle(counts, ["_lang", "_key"], "bin", 0.5).join(groups.select("_key", "size"), "_key")
    # rows whose typical distance is below what chance gives aren't blown up by it
    scale = F.greatest((F.col("size") * F.exp((F.col("edge") + 0.5) / FINE) / chi2_quantile(0.5) + prior) / (F.col("size") + prior), F.lit(1.0))
    final = one(store.table(one(half.select("_key", scale.alias("_scale")).join(now, "_key").withColumnRenamed("e", "_e")), "final"))
    for t in made:
        store.drop(t)
    return (
        named(docs.drop("base_failed", "distance", "kept"))
        .join(near(final), "_key", "left")
        .withColumn("base_failed", base_failed(s))
        .withColumn("distance", _distance(vector(s), "_e") / F.col("_scale"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(alone)))
        .drop("_lang", "_key", "_e", "_scale")
    )


__all__ = ["statistics", "judge", "counts", "vector", "base_failed", "chi2_quantile", "solve"]
