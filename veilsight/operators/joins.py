"""Joins of many rows with one row a key, where one key may have a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared

#: A key with more than one row in so many is hot; so there are never more hot keys than this.
SHARE = 1000


def attach(rows: DataFrame, one: DataFrame, by: Sequence[str], count: str, share: int = SHARE) -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row a key with its ``count`` of rows (dropped); null keys match nothing.

    Rows of ``one`` for hot keys are broadcast, at most ``share`` of them whatever the input.  In the shuffle by key that the others
    need, rows with a hot or a null key are dealt out evenly, so no task has more than one row in ``share`` of one key."""
    by = list(by)
    one = shared.written(one, "keys")
    total = one.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total // share
    more = [c for c in one.columns if c not in (*by, count)]
    hot = one.where(is_hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.struct(*more).alias("_hot"))  # at most `share` rows
    tagged = rows.join(F.broadcast(hot), reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(by)]), "left").drop(*[f"_k{i}" for i in range(len(by))])
    alone = F.col("_hot").isNotNull() | reduce(lambda x, y: x | y, [F.col(k).isNull() for k in by])
    tagged = tagged.withColumn("_deal", F.when(alone, F.monotonically_increasing_id()).otherwise(F.xxhash64(*by)))
    cold = one.where(~is_hot).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.xxhash64(*by).alias("_d"), F.struct(*more).alias("_cold"))
    keys = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(by)]
    found = tagged.join(cold, reduce(lambda x, y: x & y, [*keys, F.col("_deal") == F.col("_d")]), "left")
    return found.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in more])
