"""What is kept between passes about every item that was read: rows, profiles and fingerprints shared by sources.

Index rows have source, key, marker, fingerprint, flags and a profile; a profile is what an item was read
with.  All of it is tables, joined by key; none of it holds a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach

#: Fixed values, flags of an index row: a copy of another, unreadable.
COPY, UNREADABLE = 8, 16


def profile_id(body: Column) -> Column:
    """A profile's id, made of its content alone: equal wherever and whenever it is made.

    Maps and arrays in it must be sorted by the caller, as ``sorted_map`` does."""
    return F.substring(F.sha2(F.to_json(F.struct(F.lit(1).alias("f"), body.alias("p"))), 256), 1, 32)


def sorted_map(entries: Column) -> Column:
    """A map as a sorted list of entries; null and empty are the same."""
    return F.array_sort(F.coalesce(F.map_entries(entries), F.map_entries(F.expr("cast(map() as map<string, string>)"))))


def split_profiles(rows: DataFrame, body: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Index rows with ``profile`` in place of the columns in ``body``, and those columns once a profile.

    Many items share a profile, so its columns are reduced on the map side before they are shuffled."""
    tagged = rows.withColumn("profile", profile_id(F.struct(*body)))
    return tagged.drop(*body), tagged.select("profile", *body).groupBy("profile").agg(*[F.first(c).alias(c) for c in body])


def merge_shards(rows: DataFrame, profiles: DataFrame, body: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Shards that number their profiles themselves, as one index: rows (shard, profile, ...) and profiles (shard, profile, body).

    Rows are remapped to ids made of content; a number that its shard's profiles haven't got gives a null profile, so the item
    is read again.  Where shards have a key twice, the row with the later ``generation`` stays, the smaller marker of equal ones."""
    named = profiles.withColumn("_id", profile_id(F.struct(*body)))
    counts = rows.groupBy("shard", "profile").agg(F.count("*").alias("_n"))
    ids = counts.join(named.select("shard", "profile", "_id"), ["shard", "profile"], "left").groupBy("shard", "profile").agg(F.min("_id").alias("_id"), F.max("_n").alias("_n"))
    mapped = attach(rows, ids, ["shard", "profile"], "_n").drop("shard", "profile").withColumnRenamed("_id", "profile")
    rest = [c for c in mapped.columns if c not in ("source", "key")]
    last = mapped.groupBy("source", "key").agg(F.min_by(F.struct(*rest), F.struct((-F.col("generation")).alias("g"), "marker", "profile")).alias("_r"))
    return last.select("source", "key", "_r.*"), named.groupBy(F.col("_id").alias("profile")).agg(*[F.first(c).alias(c) for c in body])


def sweep(index: DataFrame, listed: DataFrame, generation: int, complete: bool) -> DataFrame:
    """The index after a listing: rows that it met carry its number; only a complete one drops the others of its sources.

    ``listed`` has source, key and marker.  New items are no rows until they are read."""
    met = listed.select("source", "key").distinct().withColumn("_met", F.lit(True))
    rows = index.join(met, ["source", "key"], "left").withColumn("generation", F.when(F.col("_met"), F.lit(generation)).otherwise(F.col("generation")).cast(index.schema["generation"].dataType))
    if complete:
        # sources of a listing are few; their rows that it didn't meet are gone from the store
        sources = listed.select("source").distinct().withColumn("_swept", F.lit(True))
        rows = rows.join(sources, "source", "left").where(F.col("_met") | F.col("_swept").isNull()).drop("_swept")
    return rows.select(*index.columns)


def relist(cursors: DataFrame, listings: dict[str, str], places: Sequence[str]) -> DataFrame:
    """Cursors (source, kind, listing, ``places``) for a build that lists as ``listings`` says: where that version has moved, the places are dropped.

    Nothing is read again for it, as each item is decided by its index row.  A first listing records its version and drops nothing."""
    now = F.create_map(*[F.lit(x) for kv in listings.items() for x in kv])[F.col("kind")] if listings else F.lit(None).cast("string")
    moved = F.coalesce(now.isNotNull() & F.col("listing").isNotNull() & (now != F.col("listing")), F.lit(False))
    out = cursors.withColumn("relisted", moved)
    for c in places:
        out = out.withColumn(c, F.when(~F.col("relisted"), F.col(c)))
    return out.withColumn("listing", F.coalesce(now, F.col("listing")))


def forget(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """Cursors or index rows of sources that are still in scope."""
    return kept.join(sources.select("source").distinct(), "source", "left_semi")


def pointers(index: DataFrame) -> DataFrame:
    """fingerprint, source, key of readable items that are nobody's copy: where a content may be found."""
    return index.where(F.col("fingerprint").isNotNull() & (F.col("flags").bitwiseAND(F.lit(COPY | UNREADABLE)) == 0)).select("fingerprint", "source", "key")


def verified(pointers: DataFrame, index: DataFrame, profiles: Sequence[str] | None = None) -> DataFrame:
    """Pointers with ``stale``: whether the row that they name is gone, or has another content now; and ``usable``, whether
    it was read with what is current (``profiles``; all are if None), is readable and nobody's copy."""
    rows = index.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("fingerprint").alias("_f"), F.col("flags").alias("_flags"), F.col("profile").alias("_p"))
    found = pointers.join(rows, (F.col("source") == F.col("_s")) & (F.col("key") == F.col("_k")), "left")
    stale = ~F.coalesce(F.col("_f") == F.col("fingerprint"), F.lit(False))
    current = F.lit(True) if profiles is None else F.coalesce(F.col("_p").isin(*profiles), F.lit(False))
    usable = ~stale & current & (F.col("_flags").bitwiseAND(F.lit(COPY | UNREADABLE)) == 0)
    return found.select(*pointers.columns, stale.alias("stale"), F.coalesce(usable, F.lit(False)).alias("usable"))


def originals(items: DataFrame, pointers: DataFrame, index: DataFrame, present: Sequence[str], profiles: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (source, key, fingerprint) with ``original``, a struct of source and key in another source, else null; and the
    pointers without those found stale.

    Pointers are verified by their own key, one row each, before they meet the items, and reduced to the two smallest sources of
    a content (an item in one finds the other); a content that a third of all items share costs one row."""
    known = verified(pointers, index, profiles)
    good = known.where(F.col("usable") & F.col("source").isin(*present))
    per_source = good.groupBy("fingerprint", "source").agg(F.min("key").alias("key"))
    first = per_source.groupBy("fingerprint").agg(F.min(F.struct("source", "key")).alias("_a"))
    second = per_source.join(first, "fingerprint").where(F.col("source") != F.col("_a.source")).groupBy("fingerprint").agg(F.min(F.struct("source", "key")).alias("_b"))
    counts = items.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("_n"))
    one = counts.join(first, "fingerprint", "left").join(second, "fingerprint", "left")
    rows = attach(items, one, ["fingerprint"], "_n")
    original = F.when(F.col("_a.source") != F.col("source"), F.col("_a")).otherwise(F.col("_b"))
    return rows.withColumn("original", original).drop("_a", "_b"), known.where(~F.col("stale")).select(*pointers.columns)
