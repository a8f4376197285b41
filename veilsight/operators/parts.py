"""Items with parts (attachments, shared files): parts are read again on their own, and their findings replaced on their own.

A listing of parts has source, part (its stable id), marker, size and ``sample``, what sampling goes by (its item's id).  The index has
source, part, marker and profile of the last read.  Bodies of items are findings without a part; nothing here touches them.

A stretch of a pass reads what ``stale`` admits and is recorded by ``recorded``; the next one then meets only what is left, so a pass that
is cut off goes on where it stopped.

Edge cases: empty tables give empty results; parts without an id aren't read; a part listed twice is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from .incremental import admit
from .joins import attach

_PART = ["source", "part"]


def stale(listing: DataFrame, index: DataFrame, profile: str, percent: int = 100, max_bytes: int = 1 << 62) -> DataFrame:
    """The parts to read, with ``why``: new, changed (another marker) or profile (read with what isn't current)."""
    once = listing.where(F.col("part").isNotNull()).groupBy(*_PART).agg(F.max(F.struct("marker", "size", "sample")).alias("_l")).select(*_PART, "_l.*")
    # every point is below 100: all that have one are in, and none needs to be worked out
    sampled = F.col("sample").isNotNull() if percent >= 100 else T.sample_point(F.col("sample")) < percent
    once = once.where((F.col("size") > 0) & (F.col("size") <= max_bytes) & sampled)
    known = index.select(*_PART, F.col("marker").alias("_marker"), F.col("profile").alias("_profile"), F.lit(True).alias("_known"))
    rows = once.join(known, _PART, "left")
    why = F.when(F.col("_known").isNull(), "new").when(~F.col("marker").eqNullSafe(F.col("_marker")), "changed").when(~F.col("_profile").eqNullSafe(F.lit(profile)), "profile")
    return rows.withColumn("why", why).where("why IS NOT NULL").drop("_marker", "_profile", "_known")


def stretch(parts: DataFrame, max_items: int, max_bytes: int) -> DataFrame:
    """As many of the parts, by source and id, as the budget admits.

    They are written first: cutting them into ranges reads them twice, and what found them (joins, groups) would run as often."""
    rows = shared.written(parts.withColumn("_o", F.concat_ws("\u0000", *_PART)), "stale-parts")
    return admit(rows, "_o", "size", max_items, max_bytes).drop("_o")


def replaced(kept: DataFrame, read: DataFrame, new: DataFrame, seen: object) -> DataFrame:
    """Findings after parts were read: ``new`` ones in place of those that these parts had.

    ``kept`` has source, part, id, location, first_seen and any others; ``new`` the same but for location and first_seen, and
    ``fallback``.  New findings go where the part's findings were (the smallest location), else to ``fallback``; one that was
    there before keeps its first_seen, others get ``seen``."""
    touched = read.select(*_PART).distinct().withColumn("_read", F.lit(True))
    before = kept.groupBy(*_PART).agg(F.count("*").alias("_n"), F.min("location").alias("_where")).join(touched, _PART, "left")
    rows = attach(kept, before.select(*_PART, "_read", "_n"), _PART, "_n")
    stay = rows.where("_read IS NULL").select(*kept.columns)
    firsts = rows.where("_read").groupBy(*_PART, "id").agg(F.min("first_seen").alias("_first"))
    places = new.groupBy(*_PART).agg(F.count("*").alias("_n")).join(before.select(*_PART, "_where"), _PART, "left")
    put = attach(new, places, _PART, "_n").join(firsts, [*_PART, "id"], "left")
    kind = kept.schema["first_seen"].dataType
    put = put.withColumn("location", F.coalesce("_where", "fallback")).withColumn("first_seen", F.coalesce("_first", F.lit(seen).cast(kind)))
    return stay.unionByName(put.select(*kept.columns))


def recorded(index: DataFrame, read: DataFrame, profile: str, listing: DataFrame | None = None) -> DataFrame:
    """The index after a stretch: what was read, with its marker and the current profile; with the ``listing`` of a complete
    pass, without parts of its sources that it didn't meet."""
    new = read.select(*_PART, "marker", F.lit(profile).alias("profile"))
    rows = index.select(*new.columns).join(new.select(*_PART), _PART, "left_anti").unionByName(new)
    if listing is None:
        return rows
    met = listing.select(*_PART).distinct().withColumn("_met", F.lit(True))
    sources = listing.select("source").distinct().withColumn("_swept", F.lit(True))
    return rows.join(met, _PART, "left").join(sources, "source", "left").where("_met OR _swept IS NULL").select(*new.columns)
