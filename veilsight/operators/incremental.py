"""Incremental passes: what to read again, what to skip, what is a copy, what fits the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from ..functions.validators import any_of
from .joins import attach


def glob(pattern: str) -> str:
    """A glob as a regular expression; * also matches /."""
    out = ""
    for ch in pattern:
        out += ".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not (ch.isalnum() or ch in "_/ ") else ch
    return f"^(?s:{out})$"


def allowed(stores: DataFrame, allow: Sequence[tuple] = (), deny: Sequence[tuple] = ()) -> DataFrame:
    """Adds ``allowed``: rules are (kind, glob of the name) or (kind, tag, glob of its value, None for any); a deny rule
    wins, and a kind with allow rules needs one that fits.

    A kind of * holds for all.  Tags are the map ``tags``; where it is null they couldn't be read, so a store that a tag rule might deny
    isn't allowed, and no allow rule over tags fits."""
    of_kind = lambda r: (F.lit(r[0]) == "*") | (F.col("kind") == r[0])

    def fits(r: tuple) -> Column:
        if len(r) == 2:
            return of_kind(r) & F.col("name").rlike(glob(r[1]))
        value = F.try_element_at("tags", F.lit(r[1]))
        good = F.array_contains(F.map_keys("tags"), r[1]) if r[2] is None else value.rlike(glob(r[2]))
        return of_kind(r) & F.coalesce(good, F.lit(False))

    kinds = [r[0] for r in allow]
    restricted = F.lit("*" in kinds) | F.col("kind").isin(*kinds) if kinds else F.lit(False)
    unsure = any_of([of_kind(r) & F.col("tags").isNull() for r in deny if len(r) == 3])
    return stores.withColumn("allowed", ~any_of([fits(r) for r in deny]) & ~unsure & (~restricted | any_of([fits(r) for r in allow])))


def sample_share(items: DataFrame, key: str, rules: Sequence[tuple[str, int]], default: int = 100) -> DataFrame:
    """Adds ``sampled``: whether the key's stable bucket is below the percentage of the first glob that fits."""
    share = F.lit(default)
    for pattern, percent in reversed(list(rules)):
        share = F.when(F.col(key).rlike(glob(pattern)), percent).otherwise(share)
    return items.withColumn("sampled", T.sample_point(F.col(key)) < share)


def decide(listing: DataFrame, index: DataFrame, profile: str, watermark: Column | None = None) -> DataFrame:
    """Adds ``decision`` to a listing (key, marker, modified): read, rescan or skip.

    ``index`` has key, marker and profile of the last read.  No row: read, unless the item is older
    than the watermark of a complete pass (``unindexed``).  Another marker: read.  Another
    profile (versions of what read it): rescan.  Else skip."""
    known = index.select(F.col("key").alias("_key"), F.col("marker").alias("_marker"), F.col("profile").alias("_profile"))
    rows = listing.join(known, F.col("key") == F.col("_key"), "left")
    old = (F.col("modified") < watermark) if watermark is not None else F.lit(False)
    decision = (
        F.when(F.col("_key").isNull(), F.when(old, "unindexed").otherwise("read"))
        .when(~F.col("marker").eqNullSafe(F.col("_marker")), "read")
        .when(F.col("_profile") != profile, "rescan")
        .otherwise("skip")
    )
    return rows.withColumn("decision", decision).drop("_key", "_marker", "_profile")


def absent(index: DataFrame, listing: DataFrame, key: str = "key") -> DataFrame:
    """Index rows that the listing no longer has."""
    return index.join(listing.select(key).distinct(), key, "left_anti")


def duplicates(items: DataFrame, content: Column, order: str, alike: Sequence[str] = ()) -> DataFrame:
    """Adds fingerprint and duplicate_of: the first item (by ``order``) with the same content.

    The first is found by a reduced aggregate; a content that a third of all items share is joined back where its
    items are (``joins.attach``).  Null contents are nobody's copy."""
    rows = items.withColumn("fingerprint", F.md5(content.cast("binary")))
    by = ["fingerprint", *alike]
    first = rows.where(F.col("fingerprint").isNotNull()).groupBy(*by).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    out = attach(rows, first, by, "_n")
    return out.withColumn("duplicate_of", F.when(F.col("_first") != F.col(order), F.col("_first"))).drop("_first")


def copy_findings(findings: DataFrame, copies: DataFrame, location: str) -> DataFrame:
    """The originals' findings for their copies; ``copies`` has location and duplicate_of."""
    pairs = copies.where(F.col("duplicate_of").isNotNull()).select(F.col(location).alias("_copy"), F.col("duplicate_of").alias("_from"))
    return findings.join(pairs, F.col(location) == F.col("_from")).withColumn(location, F.col("_copy")).withColumnRenamed("_from", "duplicate_of").drop("_copy")


def first_per(items: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` items of each group."""
    turn = Window.partitionBy(group).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= n)


def running_total(items: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Adds ``total_<value>`` for each value: its sum over the items up to this one by ``order``.

    Items are cut into ranges of ``order`` by Spark, as many as the session's shuffles have partitions; the ranges'
    sums are added up first, and each range then runs on its own, so no task has all items."""
    ranged = shared.written(items.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values]).collect()  # one row a range
    begin, so_far = {}, dict.fromkeys(values, 0)
    for r in sorted(sums, key=lambda r: r["_range"]):
        begin[r["_range"]] = dict(so_far)
        so_far = {v: so_far[v] + (r[f"_s_{v}"] or 0) for v in values}
    ahead = lambda v: F.get(F.array(*[F.lit(begin.get(k, {}).get(v, 0)) for k in range(max(begin, default=0) + 1)]), F.col("_range"))
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.select(*items.columns, *[(ahead(v) + F.sum(v).over(own)).alias(f"total_{v}") for v in values])


def admit(items: DataFrame, order: str, size: str, max_items: int, max_bytes: int) -> DataFrame:
    """The items that a budget takes: in order, up to the first that doesn't fit; the first always fits."""
    rows = running_total(items.withColumn("_one", F.lit(1)), order, ["_one", size])
    over = (F.col("total__one") > 1) & ((F.col("total__one") > max_items) | (F.col(f"total_{size}") > max_bytes))
    stop = rows.where(over).agg(F.min(order)).first()[0]
    taken = rows if stop is None else rows.where(F.col(order) < F.lit(stop))
    return taken.drop("_one").withColumnRenamed("total__one", "position").withColumnRenamed(f"total_{size}", "total_size")


def latest(items: DataFrame, group: str, at: str) -> DataFrame:
    """The latest item of each group, and how many older ones there are."""
    whole = F.struct(*items.columns)
    return items.groupBy(group).agg(F.max_by(whole, F.col(at)).alias("_r"), (F.count(F.lit(1)) - 1).alias("older")).select("_r.*", "older")


def rescans(stale: DataFrame, order: str, size: str, max_items: int, max_bytes: int, percent: int = 25) -> DataFrame:
    """The stale items that a pass reads again: in order, within a share of its budget; the rest are backlog."""
    share = max(0, min(100, percent))
    items = max(1, max_items * share // 100) if share and max_items else 0
    taken = admit(stale, order, size, items, max_bytes * share // 100)
    return taken.limit(0) if not items else taken


def table_changes(listing: DataFrame, index: DataFrame, now: Column, max_days: int = 7) -> DataFrame:
    """Adds ``decision`` to tables (key, marker): skip those whose marker is as it was and that were
    read less than ``max_days`` ago (index: key, marker, read_at); read the others, and those without a marker."""
    known = index.select(F.col("key").alias("_key"), F.col("marker").alias("_marker"), F.col("read_at").alias("_at"))
    rows = listing.join(known, F.col("key") == F.col("_key"), "left")
    same = (F.col("marker") == F.col("_marker")) & (F.datediff(now, F.col("_at")) < max_days)
    return rows.withColumn("decision", F.when(same, "skip").otherwise("read")).drop("_key", "_marker", "_at")


def by_fingerprint(index: DataFrame) -> DataFrame:
    """fingerprint -> key of the first readable item that is nobody's copy (flags: 8 copy, 16 unreadable)."""
    good = index.where((F.col("flags").bitwiseAND(F.lit(24)) == 0) & F.col("fingerprint").isNotNull())
    return good.groupBy("fingerprint").agg(F.min("key").alias("key"))


#: Fixed values, the flags of an index row: not what its name claims, read as a conversation, read as text.
DISGUISED, CONVERSATION, TEXT = 1, 2, 4


def stale_reason(index: DataFrame, now: dict[str, str], adapters: dict[str, str], readers: dict[str, str], classes: dict[str, str], reads: Sequence[str] = ()) -> DataFrame:
    """Adds ``stale`` to index rows: the first component that has changed and could change the result, else null.

    Rows have scheme, adapter, adapter_v, readers (map name to version), unread (array of kinds),
    sniffer_v, detected, standalone_v, classes (map), conversation_v and flags.  ``now`` has the present
    scheme, sniffer, standalone and conversation; ``reads`` the kinds that can be read now.  In order: adapter
    (under the same scheme), reader, new_reader, sniffer (where the kind was unknown or disputed), standalone
    (engine or any class, for texts), conversation.  Null maps and arrays are empty."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.expr("cast(map() as map<string, string>)")
    flag = lambda n: F.col("flags").bitwiseAND(F.lit(n)) != 0
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    current, known, latest_classes = lookup(adapters), lookup(readers), lookup(classes)
    adapter = current[F.col("adapter")].isNotNull() & ~F.col("adapter_v").eqNullSafe(current[F.col("adapter")]) & (F.col("scheme") == now["scheme"])
    reader = F.exists(F.map_entries("readers"), lambda e: ~F.coalesce(known[e["key"]] == e["value"], F.lit(False)))
    new_reader = F.arrays_overlap("unread", F.array(*[F.lit(k) for k in reads]).cast("array<string>"))
    sniffer = differs("sniffer_v", now["sniffer"]) & (F.col("detected").isNull() | (F.col("detected") == "binary") | flag(DISGUISED))
    had = F.coalesce(F.col("classes"), F.expr("cast(map() as map<string, string>)"))
    new_class = F.exists(F.map_entries(latest_classes), lambda e: ~F.coalesce(F.element_at(had, e["key"]) == e["value"], F.lit(False)))
    standalone = flag(TEXT) & (differs("standalone_v", now["standalone"]) | new_class)
    spoken = flag(CONVERSATION) & differs("conversation_v", now["conversation"])
    reason = F.when(adapter, "adapter").when(reader, "reader").when(new_reader, "new_reader").when(sniffer, "sniffer").when(standalone, "standalone").when(spoken, "conversation")
    return index.withColumn("stale", reason)


def write_grants(grants: DataFrame, reads: Sequence[str], principal: str = "principal", privilege: str = "privilege") -> DataFrame:
    """Principals that hold more than reading: each with ``writes``, its privileges outside the list ``reads``.

    A list of what may be held, so an unknown or null privilege refuses; case and outer spaces don't matter."""
    name = F.upper(F.trim(F.coalesce(F.col(privilege), F.lit("unknown"))))
    rows = grants.select(F.col(principal), name.alias("_p")).where(~F.col("_p").isin(*[r.upper() for r in reads]))
    return rows.groupBy(principal).agg(F.array_sort(F.collect_set("_p")).alias("writes"))


def fingerprint_of(listed: Column) -> Column:
    """A listing's MD5 as ``md5:<hex>``, from hex (an entity tag, quoted or not) or base64; null if it is neither."""
    plain = F.lower(F.regexp_replace(F.trim(listed), '^"+|"+$', ""))
    based = F.lower(F.hex(F.try_to_binary(F.trim(listed), F.lit("base64"))))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.concat(F.lit("md5:"), plain)).when(F.length(based) == 32, F.concat(F.lit("md5:"), based))


def segment(items: DataFrame, key: str, percent: int) -> DataFrame:
    """One of the round(100 / percent) segments that a key-value store's items are read by."""
    n = max(1, round(100 / percent))
    return items.where(F.pmod(F.xxhash64(key), F.lit(n)) == 0)


def carried(previous: DataFrame, read: DataFrame, key: Sequence[str], this_pass: Column) -> DataFrame:
    """Rows of the last pass whose places haven't changed, as members of this one; ``read`` has the places read anew."""
    return previous.join(read.select(*key).distinct(), list(key), "left_anti").withColumn("pass", this_pass)
