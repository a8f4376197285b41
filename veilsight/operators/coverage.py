"""Coverage: what was read, what was not and why, what it holds and what reading the rest would cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_maps(column: str, key: Sequence[str], df: DataFrame) -> DataFrame:
    """Maps of counters, added up by key within each group."""
    each = df.select(*key, F.explode(column).alias("_k", "_v")).groupBy(*key, "_k").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))


def merge(runs: DataFrame, key: Sequence[str], counters: Sequence[str], last: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """Coverage of several calls of one source: counters add, the other fields are the last call's."""
    return runs.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counters], *[F.max_by(c, order).alias(c) for c in last])


# What a source's note says of its store, and errors that mean that access is denied.
NOTES = {
    "export_pending": ("deferred", "export_pending"), "no_grant": ("skipped", "no_grant"), "budget": ("deferred", "budget"), "no_snapshot": ("skipped", "no_snapshot"), "export_failed": ("error", "export_failed"),
    "vpc_only": ("skipped", "vpc_only"), "no_read_path": ("skipped", "no_read_path"), "user_can_write": ("skipped", "user_can_write"), "db_user_can_write": ("skipped", "db_user_can_write"),
    "grants_unverifiable": ("skipped", "grants_unverifiable"), "network": ("skipped", "network"), "access_denied": ("error", "access_denied"), "driver_missing": ("skipped", "driver_missing"),
    "requester_pays": ("skipped", "requester_pays"), "row_level_policy": ("skipped", "row_level_policy"), "scope_unverified": ("skipped", "scope_unverified"), "unscoped_grant": ("skipped", "unscoped_grant"),
    "protected_api": ("skipped", "protected_api"), "not_provisioned": ("skipped", "not_provisioned"), "throttled": ("deferred", "throttled"), "not_a_member": ("skipped", "not_a_member"), "not_implemented": ("skipped", "not_implemented"),
}
ACCESS_DENIED = ("AccessDenied", "AccessDeniedException", "UnauthorizedOperation", "AllAccessDisabled", "AuthorizationFailed", "AuthorizationPermissionMismatch", "Forbidden", "PERMISSION_DENIED", "ErrorAccessDenied", "Authorization_RequestDenied")


def settle(sources: DataFrame, store: Sequence[str], order: str = "source") -> DataFrame:
    """One row a store, from the coverage of its sources in a run: status (scanned, error, deferred or skipped), reason,
    error, backlog and gaps (a map of counts).

    sources: the store's key, ``order``, note, error, scanned, kms_denied, unreadable, unsupported, not_allowed, disguised and
    backlog.  The first known note decides; a store is in error if all of its sources are, and skipped formats are its reason if
    nothing else was there to read."""
    known = F.create_map(*[F.lit(x) for k, v in NOTES.items() for x in (k, F.struct(F.lit(v[0]).alias("status"), F.lit(v[1]).alias("reason")))])
    note = F.when(F.col("note").isin(*NOTES), F.col("note"))
    # of all notes the first one counts, known or not
    first = lambda value, when: F.min_by(value, F.when(when, F.col(order)))
    counters = ("scanned", "kms_denied", "unreadable", "unsupported", "not_allowed", "disguised")
    rows = sources.groupBy(*store).agg(
        F.count(F.lit(1)).alias("_n"), F.count("error").alias("_errors"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters], F.max("backlog").alias("backlog"),
        first(note, F.col("note").isNotNull()).alias("_note"), first(F.struct("error", "kms_denied"), F.col("error").isNotNull()).alias("_error"),
    )
    said = known[F.col("_note")]
    failed = F.col("_errors") == F.col("_n")
    named = F.when(F.coalesce(F.col("_error.kms_denied"), F.lit(0)) > 0, "kms_access").when(F.col("_error.error").isin(*ACCESS_DENIED), "access_denied").otherwise("error")
    status = F.when(F.col("_note").isNotNull(), said["status"]).when(failed, "error").otherwise("scanned")
    reason = F.when(F.col("_note").isNotNull(), said["reason"]).when(failed, named).when((F.col("scanned") == 0) & (F.col("unsupported") > 0) & (F.col("unreadable") == 0), "unsupported_format")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("notAllowed", "not_allowed"), ("disguised", "disguised"), ("kmsDenied", "kms_denied"), ("unreadable", "unreadable"), ("unsupportedFormat", "unsupported"))]), lambda e: e["value"] > 0)
    gaps_ = F.map_from_entries(F.when(F.col("_note").isNull(), pairs).otherwise(F.slice(pairs, F.lit(1), F.lit(0))))
    return rows.select(*store, status.alias("status"), reason.alias("reason"), F.when(status == "error", F.col("_error.error")).alias("error"), "backlog", gaps_.alias("gaps"))


def summary(stores: DataFrame) -> DataFrame:
    """Stores by status, by reason and by kind, in one pass over grouping sets."""
    return stores.groupingSets([["status"], ["reason"], ["kind"]], "status", "reason", "kind").agg(F.count(F.lit(1)).alias("stores"), F.sum("backlog").alias("backlog"))


def inventory(items: DataFrame, cls: str, size: str, planned: Column) -> DataFrame:
    """Objects, bytes and bytes to be read by storage class."""
    return items.groupBy(cls).agg(F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes"), F.sum(F.when(planned, F.col(size)).otherwise(0)).alias("planned"))


def cost(rows: DataFrame, prices: DataFrame, cls: str, region: Column, default_region: str) -> DataFrame:
    """Adds the cost of reading each storage class, from prices (class, region, per_gib, per_1000).

    A region without a price takes the default region's, and says so in ``fallback``.  ``prices`` is a
    list of classes by regions; it is joined as it is, and broadcast where Spark sees that it is small."""
    at = prices.select(F.col("class").alias("_c"), F.col("region").alias("_r"), F.col("per_gib").alias("_g"), F.col("per_1000").alias("_k"))
    usual = prices.where(F.col("region") == default_region).select(F.col("class").alias("_dc"), F.col("per_gib").alias("_dg"), F.col("per_1000").alias("_dk"))
    out = rows.withColumn("_region", region).join(at, (F.col(cls) == F.col("_c")) & (F.col("_region") == F.col("_r")), "left").join(usual, F.col(cls) == F.col("_dc"), "left")
    price = F.col("planned") / F.lit(1 << 30) * F.coalesce("_g", "_dg") + F.col("objects") / F.lit(1000) * F.coalesce("_k", "_dk")
    return out.withColumn("cost", F.round(price, 4)).withColumn("fallback", F.col("_c").isNull()).drop("_c", "_r", "_g", "_k", "_dc", "_dg", "_dk", "_region")


def scope(findings: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Locations by framework: ``rules`` are (framework, classes); findings have id, cls and encrypted."""
    pairs = F.array(*[F.struct(F.lit(f).alias("framework"), F.lit(c).alias("cls")) for f, classes in rules for c in classes])
    hit = findings.select("id", "encrypted", F.explode(F.filter(pairs, lambda p: p["cls"] == F.col("cls"))).alias("p"))
    return hit.groupBy("p.framework").agg(F.count_distinct("id").alias("locations"), F.count_distinct(F.when(~F.col("encrypted"), F.col("id"))).alias("unencrypted"))


def _gap(kind: str, entry: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), entry["key"].alias("reason"), entry["value"].cast("long").alias("n"))


def gaps(runs: DataFrame, maps: Sequence[str] = ("skipped", "not_allowed", "archived"), counters: Sequence[str] = ("unreadable", "kms_denied", "partial", "sampled_out")) -> DataFrame:
    """What wasn't read and why, over all runs: kind (the column), reason (a map's key; null for a counter) and n.

    All columns become rows of one scan and one sum.  Null maps and counters add nothing, and a sum of 0 has no row."""
    of_map = [F.transform(F.map_entries(m), partial(_gap, m)) for m in maps]
    of_counter = F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(None).cast("string").alias("reason"), F.col(c).cast("long").alias("n")) for c in counters])
    empty = F.slice(of_counter, 1, 0) if counters else F.array().cast("array<struct<kind:string,reason:string,n:bigint>>")
    each = runs.select(F.explode(F.concat(*[F.coalesce(m, empty) for m in of_map], of_counter if counters else empty)).alias("g")).select("g.*")
    return each.groupBy("kind", "reason").agg(F.sum("n").alias("n")).where("n <> 0")


def profile_counts(index: DataFrame, keys: Sequence[str] = ("profile", "flags")) -> DataFrame:
    """How many items each component profile has read, by flags."""
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))


# Storage classes that can't be read as they are, and the names of archive tiers
ARCHIVED = ("GLACIER", "DEEP_ARCHIVE")
TIERS = {
    "ARCHIVE": "INTELLIGENT_TIERING_ARCHIVE_ACCESS",
    "ARCHIVE_ACCESS": "INTELLIGENT_TIERING_ARCHIVE_ACCESS",
    "DEEP_ARCHIVE": "INTELLIGENT_TIERING_DEEP_ARCHIVE_ACCESS",
    "DEEP_ARCHIVE_ACCESS": "INTELLIGENT_TIERING_DEEP_ARCHIVE_ACCESS",
}


def storage_class(platform: Column, listed: Column, tier: Column, restored: Column) -> Column:
    """The class an object is filed under, by platform (s3, azure, gcs), from its listing.

    ``tier`` is the access tier or the archive status; ``restored`` says that a restored copy can be read."""
    name = F.upper(F.coalesce(F.nullif(listed, F.lit("")), F.lit("STANDARD")))
    by_tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.upper(F.coalesce(tier, F.lit("")))]
    s3 = F.when(name.isin(*ARCHIVED) & F.coalesce(restored, F.lit(False)), F.concat(name, F.lit("_RESTORED"))).when(name == "INTELLIGENT_TIERING", F.coalesce(by_tier, name)).otherwise(name)
    given = F.trim(F.coalesce(listed, F.lit("")))
    azure = F.when(F.lower(tier).startswith("rehydrate-pending"), "Archive").when(given == "", "Premium").otherwise(F.concat(F.upper(F.substring(given, 1, 1)), F.lower(F.substring(given, 2, 1 << 20))))
    return F.when(platform == "azure", azure).when(platform == "gcs", name).otherwise(s3)


def storage_rule(platform: Column, cls: Column, instant: bool = False, cold: bool = False, archive: bool = False) -> Column:
    """Why objects of a class aren't read; null where they are.  The settings allow instant-access
    archives (s3), cold tiers (azure) and archives (gcs)."""
    s3 = F.when((cls == "GLACIER_IR") & F.lit(not instant), "archive_class").when(cls.isin(*ARCHIVED, *set(TIERS.values())), "needs_restore")
    azure = F.when((cls == "Cold") & F.lit(not cold), "cold_tier").when(cls == "Archive", "needs_rehydration")
    gcs = F.when((cls == "ARCHIVE") & F.lit(not archive), "archive_class")
    return F.when(platform == "azure", azure).when(platform == "gcs", gcs).otherwise(s3)
