"""Findings of other scanners: their reports as findings, with their types mapped to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Another scanner's type names and their classes.
TYPES = {
    "CREDIT_CARD_NUMBER": "card",
    "CREDIT_CARD_NUMBER_(NO_KEYWORD)": "card",
    "CREDIT_CARD_MAGNETIC_STRIPE": "card",
    "CREDIT_CARD_SECURITY_CODE": "cvv",
    "USA_SOCIAL_SECURITY_NUMBER": "us_ssn",
    "USA_INDIVIDUAL_TAX_IDENTIFICATION_NUMBER": "us_itin",
    "DATE_OF_BIRTH": "dob",
    "BANK_ACCOUNT_NUMBER": "account_number",
    "USA_BANK_ACCOUNT_NUMBER": "account_number",
}

_FOUND = "struct<type:string,name:string,count:bigint>"
REPORT = f"struct<classificationDetails:struct<result:struct<sensitiveData:array<struct<detections:array<{_FOUND}>>>,customDataIdentifiers:struct<detections:array<{_FOUND}>>>>>"


def type_name(raw: Column) -> Column:
    """A vendor's type without odd characters or long digit runs, of at most 80 characters."""
    return F.left(T.redact(F.regexp_replace(raw, r"[^A-Za-z0-9_ .:()/-]", "_")), F.lit(80))


def findings(reports: DataFrame, types: dict[str, str] = TYPES) -> DataFrame:
    """(location, doc) reports as one row a location, class and vendor type, with counts and no offsets.

    Types without a class, and custom ones, are ``other`` and keep their name."""
    none = F.array().cast(f"array<{_FOUND}>")
    d = F.col("d.classificationDetails.result")
    known = F.flatten(F.transform(F.coalesce(d["sensitiveData"], F.array().cast(f"array<struct<detections:array<{_FOUND}>>>")), lambda g: F.coalesce(g["detections"], none)))
    pair = lambda custom: lambda x: F.struct((x["name"] if custom else x["type"]).alias("type"), x["count"].alias("n"), F.lit(custom).alias("custom"))
    every = F.concat(F.transform(known, pair(False)), F.transform(F.coalesce(d["customDataIdentifiers"]["detections"], none), pair(True)))
    rows = reports.select("location", F.from_json("doc", REPORT).alias("d")).select("location", F.explode(every).alias("x"))
    cls = F.lit(None).cast("string")
    for name, to in types.items():
        cls = F.when(F.col("x.type") == name, to).otherwise(cls)
    cls = F.coalesce(F.when(~F.col("x.custom"), cls), F.lit("other"))
    name = F.when(cls == "other", F.left(F.concat(F.when(F.col("x.custom"), "custom:").otherwise(""), type_name(F.col("x.type"))), F.lit(80)))
    n = F.greatest(F.coalesce("x.n", F.lit(0)), F.lit(0))
    out = rows.select("location", cls.alias("cls"), name.alias("vendor_type"), n.alias("n")).groupBy("location", "cls", "vendor_type").agg(F.sum("n").alias("count"))
    return out.select("location", "cls", "vendor_type", "count", F.col("count").alias("occurrences"), F.lit("medium").alias("confidence"), F.array(F.lit("vendor")).alias("via"), T.severity(F.col("cls")).alias("severity"))
