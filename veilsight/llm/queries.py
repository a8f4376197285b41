"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, jaccard_join, language_id, mixing, mpeg_audio, packing, quality_classifier, quality_rules, store, token_files, toxicity, url_filter, vector_codes, whitening
from .training import fold


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, keep=fold("doc_id", 4) != 2)
    return quality_classifier.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = store.new_path(spark, "tokens")
    token_files.write(_read(spark, sf_dir, "documents").select("doc_id", "text"), target, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(spark, target)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster is a class of near copies (``jaccard_join``); texts without words, and classes without an id, are
    clusters of byte-equal texts."""
    docs = _read(spark, sf_dir, "documents")
    classes = jaccard_join.classes(docs).where("n_shingles > 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("component_id").cast("long").alias("component")).dropDuplicates(["_d", "_h"])
    sizes = docs.select("doc_id", mixing.n_words("text").alias("size"), "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash"))
    found = sizes.join(classes, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_h")), "left")
    units = store.table(found.select("doc_id", "size", "source", F.coalesce("component", "hash").alias("cluster")), "units")
    return packing.pack(units)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, keep=fold("doc_id", 5) != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "worst_word"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs, keep=fold("doc_id", 4) != 2)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


RULES = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    counted = store.table(quality_rules.statistics(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "stats"), "stats")
    return quality_rules.judge(counted).select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in quality_rules.FIELDS], "base_failed", "kept", "distance")


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), mpeg_audio.to_media("text").alias("media"))
    stored = store.table(docs, "media", codec="zstd")  # what is read below are the stored bytes
    read = mpeg_audio.with_features(stored)
    return read.select("doc_id", "n_bytes", *[f"audio.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration", "offsets", "error")])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words("text").alias("size"))
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_read(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


_ALL = (op1_quality_classifier, op2_token_files, op3_packing, op4_toxicity, op5_url_filter, op6_quality_rules, op7_mpeg_audio, op8_jaccard_join, op9_mixing, op10_language_id, op11_vector_codes, op12_exact_topk, op13_whitening)
QUERIES = {f.__name__: f for f in _ALL}

#: DuckDB SQL of those that SQL can express.
ORACLE: dict[str, str] = {"op5_url_filter": url_filter.oracle(RULES), "op11_vector_codes": vector_codes.oracle(), "op12_exact_topk": exact_topk.oracle()}
