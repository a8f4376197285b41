"""Queries over files, logs and stores made from the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .operators import coverage, export, findings, incremental
from .registry import query, read
from .sources import archives, avro, delimited, files, json_leaves
from .streaming import logs, versions

_STORED = (
    ("s3", None, None, None, "STANDARD", None), ("s3", "glacier", None, False, "GLACIER", "needs_restore"), ("s3", "GLACIER", None, True, "GLACIER_RESTORED", None), ("s3", "GLACIER_IR", None, None, "GLACIER_IR", "archive_class"),
    ("s3", "INTELLIGENT_TIERING", "archive_access", None, "INTELLIGENT_TIERING_ARCHIVE_ACCESS", "needs_restore"), ("s3", "INTELLIGENT_TIERING", None, None, "INTELLIGENT_TIERING", None), ("azure", "cold", None, None, "Cold", "cold_tier"),
    ("azure", "Hot", None, None, "Hot", None), ("azure", "Hot", "rehydrate-pending-to-hot", None, "Archive", "needs_rehydration"), ("azure", "", None, None, "Premium", None), ("gcs", "archive", None, None, "ARCHIVE", "archive_class"), ("gcs", None, None, None, "STANDARD", None),
)


def _sql(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _picked(rows: tuple, k: int) -> str:
    return "[" + ", ".join(_sql(r[k]) for r in rows) + "]"


def _literals(rows: tuple, names: str, key: str) -> list:
    """Columns with the values of the row that a key falls on."""
    at = (F.col(key) % len(rows) + 1).cast("int")
    return [F.element_at(F.array(*[F.lit(r[i]) for r in rows]), at).alias(n) for i, n in enumerate(names.split(","))]


@query(f"""
WITH c AS (SELECT {_picked(_STORED, 0)}[(o_orderkey % 12 + 1)::INT] AS platform, {_picked(_STORED, 4)}[(o_orderkey % 12 + 1)::INT] AS cls, {_picked(_STORED, 5)}[(o_orderkey % 12 + 1)::INT] AS reason, o_custkey FROM orders)
SELECT platform, cls, reason, count(*) AS objects, sum(o_custkey)::BIGINT AS bytes FROM c GROUP BY ALL""")
def storage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by storage class, and why those of a class aren't read."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", *_literals(_STORED, "platform,listed,tier,restored", "o_orderkey"))
    named = rows.withColumn("cls", coverage.storage_class(F.col("platform"), F.col("listed"), F.col("tier"), F.col("restored")))
    return named.withColumn("reason", coverage.storage_rule(F.col("platform"), F.col("cls"))).groupBy("platform", "cls", "reason").agg(F.count(F.lit(1)).alias("objects"), F.sum("o_custkey").alias("bytes"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 's3' WHEN 1 THEN 'rds' WHEN 2 THEN 'azure_blob' WHEN 3 THEN 'redshift' ELSE 'queue' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'b' || o_custkey WHEN 1 THEN 'x' || o_custkey WHEN 2 THEN 'a' || o_custkey WHEN 3 THEN 's' || o_custkey ELSE '' END AS store,
  CASE o_orderkey % 5 WHEN 0 THEN 'k' || o_orderkey || ' > a.csv > column c' WHEN 1 THEN 'd.t' || o_orderkey || '.c' WHEN 2 THEN 'p' || o_orderkey WHEN 3 THEN 't' || o_orderkey ELSE 'a=' || o_orderkey || ', b=' || o_custkey END AS location,
  CASE o_orderkey % 5 WHEN 0 THEN 's3_object,b' || o_custkey || ',k' || o_orderkey WHEN 2 THEN 'blob_object,a' || o_custkey || ',p' || o_orderkey WHEN 3 THEN 'store_field,redshift,s' || o_custkey || ',t' || o_orderkey END AS place
FROM orders""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, store and location of findings by their resources, and the keys that sources are compared by."""
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    m = lambda **f: F.create_map(*[x for n, v in f.items() for x in (F.lit(n), v if not isinstance(v, str) else F.lit(v))])
    with_ = lambda mark, v: F.concat(F.lit(mark), v)
    resource = (
        F.when(F.col("o_orderkey") % 5 == 0, m(type="s3_object", bucket=with_("b", c), key=with_("k", k), archiveEntry="a.csv", column="c"))
        .when(F.col("o_orderkey") % 5 == 1, m(type="rds_column", cluster=with_("x", c), database="d", table=with_("t", k), column="c"))
        .when(F.col("o_orderkey") % 5 == 2, m(type="blob_object", account=with_("a", c), container="", blob=with_("p", k)))
        .when(F.col("o_orderkey") % 5 == 3, m(type="store_field", service="redshift", store=with_("s", c), table=with_("t", k)))
        .otherwise(m(type="queue", b=c, a=k))
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", resource.alias("r"))
    key = F.array_join(F.filter(findings.location_key(F.col("r")), lambda x: x != ""), ",")
    return rows.select("o_orderkey", F.inline(F.array(findings.place(F.col("r")))), key.alias("place"))


_FILES = (
    ("a.pdf", "255044462D312E34", "pdf", False), ("a.txt", "504B030400", "zip", True), ("b.csv", "612C620A", "text", False), ("c.docx", "504B030400", "zip", False), ("d.png", "612C620A", "text", True),
    ("e", "00010203", "binary", False), ("f.txt", "", "empty", False), ("g.parquet", "50415231AA", "parquet", False), ("h.csv", "89504E47", "png", True), ("i.gz", "1F8B08", "gzip", False),
)


@query(f"""SELECT {_picked(_FILES, 2)}[(p_partkey % {len(_FILES)} + 1)::INT] AS kind, {_picked(_FILES, 3)}[(p_partkey % {len(_FILES)} + 1)::INT] AS hidden, count(*) AS files, sum(p_size)::BIGINT AS sizes FROM part GROUP BY ALL""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their first bytes, and those that aren't what their name claims."""
    rows = read(spark, sf_dir, "part").select("p_size", *_literals(_FILES, "path,x", "p_partkey")).withColumn("kind", files.sniff(F.unhex("x")))
    return rows.groupBy("kind", files.disguised(files.named(F.col("path")), F.col("kind")).alias("hidden")).agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").alias("sizes"))


@query("""
SELECT event_id, 'json' AS form, props AS text FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'head', 'INFO ' || event_type || ' ' FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'json', props FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'line', event_type || ' {' FROM events WHERE event_id % 3 = 2""")
def log_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, cut where they end in JSON."""
    message = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("INFO "), "event_type", F.lit(" "), "props")).otherwise(F.concat("event_type", F.lit(" {")))
    return read(spark, sf_dir, "events").select("event_id", F.inline(logs.parts(message)))


@query("""
WITH s AS (SELECT o_custkey AS store, o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'budget' WHEN o_orderkey % 31 = 0 THEN 'hello' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 'AccessDenied' WHEN o_orderkey % 7 = 0 THEN 'Timeout' END AS error,
  (o_orderkey % 4)::BIGINT AS scanned, (o_orderkey % 2)::BIGINT AS unsupported, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS kms, o_orderkey % 5 = 0 AS backlog FROM orders),
g AS (SELECT store, arg_min(note, o_orderkey) FILTER (note IS NOT NULL) AS note, count(error) = count(*) AS failed, arg_min(error, o_orderkey) FILTER (error IS NOT NULL) AS error, arg_min(kms, o_orderkey) FILTER (error IS NOT NULL) AS first_kms, sum(scanned) AS scanned, sum(unsupported)::BIGINT AS unsupported, sum(kms)::BIGINT AS kms, bool_or(backlog) AS backlog FROM s GROUP BY store)
SELECT store, CASE WHEN note = 'budget' THEN 'deferred' WHEN failed THEN 'error' ELSE 'scanned' END AS status,
  CASE WHEN note = 'budget' THEN 'budget' WHEN failed THEN CASE WHEN first_kms > 0 THEN 'kms_access' WHEN error = 'AccessDenied' THEN 'access_denied' ELSE 'error' END WHEN scanned = 0 AND unsupported > 0 THEN 'unsupported_format' END AS reason,
  CASE WHEN coalesce(note, '') <> 'budget' AND failed THEN error END AS error, backlog, CASE WHEN coalesce(note, '') = 'budget' THEN NULL WHEN kms > 0 THEN kms END AS kms_denied, CASE WHEN coalesce(note, '') = 'budget' THEN NULL WHEN unsupported > 0 THEN unsupported END AS unsupported FROM g""")
def settled_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's status, reason and gaps from its sources' coverage."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("store"), k.alias("source"), F.when(k % 29 == 0, "budget").when(k % 31 == 0, "hello").alias("note"), F.when(k % 3 == 0, "AccessDenied").when(k % 7 == 0, "Timeout").alias("error"),
        (k % 4).alias("scanned"), (k % 2).alias("unsupported"), (k % 11 == 0).cast("int").alias("kms_denied"), *[F.lit(0).alias(c) for c in ("unreadable", "not_allowed", "disguised")], (k % 5 == 0).alias("backlog"))
    return coverage.settle(rows, ["store"]).select("store", "status", "reason", "error", "backlog", F.try_element_at("gaps", F.lit("kmsDenied")).alias("kms_denied"), F.try_element_at("gaps", F.lit("unsupportedFormat")).alias("unsupported"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, n_chars::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
p AS (SELECT doc_id, i, n + 5000 AS used, 0::BIGINT AS part FROM d WHERE i = 1 UNION ALL
  SELECT d.doc_id, d.i, CASE WHEN p.used + d.n > 60000 THEN 5000 + d.n ELSE p.used + d.n END, p.part + CASE WHEN p.used + d.n > 60000 THEN 1 ELSE 0 END FROM p JOIN d ON d.i = p.i + 1)
SELECT doc_id, part FROM p""")
def push_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in parts of bounded size, each filled before the next begins."""
    return export.parts(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 60_000, 5_000).select("doc_id", "part")


def _csv(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """One text a nation with its customers in order: a header, quoted names, an empty cell now and then."""
    line = F.concat(F.lit('"'), "c_name", F.lit(f'""x"{mark}'), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit(mark), F.col("c_custkey").cast("string"), F.lit("\r\n"))
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("l"))
    return rows.select("c_nationkey", F.concat(F.lit(f"name{mark}segment{mark}key\n"), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("text"))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS row, sum(length(c_name) + 9 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE length(c_mktsegment) END + length(c_custkey::VARCHAR)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS upto FROM customer),
b AS (SELECT *, (17 + upto - (length(c_name) + 9 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE length(c_mktsegment) END + length(c_custkey::VARCHAR)))::INT AS pos FROM c)
SELECT c_nationkey, row, 'name' AS "column", pos + 1 AS start, c_name || '""x' AS text FROM b UNION ALL SELECT c_nationkey, row, 'segment', pos + length(c_name) + 6, c_mktsegment FROM b WHERE c_custkey % 3 > 0
UNION ALL SELECT c_nationkey, row, 'key', pos + length(c_name) + 7 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE length(c_mktsegment) END, c_custkey::VARCHAR FROM b""")
def csv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of CSV texts with their column's name and their place."""
    return delimited.cells(_csv(spark, sf_dir, ","), ["c_nationkey"]).where("row > 0").select("c_nationkey", "row", "column", "start", "text")


@query("""SELECT 'key' AS "column", count(*) AS cells, sum(length(c_custkey::VARCHAR))::BIGINT AS chars FROM customer UNION ALL SELECT 'name', count(*), sum(length(c_name) + 3)::BIGINT FROM customer
UNION ALL SELECT 'segment', count(*), sum(length(c_mktsegment))::BIGINT FROM customer WHERE c_custkey % 3 > 0""")
def tsv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tab-separated texts by column."""
    return delimited.cells(_csv(spark, sf_dir, "\t"), ["c_nationkey"], delimiter="\t").where("row > 0").groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.length("text")).alias("chars"))


@query("""
WITH s AS (SELECT *, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS row FROM supplier)
SELECT s_nationkey, row, 'id' AS "column", s_suppkey::VARCHAR AS text FROM s UNION ALL SELECT s_nationkey, row, 'called', s_name FROM s""")
def catalog_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of texts without a header, with the columns that a catalog names."""
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(";"), "s_name")
    rows = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("l"))
    texts = rows.select("s_nationkey", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return delimited.cells(texts, ["s_nationkey"], delimiter=";", names=["id", "called"]).select("s_nationkey", "row", "column", "text")


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS line FROM customer)
SELECT c_nationkey, '/' || line || '/name' AS pointer, 'name' AS name, c_name AS text FROM c UNION ALL SELECT c_nationkey, '/' || line || '/of/0/k~1y', 'k/y', c_custkey::VARCHAR FROM c""")
def json_line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of JSON Lines by line and pointer (R6, R7, F22); a broken line gives none."""
    line = F.to_json(F.struct(F.col("c_name").alias("name"), F.array(F.struct(F.col("c_custkey").alias("k/y"))).alias("of"), F.lit(True).alias("yes")))
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("l"))
    return delimited.lines(rows.select("c_nationkey", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n{broken")).alias("text")), ["c_nationkey"])


def _packed(kind: str, texts: DataFrame) -> DataFrame:
    """Texts (path, text) as archives: a zip with a gzip inside, or an office document."""

    def pack(text: str) -> bytes:
        import gzip
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if kind == "zip":
                z.writestr("all.txt.gz", gzip.compress(text.encode(), mtime=0))
                z.writestr("plain.txt", text)
            else:
                rows = "".join(f"<w:p><w:r><w:t>{line.replace('&', '&amp;').replace('<', '&lt;')}</w:t></w:r></w:p>" for line in text.split("\n"))
                z.writestr("word/document.xml", f"<w:document><w:body>{rows}</w:body></w:document>")
                z.writestr("word/styles.xml", "<x>not text</x>")
        return out.getvalue()

    @F.arrow_udf("binary")
    def packed(parts: pa.Array) -> pa.Array:
        return pa.array([pack(t) for t in parts.to_pylist()], pa.binary())

    return texts.select("path", packed(F.col("text")).alias("content"))


def _tar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tar for each nation with a file for each customer's name, in blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tarfile
        from itertools import groupby

        schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("content", pa.binary())])
        size, names = archives.BLOCK, ((path.as_py(), name.as_py()) for b in batches for path, name in zip(b.column(0), b.column(1), strict=True))
        for path, group in groupby(names, key=lambda x: x[0]):
            held, block = bytearray(), 0
            for i, (_, name) in enumerate(group):
                info, raw = tarfile.TarInfo(f"f{i}.txt"), name.encode()
                info.size = len(raw)
                held += info.tobuf() + raw + bytes(-len(raw) % 512)
                while len(held) >= size:
                    yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "content": bytes(held[:size])}], schema)
                    del held[:size]
                    block += 1
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "content": bytes(held) + bytes(1024)}], schema)

    rows = read(spark, sf_dir, "customer").where("c_name IS NOT NULL").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), "c_name")
    return rows.repartition("path").sortWithinPartitions("path", "c_name").mapInArrow(packed, "path string, block long, content binary")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("l"))
    return rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.array_join("l", "\n").alias("text"))


_LINES = "l AS (SELECT 'n' || c_nationkey AS path, string_agg(c_name, chr(10) ORDER BY c_name) AS text FROM customer GROUP BY c_nationkey)"


@query(f"""WITH {_LINES} SELECT path, 'all.txt.gz' AS entry, '0/0' AS place, text FROM l UNION ALL SELECT path, 'plain.txt', '1', text FROM l""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives, and of an archive in there."""
    return archives.entries(_packed("zip", _names(spark, sf_dir)), depth=3).select("path", "entry", "place", F.decode("content", "UTF-8").alias("text"))


@query("""SELECT 'n' || c_nationkey AS path, 'f' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1) || '.txt' AS entry, c_name AS text FROM customer""")
def tar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular files of tar archives."""
    return archives.tar_entries(_tar_blocks(spark, sf_dir)).select("path", "entry", F.decode("content", "UTF-8").alias("text"))


@query(f"""WITH {_LINES} SELECT path, text || chr(10) AS text FROM l""")
def office_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of office documents."""
    return files.office_text(archives.entries(_packed("docx", _names(spark, sf_dir)))).select("path", "text")


def _avro(texts: DataFrame) -> DataFrame:
    """Lines of texts (path, text) as container files of records, by turns of each codec."""

    def number(n: int) -> bytes:
        n, out = n << 1 ^ n >> 63, b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def string(t: str) -> bytes:
        return number(len(t.encode())) + t.encode()

    def pack(text: str) -> bytes:
        import bz2
        import json
        import lzma
        import zlib

        kind = {"type": "record", "name": "r", "fields": [{"name": "name", "type": ["null", "string"]}, {"name": "n", "type": "long"}, {"name": "f", "type": "double"}, {"name": "of", "type": {"type": "array", "items": {"type": "map", "values": "int"}}}]}
        rows = [number(1) + string(line) + number(-i) + bytes(8) + number(1) + number(1) + string("k") + number(i) + number(0) + number(0) for i, line in enumerate(text.split("\n"))]
        codec = ("null", "deflate", "snappy", "bzip2", "xz")[len(text) % 5]
        head = b"Obj\x01" + number(2) + string("avro.schema") + string(json.dumps(kind)) + string("avro.codec") + string(codec) + number(0) + bytes(16)
        for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
            data = b"".join(part)
            squeezed = {"null": lambda d: d, "deflate": lambda d: zlib.compress(d)[2:-4], "snappy": lambda d: pa.compress(d, "snappy", asbytes=True) + bytes(4), "bzip2": bz2.compress, "xz": lzma.compress}[codec](data)
            head += number(len(part)) + number(len(squeezed)) + squeezed + bytes(16)
        return head

    @F.arrow_udf("binary")
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for t in part:  # a file at a time
                yield pa.array([pack(t.as_py())], pa.binary())

    return texts.select("path", packed(F.col("text")).alias("content"))


@query("""
WITH l AS (SELECT 'n' || c_nationkey AS path, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS row FROM customer)
SELECT path, row, '/name' AS pointer, c_name AS text FROM l UNION ALL SELECT path, row, '/n', (-row)::VARCHAR FROM l UNION ALL SELECT path, row, '/of/0/k', row::VARCHAR FROM l""")
def avro_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of Avro container files of five codecs; doubles aren't read."""
    rows = avro.rows(_avro(_names(spark, sf_dir)))
    return json_leaves.leaves(rows, ["path", "row"], "doc").select("path", "row", "pointer", "text")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'number ' || (100000 + p_partkey) END AS text, p_partkey % 4 = 2 AS encrypted FROM part""")
def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable runs of binary files, narrow and wide, and encrypted office files."""
    said = F.concat(F.lit("number "), (100000 + F.col("p_partkey")).cast("string"))
    wide = F.encode(said, "UTF-16LE")
    k = F.col("p_partkey") % 4
    ole = F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.unhex(F.lit("00" * 600)), F.encode(F.lit("EncryptedPackage"), "UTF-16LE"), F.unhex(F.lit("0000")), F.encode(said, "UTF-8"))
    content = F.when(k == 0, F.concat(F.unhex(F.lit("0001")), F.encode(said, "UTF-8"), F.unhex(F.lit("00FF")))).when(k == 1, F.concat(F.unhex(F.lit("FF01")), wide, F.unhex(F.lit("FFFF")))).when(k == 2, ole).otherwise(F.unhex(F.lit("0001020304")))
    rows = read(spark, sf_dir, "part").select("p_partkey", content.alias("c"))
    return rows.select("p_partkey", files.printable_runs(F.col("c")).alias("text"), files.encrypted_office(F.lit("a.bin"), F.col("c")).alias("encrypted"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'md5:' || md5(o_orderkey::VARCHAR) END AS fingerprint, sha256('key-' || o_custkey) AS key_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x/' || o_orderkey END AS link,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a/' || o_custkey ELSE 'a/###-##-####.txt' END AS path, CASE WHEN o_orderkey % 2 = 1 THEN '3/' || o_orderkey END AS entry FROM orders""")
def listed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints from listings, hashed keys, links and archive paths that name no value."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    hex_ = F.md5(k.cast("string").cast("binary"))
    listed = F.when(k % 4 == 0, F.concat(F.lit('"'), F.upper(hex_), F.lit('"'))).when(k % 4 == 1, F.base64(F.unhex(hex_))).when(k % 4 == 2, hex_).otherwise("no-hash")
    name = F.when(k % 2 == 0, F.concat(F.lit("a/"), c)).otherwise(F.lit("a/219-09-9998.txt"))
    fields = findings.archive_fields(name, F.concat(F.lit("3/"), k.cast("string")))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", incremental.fingerprint_of(listed).alias("fingerprint"), findings.key_hash(F.concat(F.lit(" key-"), c, F.lit(" "))).alias("key_hash"),
        findings.link_for(F.concat(F.lit("https://x/"), k.cast("string")), [name]).alias("link"), fields["archivePath"].alias("path"), fields["archiveEntry"].alias("entry"))


@query("""
SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS day_ms, event_type, count(*) AS occurrences FROM events WHERE event_id % 3 = 0 GROUP BY ALL""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a stream of log events by tumbling windows of event time, under a watermark (streams)."""
    schema = read(spark, sf_dir, "events").schema
    card = F.when(F.col("event_id") % 3 == 0, F.lit("card 4539148803436467")).otherwise(F.lit("card 4111111111111111"))
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", card.alias("message"))
    counted = logs.counts(events, ["event_type"], late="3650 days", length="1 day", classes=("card",))
    table = versions.Versions(spark, shared.new_path(spark, "counts"), counted.schema)
    stream = counted.writeStream.outputMode("complete").foreachBatch(table.write).option("checkpointLocation", shared.new_path(spark, "counts-state"))
    stream.trigger(availableNow=True).start().awaitTermination()
    return table.read().select(F.unix_millis("window.start").alias("day_ms"), "event_type", "occurrences")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'N2' WHEN o_orderkey % 4 = 2 THEN 'N' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 4 > 0""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a feed of changes: the last of a key wins, deleted rows go (CDC)."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    k = F.col("o_orderkey")
    change = lambda when, status, seq, gone=False: rows.where(when).withColumn("status", F.lit(status)).withColumn("seq", F.lit(seq)).withColumn("deleted", F.lit(gone))
    changes = change(k % 4 == 0, "N", 1).union(change(k % 4 == 0, "N", 2, True)).union(change(k % 4 == 1, "N", 1)).union(change(k % 4 == 1, "N2", 2)).union(change(k % 4 == 2, "N", 1))
    return logs.apply_changes(rows, changes, ["o_orderkey"], "seq")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS pass FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 6 = 0""")
def carried_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unchanged places joined to a new pass (H7)."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    seen = rows.where("o_orderkey % 6 = 0")
    old = rows.where("o_orderkey % 3 > 0").withColumn("pass", F.lit(0)).unionByName(seen.withColumn("pass", F.lit(0)))
    return incremental.carried(old, seen, ["o_orderkey"], F.lit(1)).unionByName(seen.withColumn("pass", F.lit(2)))
