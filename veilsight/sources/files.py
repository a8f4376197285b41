"""Files: what their bytes are, whether their names say so, and text units of the readable ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds by their first bytes.
MAGIC = (
    ("pdf", "255044462D"), ("zip", "504B0304"), ("zip", "504B0506"), ("gzip", "1F8B"), ("bzip2", "425A68"), ("xz", "FD377A585A00"),
    ("zstd", "28B52FFD"), ("parquet", "50415231"), ("orc", "4F5243"), ("avro", "4F626A01"), ("rdb", "5245444953"), ("ole", "D0CF11E0A1B11AE1"),
    ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("sqlite", "53514C69746520666F726D6174203300"),
)
# Kinds by file name.
EXTENSIONS = {
    "pdf": "pdf", "zip": "zip", "docx": "zip", "xlsx": "zip", "pptx": "zip", "gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "xz": "xz", "zst": "zstd",
    "parquet": "parquet", "orc": "orc", "avro": "avro", "rdb": "rdb", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif",
    "txt": "text", "log": "text", "csv": "text", "tsv": "text", "json": "text", "jsonl": "text", "ndjson": "text", "md": "text", "xml": "text", "html": "text",
}
HEAD = 8192


def sniff(content: Column) -> Column:
    """The kind by the first bytes: a known mark, else text if at least 85 % are printable, else binary."""
    head = F.substring(content, 1, HEAD)
    printable = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[^\x09\x0A\x0D\x20-\x7E\x{80}-\x{FF}]", ""))
    plain = (F.octet_length(head) > 0) & ~F.decode(head, "ISO-8859-1").contains("\x00") & (printable >= 0.85 * F.octet_length(head))
    out = F.when(F.octet_length(head) == 0, "empty").when(plain, "text").otherwise("binary")
    for kind, mark in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, 1, len(mark) // 2)) == mark, kind).otherwise(out)
    return F.when(content.isNotNull(), out)


def named(path: Column) -> Column:
    """The kind that a name claims; null if it claims none."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, kind in EXTENSIONS.items():
        out = F.when(end == ext, kind).otherwise(out)
    return out


def disguised(claim: Column, kind: Column) -> Column:
    """Whether a file isn't what its name claims."""
    return F.coalesce((claim != kind) & (kind != "empty"), F.lit(False))


def units(files: DataFrame, max_bytes: int = 20 << 20) -> DataFrame:
    """path, kind, disguised, skipped and text of files as ``spark.read.format("binaryFile")`` gives
    them.  Large ones are passed over by their length, before their content is read."""
    big = F.col("length") > max_bytes
    rows = files.withColumn("kind", F.when(~big, sniff(F.col("content")))).withColumn("disguised", disguised(named(F.col("path")), F.col("kind")))
    skipped = F.when(big, "too_large").when(F.col("kind") != "text", F.concat(F.lit("kind_"), F.col("kind")))
    return rows.select("path", "length", "kind", "disguised", skipped.alias("skipped"), F.when(skipped.isNull(), F.decode("content", "UTF-8")).alias("text"))


#: Most characters of printable text kept of one block of bytes.
BLOCK_CHARS = 64 << 10


def printable_runs(content: Column, most: int = BLOCK_CHARS) -> Column:
    """Runs of six or more printable characters (ASCII, then UTF-16LE) that could hold a value, one a line; of at most ``most``
    characters in all (``printable_left_out`` says how many more there are)."""
    return F.left(_printable(content), F.lit(most))


def printable_left_out(content: Column, most: int = BLOCK_CHARS) -> Column:
    """How many characters of its printable runs a block has beyond those that are read."""
    return F.greatest(F.length(_printable(content)) - most, F.lit(0))


def _printable(content: Column) -> Column:
    raw = F.decode(content, "ISO-8859-1")
    plain = F.regexp_extract_all(raw, F.lit(r"([\x20-\x7E\t]{6,})"), 1)
    wide = F.transform(F.regexp_extract_all(raw, F.lit(r"((?:[\x20-\x7E]\x00){6,})"), 1), lambda r: F.replace(r, F.lit("\x00"), F.lit("")))
    kept = F.filter(F.concat(plain, wide), lambda r: r.rlike(r"[0-9]|(?i)\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b"))
    return F.array_join(kept, "\n")


def office_text(entries: DataFrame) -> DataFrame:
    """path and text of office documents, from the rows that ``archives.entries`` gives of them.

    Paragraphs and rows are lines, cells are parted by tabs; shared strings of a workbook come
    as lines of their own.  Parts with a document type declaration are left out."""
    part = F.col("entry").rlike(r"^(?:word/(?:document|header[0-9]*|footer[0-9]*|footnotes|comments)\.xml|ppt/(?:slides|notesSlides)/[^/]+\.xml|xl/sharedStrings\.xml|xl/worksheets/[^/]+\.xml)$")
    xml = F.decode("content", "UTF-8")
    text = F.regexp_replace(xml, r"</(?:w:p|a:p|si|row|x:row)>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"</(?:c|w:tc)>|<w:tab/>", "\t"), r"<[^>]*>", "")
    for mark, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(ch))
    rows = entries.where(part & F.col("content").isNotNull() & ~xml.contains("<!DOCTYPE")).select("path", "entry", text.alias("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "text"))), lambda p: p["text"]), "\n").alias("text"))


# The stream that an encrypted office file is, as its container writes the name; names that office files go by.
OLE_MARK = "EncryptedPackage"
OFFICE = ("docx", "xlsx", "pptx", "doc", "xls", "ppt")


def encrypted_office(path: Column, content: Column) -> Column:
    """Whether a file with the old container's mark is an encrypted office file: its name says office, or the container's
    first bytes or its directory's first sectors name the stream."""
    mark = "".join(f"{b:02X}" for b in OLE_MARK.encode("utf-16le"))
    number = lambda at, n: F.conv(F.array_join(F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.hex(F.substring(content, at + i, F.lit(1)))), ""), 16, 10).cast("long")
    size = F.when(number(31, 2).isin(9, 12), F.pow(F.lit(2), number(31, 2)).cast("long"))
    first = number(49, 4)
    directory = F.substring(content, F.when(first < 0xFFFFFFFA, (first + 1) * size + 1).cast("int"), (4 * size).cast("int"))
    named = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*OFFICE)
    ole = F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1"
    return F.coalesce(ole & (named | F.hex(F.substring(content, 1, HEAD)).contains(mark) | F.coalesce(F.hex(directory).contains(mark), F.lit(False))), F.lit(False))
