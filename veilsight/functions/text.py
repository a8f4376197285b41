"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import spec
from . import spoken
from .validators import luhn_valid

#: Bounds of a word in ASCII terms; Java's own bound counts accented letters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def words(terms: tuple[str, ...], escape: bool = True) -> str:
    """A pattern for any of the terms as whole words, whatever the case and the white space between them."""
    body = "|".join((t.replace(".", r"\.") if escape else t).replace(" ", r"[ \t\r\n]+") for t in terms)
    return f"(?i){LEFT}(?:{body}){RIGHT}"


def has_candidate(text: Column) -> Column:
    """A digit or a number word: without one there is nothing to detect."""
    return F.coalesce(text.rlike("[0-9]|(?i)" + LEFT + "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)" + RIGHT), F.lit(False))


def has_context(cls: str, around: Column) -> Column:
    """A context word of the class, once its excluded phrases are taken out."""
    if cls not in spec.CONTEXT_WORDS:
        return F.lit(False)
    for phrase in spec.CONTEXT_EXCLUSIONS.get(cls, ()):
        around = F.regexp_replace(around, "(?i)" + LEFT + phrase + RIGHT, " ")
    return F.coalesce(around.rlike(words(spec.CONTEXT_WORDS[cls])), F.lit(False))


def suppressed(cls: str, around: Column) -> Column:
    if cls not in spec.SUPPRESS_WORDS:
        return F.lit(False)
    return F.coalesce(around.rlike(words(spec.SUPPRESS_WORDS[cls])), F.lit(False))


def humanize(name: Column) -> Column:
    """cardNumber and card_number as words."""
    return F.translate(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "_", " ")


def timestamp_name(name: Column) -> Column:
    """Whether a field is named like a point in time, so that it holds no date of birth: its last word says so,
    and none speaks of birth."""
    last = F.regexp_extract(F.lower(humanize(name)), "([a-z0-9]+)[^a-z0-9]*$", 1)
    return F.coalesce(last.isin(*spec.TIMESTAMP_WORDS) & ~F.lower(name).rlike("birth|dob|born"), F.lit(False))


def is_label(value: Column) -> Column:
    """A few short words without a run of four digits."""
    count = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    return F.coalesce((F.length(value) <= 80) & ~value.rlike("[0-9]{4}") & (count <= 4), F.lit(False))


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def utf16_index(text: Column, at: Column) -> Column:
    """UTF-16 units before code point ``at`` (from 0)."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), at), "UTF-16LE")) / 2).cast("int")


def sample_point(key: Column) -> Column:
    """A stable bucket of 0 to 99: FNV-1a over the key's UTF-16 units."""
    raw = F.hex(F.encode(key, "UTF-16LE"))
    unit = lambda i: F.conv(F.concat(F.substring(raw, i * 4 + 3, F.lit(2)), F.substring(raw, i * 4 + 1, F.lit(2))), 16, 10).cast("long")
    steps = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    # the product stays below 2**57
    out = F.aggregate(steps, F.lit(0x811C9DC5).cast("long"), lambda h, i: h.bitwiseXOR(unit(i)) * F.lit(0x01000193) % F.lit(1 << 32))
    return F.when(key.isNotNull(), (out % 100).cast("int"))


#: Marks put around matches; they stand for themselves in no text that has been cleaned of them.
OPEN, CLOSE = "\x01", "\x02"


def spans(text: Column, pattern: str) -> Column:
    """All matches in order: array of (raw, start, end), in code points from 0."""
    clean = F.translate(text, OPEN + CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN, -1)
    empty = F.array().cast("array<struct<raw:string,start:int,end:int>>")

    def step(acc: Column, part: Column) -> Column:
        raw = F.substring_index(part, CLOSE, 1)
        here = F.struct(raw.alias("raw"), acc["at"].alias("start"), (acc["at"] + F.length(raw)).alias("end"))
        hit = part.contains(CLOSE)  # all parts but the first
        return F.struct((acc["at"] + F.length(part) - hit.cast("int")).alias("at"), F.when(hit, F.array_append(acc["found"], here)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])


CARD_RUN = spec.CARD_WRITTEN.replace(r"\w", r"[\p{L}\p{N}_]")


def redact(text: Column) -> Column:
    """Masks card-like runs that pass the checksum, SSN-like runs and runs of 13 digits or more."""
    mask = lambda s: F.regexp_replace(s, "[0-9]", "#")
    pieces = F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, "  "), f"({spec.CARD_MASKED})", f"{OPEN}$1{CLOSE}"), OPEN, -1)

    def piece(p: Column) -> Column:
        raw = F.substring_index(p, CLOSE, 1)
        card = p.contains(CLOSE) & luhn_valid(F.regexp_replace(raw, "[ -]", ""))
        return F.concat(F.when(card, mask(raw)).otherwise(raw), F.when(p.contains(CLOSE), F.substring_index(p, CLOSE, -1)).otherwise(""))

    text = F.array_join(F.transform(pieces, piece), "")
    # nine digits in three groups, one separator or none between; then whatever long runs are left
    for pattern, signs in spec.NINE_MASKED:
        text = F.regexp_replace(text, pattern, signs)
    return _mask_long(text)


def _mask_long(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, "([0-9]{13,})", f"{OPEN}$1{CLOSE}"), OPEN, -1)
    one = lambda p: F.when(p.contains(CLOSE), F.concat(F.regexp_replace(F.substring_index(p, CLOSE, 1), "[0-9]", "#"), F.substring_index(p, CLOSE, -1))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def redaction_markers(text: Column) -> Column:
    """How many marks of an earlier redaction, like [SSN], a text has."""
    names = "|".join([*spec.REDACTION_MARKS, "REDACTED(?::[^\\]\\n]{1,120})?"])
    return F.regexp_count(text, F.lit(rf"\[(?:{names})\]"))


def digits_of_speech(text: Column) -> Column:
    """The text of a spoken or keyed turn with its digits read out."""
    return spoken.tokens(text)["text"]


def confidence_of(score: Column) -> Column:
    """high from 0.8, medium from 0.45, else low."""
    return F.when(score >= 0.8, "high").when(score >= 0.45, "medium").when(score.isNotNull(), "low")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).when(c == "low", 0)


def severity(cls: Column) -> Column:
    out = F.lit("medium")
    for name, level in spec.SEVERITY.items():
        out = F.when(cls == name, level).otherwise(out)
    return out
