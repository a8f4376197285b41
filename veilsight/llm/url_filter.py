"""URL filters: host and path rules first, a weighted vocabulary for the rest.

A rule names a host and a path prefix and blocks or allows; it fits the host and
its subdomains, and the longest fitting rule decides.  Where no rule fits, an
Aho-Corasick automaton counts vocabulary terms in the lower-cased url.  A hit counts if
no ASCII letter or digit stands directly before or after it.  Strict terms block at one hit;
soft terms have weights of 0.5 to 1, and the weights of the distinct soft terms found block from
``limit`` on, so it takes two terms at least.

Edge cases: a null url, or one without ``://``, has an empty host and path and, if null,
no hits, so it is allowed; an empty url is allowed; equal urls get equal verdicts; all
columns are kept, those named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str  # starts with /

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...]
    soft: Mapping[str, float]
    limit: float = 1.5


#: Soft terms by weight: those that are rarely innocent count twice the others that must come together.
_SOFT = {
    1.0: ("adult", "sexy", "nude", "nudes", "bets", "betting", "jackpot", "slots", "poker", "pills", "crack", "cracked", "keygen", "torrent", "torrents", "spam", "dating", "webcam", "webcams", "lottery", "roulette", "payday", "steroids"),
    0.75: ("sex", "bet", "x", "hot", "bonus", "loan", "loans", "cheap", "deal", "deals", "singles", "vape", "leaked", "serial", "spins"),
    0.5: ("win", "free", "click", "cash", "earn", "discount", "coupon", "coupons", "promo"),
}
DEFAULT_VOCABULARY = Vocabulary(
    strict=("porn", "porno", "pornography", "xxx", "xxxvideos", "casino", "nsfw", "hentai", "camgirl", "camgirls", "escort", "escorts", "viagra", "cialis", "warez", "malware", "phishing", "milf", "bestiality"),
    soft={term: weight for weight, terms in _SOFT.items() for term in terms},
)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


_automata: dict = {}


def _automaton(terms: tuple[str, ...]):
    if terms not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        if terms:
            made.make_automaton()
        _automata[terms] = made
    return _automata[terms]


_WORD = frozenset(LOWER + "0123456789")
_FOLD = str.maketrans(UPPER, LOWER)


def hits(url: str | None, vocabulary: Vocabulary) -> tuple[int, dict[str, int]]:
    """Strict hits, and each soft term found with its count."""
    terms = tuple(dict.fromkeys([*vocabulary.strict, *vocabulary.soft]))
    strict, soft = 0, {}
    if not url or not terms:
        return 0, {}
    text = url.translate(_FOLD)
    for end, term in _automaton(terms).iter(text):
        begin = end - len(term) + 1
        if (begin and text[begin - 1] in _WORD) or (end + 1 < len(text) and text[end + 1] in _WORD):
            continue
        if term in vocabulary.strict:
            strict += 1
        else:
            soft[term] = soft.get(term, 0) + 1
    return strict, soft


def judge(pages: DataFrame, rules: Sequence[Rule] = (), vocabulary: Vocabulary = DEFAULT_VOCABULARY, url: str = "url") -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_terms, soft_weight and verdict."""
    strict_terms, soft_terms, limit = vocabulary.strict, dict(vocabulary.soft), vocabulary.limit

    @F.arrow_udf("struct<strict:bigint,soft:array<string>,weight:double>")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Vocabulary(strict_terms, soft_terms, limit)
        for part in parts:
            found = [hits(u, words) for u in part.to_pylist()]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([s for s, _ in found], pa.int64()),
                    pa.array([sorted(t) for _, t in found], pa.list_(pa.string())),
                    pa.array([float(sum(soft_terms[x] for x in t)) for _, t in found], pa.float64()),
                ],
                ["strict", "soft", "weight"],
            )

    out = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("_hits", count(F.col(url))).withColumn("rule", text)
    out = out.withColumn("strict_hits", F.col("_hits.strict")).withColumn("soft_terms", F.col("_hits.soft")).withColumn("soft_weight", F.col("_hits.weight"))
    method = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= limit), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(verdict, method)).drop("_hits")


def oracle(rules: Sequence[Rule], vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> str:
    """The same as DuckDB SQL over ``pages``."""
    text, verdict = "NULL", "NULL"
    ordered = sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text), reverse=True)
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    if ordered:
        text = "CASE " + " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in zip(ordered, fits, strict=True)) + " END"
        verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in zip(ordered, fits, strict=True)) + " END"
    found = lambda t: f"regexp_matches(folded, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " OR ".join(found(t) for t in vocabulary.strict) or "false"
    weight = " + ".join(f"CASE WHEN {found(t)} THEN {w} ELSE 0 END" for t, w in vocabulary.soft.items()) or "0"
    fold = lambda e: f"translate({e}, '{UPPER}', '{LOWER}')"
    return f"""
WITH u AS (
  SELECT page_id, coalesce({fold("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce({fold("url")}, '') AS folded
  FROM pages)
SELECT page_id, host, path, {text} AS rule,
  coalesce({verdict}, CASE WHEN {strict} OR ({weight}) >= {vocabulary.limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM u"""
