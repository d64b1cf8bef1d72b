"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

A text is cut by a pattern into what matches and what lies between, which gives each match its place; all is local
to a row and written in built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span in which context words count.
NEAR = 40
#: Spans of at least this score are reported.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of span. `base` scores what passes `confirm`; a context word before it adds `bonus`.

    Patterns are leftmost and do not overlap; what `confirm` turns down is dropped, not retried. `hint` is a cheap
    test for texts that may have a match at all.
    """

    name: str
    pattern: str
    hint: str
    confirm: Callable[[Column], Column]
    base: float
    bonus: float = 0.0
    context: str = ""


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """The Luhn check over the digits of x."""
    value = F.transform(F.split(F.reverse(digits(x)), ""), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(x: Column) -> Column:
    """The ISO 7064 check of an IBAN: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.upper(F.regexp_replace(x, "[ -]", ""))
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _between(lo: int, hi: int) -> Callable[[Column], Column]:
    return lambda x: F.length(digits(x)).between(lo, hi)


def _card(x: Column) -> Column:
    return F.when(_between(14, 19)(x), luhn(x)).otherwise(False)


def _ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def _any(x: Column) -> Column:
    return F.lit(True)


_LOCAL = "A-Za-z0-9._%+-"
#: Where a match of a run may begin: not inside the run, unless the last match ended there.
EMAIL = Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _any, 1.0)
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _ip, 1.0)
CARD = Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]", _card, 1.0)
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _between(10, 15), 1.0)
BASE = (EMAIL, IP, CARD, PHONE)
#: Found in addition; the last two are common shapes that only context makes personal.
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", mod97, 0.9, 0.1, "iban|konto|account|compte|cuenta")
SSN = Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", _any, 0.4, 0.5, "ssn|social security")
PASSPORT = Kind("passport", r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])", r"[A-Z][0-9]{8}", _any, 0.1, 0.7, "passport|passeport|pasaporte|reisepass")
#: Access keys: long hexadecimal strings with digits and letters, and the prefixes that issuers give theirs.
SECRET = Kind(
    "secret",
    r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,100})(?![0-9A-Za-z_])",
    r"[0-9a-f]{32}|AKIA|gh[pousr]_|sk-",
    lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"),
    0.6,
    0.3,
    "key|token|secret|passw|clave|schlüssel|clé",
)
KINDS = (*BASE, IBAN, SSN, PASSPORT, SECRET)


#: Matches that a fold gathers before it appends them: each step copies what is gathered, so neither may grow long.
_SLICE = 64
_MATCHES = "array<struct<start:int,match:string,before:string>>"


def matches(text: Column, pattern: str, near: int = 0) -> Column:
    """Array of (start, match, before) in code points; before: as many as `near` of the characters that stand before it.

    Matches and the gaps before them alternate from the text's beginning, so one fold over both gives all places.
    """
    pairs = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("match"), gap.alias("gap"))), lambda p: p["match"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(_MATCHES).alias("some"), F.array().cast(f"array<{_MATCHES}>").alias("out"))
    last = lambda x: F.right(x, F.lit(near)) if near else F.lit("")

    def step(a: Column, p: Column) -> Column:
        start, before = a["at"] + F.length(p["gap"]), last(F.concat(a["tail"], p["gap"]))
        full = F.size(a["some"]) >= _SLICE
        one = F.array(F.struct(start.alias("start"), p["match"].alias("match"), before.alias("before")))
        return F.struct(
            (start + F.length(p["match"])).alias("at"),
            last(F.concat(before, p["match"])).alias("tail"),
            F.when(full, one).otherwise(F.concat(a["some"], one)).alias("some"),
            F.when(full, F.concat(a["out"], F.array(a["some"]))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(pairs, zero, step, lambda a: F.flatten(F.concat(a["out"], F.array(a["some"]))))


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def spans_of(text: Column, kind: Kind, rank: int, threshold: float) -> Column:
    """Confirmed spans of a kind with their score, from the threshold on; an empty array for null."""

    def scored(m: Column) -> Column:
        score = F.lit(kind.base) + (F.when(F.lower(m["before"]).rlike(kind.context), kind.bonus).otherwise(0.0) if kind.context else F.lit(0.0))
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (m["start"] + F.length(m["match"])).alias("end"), score.alias("score"))

    confirmed = F.transform(F.filter(matches(text, kind.pattern, NEAR if kind.context else 0), lambda m: kind.confirm(m["match"])), scored)
    return F.when(text.rlike(kind.hint), F.filter(confirmed, lambda s: s["score"] >= threshold)).otherwise(F.array()).cast(_SPAN)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: an array of (start, rank, kind, end, score) by start, then by the order of `kinds`.

    Places are code points, ends exclusive. Null and empty texts have no spans. One row for each row of `docs`, also
    where ids repeat or are null; an empty table gives none. Other columns do not matter, whatever their names. Spans of
    different kinds may overlap. The work on a text follows its length, however many matches it has.
    """
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = taken.select("doc_id", *(spans_of(F.col("text"), k, i, threshold).alias(f"k{i}") for i, k in enumerate(kinds)))
    return found.select("doc_id", F.sort_array(F.concat(*(f"k{i}" for i in range(len(kinds))))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: Kind) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind.name)).cast("long")


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    """Base counts and the hash of base spans, and all spans, of all `documents`; null texts read as empty ones."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [_count(k).alias(f"n_{k.name}") for k in BASE]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
