"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements.

The ledger has one row a document: what was measured, and a bitmask of the rules it fails. A policy is a versioned
mask of rules; applying one, or asking what each of its rules alone is worth, are bitwise operations on the ledger
and never read the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words of the windows whose repetition counts.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if `fails` holds for its measurements."""

    name: str
    fails: str


#: The order gives each rule its bit; new rules are added at the end.
RULES = (
    Rule("too_short", "n_words < 20"),
    Rule("repeats_itself", "100 * n_repeat_words > 30 * n_words"),
    Rule("words_too_long", "word_chars > 15 * n_words"),
    Rule("words_too_short", "word_chars < 2 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("too_long", "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    """The rules that reject, by name; a document stays if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(x) for x in self.rules)


BASE = Policy("base", ("too_short", "repeats_itself"))
STRICT = Policy("2", ("too_short", "repeats_itself", "words_too_long", "words_too_short", "many_symbols", "duplicate_lines"))


def _repeat_words() -> Column:
    """Words covered by windows that occur twice: the sorted places of such windows, each adding what it newly covers."""
    places = F.transform(
        F.filter(
            F.transform(F.col("sorted_windows"), lambda x, i: F.struct(x["at"].alias("at"), ((x["h"] == F.get(F.col("sorted_windows"), i - 1)["h"]) | (x["h"] == F.get(F.col("sorted_windows"), i + 1)["h"])).alias("again"))),
            lambda x: x["again"],
        ),
        lambda x: x["at"],
    )
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    step = lambda acc, at: F.struct((acc["covered"] + WINDOW - F.greatest(acc["end"] - at, F.lit(0))).alias("covered"), (at + WINDOW).alias("end"))
    return F.aggregate(F.sort_array(places), zero, step, lambda acc: acc["covered"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words as long columns."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE, -1), lambda w: w != "")
    # Size and lambda both name word_hashes: were it named once, Catalyst would put its expression into the lambda.
    windows = F.when(F.size("word_hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("word_hashes") - WINDOW + 1), lambda i: F.xxhash64(F.slice("word_hashes", i, WINDOW))))
    several = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(several, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at")))))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("words", words)
        .withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("windows", windows)
        .withColumn("sorted_windows", placed)
        .withColumn("lines", lines)
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
                "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
                "n_lines": F.size("lines").cast("long"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
                "n_repeat_words": F.coalesce(_repeat_words(), F.lit(0)).cast("long"),
            }
        )
        .drop("words", "word_hashes", "windows", "sorted_windows", "lines")
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """Bit k is set if rule k fails.

    The row number, of which no bit is taken, keeps Catalyst from copying all measurements into filters on the ledger.
    """
    bits = F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and failed_bits, one row for each row of `docs`.

    Null, empty and blank texts have no words and fail what their zero measurements fail. Rows that share an id, and
    null ids, keep a row each. Other columns of `docs` do not matter, whatever their names.
    """
    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return measured(taken).select("doc_id", *MEASURES, failure_bits(rules).alias("failed_bits"))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(entries: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, and documents only it rejects.

    Documents are first counted by bitmask, so what follows is over at most two to the number of rules rows.
    Returns version, rule, n_failed, n_only, n_rejected (by the whole policy) and n_docs; an empty ledger gives no rows.
    """
    masks = entries.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = [r.name for r in rules]
    wanted = F.array(*(F.struct(F.lit(p.version).alias("version"), F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask")) for p in policies for x in p.rules))
    x = masks.select("failed_bits", "n", F.explode(wanted).alias("w")).select("failed_bits", "n", "w.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return x.groupBy("version", "rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum("n").alias("n_docs"),
    )


def keep_passing(docs: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs`, with their own columns only, that pass a policy. All is local to a row; nothing is shuffled."""
    given = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*given).alias("row"), F.col(text).alias("text"))
    kept = measured(whole).withColumn("failed_bits", failure_bits(rules)).filter(passes(policy, rules))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(STRICT).alias("kept"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 6)) AS k, words FROM w WHERE len(words) >= 8),
g AS (SELECT r, k, array_to_string(words[k:k + 7], ' ') AS g FROM p),
s AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 8)) AS j FROM s) GROUP BY r),
m AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN c USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""
