"""Line dedup by a log-template tree: recurring lines, also with variable fields, are dropped.

The tree has a fixed depth: a line goes to a leaf by its number of tokens and its first tokens; tokens with a digit are
fields from the start. A leaf holds any number of templates:

1. The different lines of a leaf vote, each with its documents, for the token of each further place. A token that too
   few documents have there is a field of the line that has it; what is left of the line is its form.
2. A form of few enough fields that enough documents have is a template. A line with too few frequent tokens belongs to
   no template and leaves the tree. The other lines branch, each by its most frequent token, and vote again among
   themselves. The tree has a fixed number of such branches below its leaves.
3. A line that has found no template is an instance of the template of its leaf that has most constants in common with
   it, if it has all of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import shared
from quantloom.llm.text import chunks, mix, multipliers, split_words, text_bytes

#: Leading tokens of the tree, and branches by frequent tokens below them; share of the further tokens that are constants of a template.
DEPTH, BRANCHES, SIMILARITY = 3, 2, 0.6
#: Shorter lines recur by chance; a template that fewer documents have is not boilerplate.
MIN_TOKENS, MIN_DOCS = 4, 5
#: Lines of more tokens do not recur by chance: fewer documents are enough.
LONG_TOKENS, LONG_DOCS = 50, 2
#: A document of which one other document has so much, first, is its copy.
COPY_SHARE = 0.8
#: Code of a token with a digit.
_FIELD = np.uint64(0x5D1B8C3F27A9E641)


def _parse(depth: int, min_tokens: int):
    """The lines of enough tokens: place in the text, characters of the line and of all words of the text, hashes and token codes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            for first, part, offs in chunks(data, offsets, 1 << 19):
                yield _lines(batch, first, part, offs, depth, min_tokens)

    return parse


def _lines(batch: pa.RecordBatch, first: int, data: np.ndarray, offsets: np.ndarray, depth: int, min_tokens: int) -> pa.RecordBatch:
    w = split_words(data, offsets)
    doc = w.docs()
    before = lambda x: np.r_[0, np.cumsum(x)]
    digits, breaks, letters = before((data - np.uint8(48)) < 10), before(data == 10), before((data & np.uint8(0xC0)) != 0x80)
    codes = np.where(digits[w.ends] > digits[w.starts], _FIELD, w.hashes)
    line = breaks[w.starts] - breaks[offsets[doc]] if len(doc) else doc
    start = np.flatnonzero(np.r_[True, (np.diff(line) != 0) | (np.diff(doc) != 0)]) if len(doc) else doc
    n = np.diff(np.r_[start, len(doc)])
    size = letters[w.ends] - letters[w.starts]
    total = np.bincount(doc, size, len(offsets) - 1).astype(np.int64)
    place = np.arange(len(doc)) - np.repeat(start, n)
    m = multipliers(int(n.max(initial=0)) + depth + 1)
    hashed = mix(np.add.reduceat(codes * m[place], start)) if len(start) else codes
    lines = np.flatnonzero(n >= min_tokens)
    leaf = n[lines].astype(np.uint64) * m[depth]
    for j in range(depth):
        leaf += codes[start[lines] + j] * m[j]
    keep = np.repeat(n >= min_tokens, n)
    tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[lines])], pa.int32()), pa.array((codes[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    of = doc[start[lines]]
    row = pa.array(first + of)
    each = np.add.reduceat(size, start)[lines] if len(start) else start
    columns = {
        "doc_id": batch["doc_id"].take(row),
        "text_hash": batch["text_hash"].take(row),
        "at": pa.array(line[start[lines]], pa.int32()),
        "chars": pa.array(each, pa.int64()),
        "total": pa.array(total[of], pa.int64()),
        "leaf": pa.array(mix(leaf).view(np.int64)),
        "line": pa.array(hashed[lines].view(np.int64)),
        "n": pa.array(n[lines], pa.int32()),
        "tokens": tokens,
    }
    return pa.RecordBatch.from_pydict(columns)


def _need(min_docs: tuple[int, int], n: str = "n") -> Column:
    """Documents that make lines of n tokens recur: (short, long) ones."""
    return F.when(F.col(n) > LONG_TOKENS, min(min_docs)).otherwise(min_docs[0])


_DOC = ("doc_id", "text_hash")


def _votes(left: DataFrame, depth: int, min_docs: tuple[int, int]) -> DataFrame:
    """(branch, line, places): the frequent tokens of each line, by place, with their documents; at place 0 those of the branch."""
    tokens = F.concat(F.array(F.lit(0)), F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(0))))
    each = left.select("branch", "line", "n", "docs", F.posexplode(tokens).alias("place", "token"))
    votes = each.groupBy("branch", "place", "token").agg(F.sum("docs").alias("votes"), F.first("n").alias("n")).filter(F.col("votes") >= _need(min_docs)).drop("n")
    met = each.hint("merge").join(votes, ["branch", "place", "token"])
    return met.groupBy("branch", "line").agg(F.sort_array(F.collect_list(F.struct("place", "token", "votes"))).alias("places"))


def _templates(left: DataFrame, depth: int, branches: int, similarity: float, min_docs: tuple[int, int]) -> DataFrame:
    """(leaf, line, template, constants) of lines with a form that enough documents have. `left`: leaf, line, n, docs, tokens."""
    left, found = left.withColumn("branch", F.col("leaf")), []
    for below in range(branches, -1, -1):
        votes = left.join(_votes(left, depth, min_docs), ["branch", "line"])
        total = F.get("places", F.lit(0))["votes"]
        votes = votes.withColumns({"total": total, "places": F.filter("places", lambda x: x["place"] > 0)})
        votes = votes.filter(F.size("places") >= (F.col("n") - depth) * similarity)
        constants = F.transform("places", lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token"), x["votes"].alias("votes")))
        votes = shared.stored(votes.withColumns({"form": F.xxhash64("branch", F.transform("places", lambda x: F.struct(x["place"], x["token"]))), "constants": constants}).drop("places"), "votes")
        forms = votes.groupBy("form").agg(F.sum("docs").alias("have"), F.first("n").alias("n")).filter(F.col("have") >= _need(min_docs)).select("form", F.lit(True).alias("whole"))
        judged = shared.stored(votes.hint("merge").join(forms, "form", "left"), "judged")
        plain = F.transform("constants", lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token")))
        found.append(judged.filter("whole").select("leaf", "line", F.xxhash64("leaf", plain).alias("template"), "constants"))
        shared.discard(votes)
        if not below:
            break
        best = F.array_max(F.transform(F.filter("constants", lambda x: x["votes"] < F.col("total")), lambda x: F.struct(x["votes"], x["place"], x["token"].alias("token"))))
        rest = judged.filter("whole IS NULL").withColumn("best", best).filter(F.col("best").isNotNull())
        left = shared.stored(rest.select("leaf", "line", "n", "docs", "tokens", F.xxhash64("branch", F.col("best.place"), F.col("best.token")).alias("branch")), "left")
    return functools.reduce(DataFrame.union, found)


def _instances(lines: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(leaf, line, template) of lines without one that have all constants of a template of their leaf: of the one with most."""
    rarest = F.array_min(F.transform("constants", lambda x: F.struct(x["votes"], x["place"].alias("place"), x["token"].alias("token"))))
    plain = F.transform("constants", lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token")))
    forms = found.groupBy("leaf", "template").agg(F.min("constants").alias("constants"))
    forms = shared.stored(forms.select("leaf", "template", plain.alias("constants"), rarest["place"].alias("place"), rarest["token"].alias("token")), "forms")
    alone = lines.join(forms.select("leaf").distinct(), "leaf", "left_semi").join(found.select("leaf", "line"), ["leaf", "line"], "left_anti")
    each = alone.select("leaf", "line", "tokens", F.posexplode(F.slice("tokens", depth + 1, F.size("tokens"))).alias("place", "token")).withColumn("place", F.col("place") + 1)
    met = each.hint("merge").join(forms, ["leaf", "place", "token"]).filter(F.forall("constants", lambda x: F.get("tokens", x["place"] + depth - 1) == x["token"]))
    most = F.max(F.struct(F.size("constants").alias("n"), F.transform("constants", lambda x: x["place"]).alias("places"), "template"))
    return met.groupBy("leaf", "line").agg(most.alias("x")).select("leaf", "line", F.col("x.template").alias("template"))


def _of_templates(docs: DataFrame, depth: int, branches: int, similarity: float, min_tokens: int, min_docs: tuple[int, int]) -> DataFrame:
    """(doc_id, text_hash, at, chars, total, n, template) of lines that have a template."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parsed = docs.mapInArrow(_parse(depth, min_tokens), f"doc_id {kind}, text_hash long, at int, chars long, total long, leaf long, line long, n int, tokens array<int>")
    lines = shared.stored(parsed, "lines")
    own = [*_DOC, "at", "chars", "total", "leaf", "line", "n"]
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi")).filter(F.col("rows") >= _need(min_docs))
    leaves = shared.stored(leaves.select("leaf", (F.col("lo") < F.col("hi")).alias("varied")), "leaves")
    # Always by shuffle, so that a hot leaf can be split, and the plan is the same at every size.
    met = shared.stored(lines.hint("merge").join(leaves, "leaf").select(*own, F.when(F.col("varied"), F.col("tokens")).alias("tokens")), "met")
    shared.discard(lines)
    plain, varied = met.filter("tokens IS NULL").select(*own, F.col("line").alias("template")), met.filter("tokens IS NOT NULL")
    once = varied.groupBy("leaf", "line", *_DOC).agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    once = shared.stored(once.groupBy("leaf", "line").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.first("tokens").alias("tokens")), "once")
    found = _templates(once, depth, branches, similarity, min_docs)
    named = shared.stored(found.select("leaf", "line", "template").union(_instances(once, found, depth)), "named")
    return plain.union(varied.hint("merge").join(named, ["leaf", "line"]).select(*own, "template"))


def drop_recurring_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    branches: int = BRANCHES,
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS,
    long_docs: int = LONG_DOCS,
    keep_copies: bool = False,
    copy_share: float = COPY_SHARE,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The rows of `docs` with their text less recurring lines, and n_lines, n_recurring, n_dropped and copy_of.

    A line recurs if at least `min_docs` documents have its template, or `long_docs` if it has more than LONG_TOKENS tokens. A
    template stays at its first place (least doc_id, then hash of the text, then line) and goes everywhere else, so
    nothing that recurs is lost altogether; a document can become empty. n_recurring counts a document's lines of
    recurring templates. copy_of is another document that has `copy_share` of the characters of this one's words in lines
    whose first place it is, or null; with `keep_copies` such documents keep all lines, for a search for near-duplicates.

    Null and empty texts stay as they are (n_lines 0 for null). Rows of equal id and text count as one document and are
    treated alike; rows of equal ids and other texts are documents of their own; null ids come after all others. An empty
    table gives no rows. Other columns named like a result are replaced. `depth` must be below `min_tokens`.
    """
    if not 0 < depth < min_tokens:
        raise ValueError("depth must be at least 1 and below min_tokens")
    enough = (min_docs, long_docs)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_recurring", "n_dropped", "copy_of")]
    ids = [F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text_hash")]
    lines = shared.stored(_of_templates(docs.select(*ids, F.col(f"`{text}`").alias("text")), depth, branches, similarity, min_tokens, enough), "templates")
    seen = lines.groupBy("template", *_DOC).agg(F.first("n").alias("n"), F.min("at").alias("at"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), *_DOC, "at")
    recurring = seen.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.min(order).alias("first")).filter(F.col("docs") >= _need(enough))
    recurring = shared.stored(recurring.select("template", F.col("first.doc_id").alias("of_id"), F.col("first.text_hash").alias("of_hash"), F.col("first.at").alias("of_at")), "recurring")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    met = lines.hint("merge").join(recurring, "template").withColumn("own", same)
    # A set, since repeated rows repeat their lines.
    at = F.collect_set(F.struct("at", "chars", (~F.col("own") | (F.col("at") != F.col("of_at"))).alias("gone")))
    parts = met.groupBy(*_DOC, "of_id", "of_hash").agg(F.first("own").alias("own"), F.first("total").alias("total"), at.alias("at"))
    chars = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    drops = F.transform(F.filter("at", lambda x: x["gone"]), lambda x: x["at"])
    parts = parts.select(*_DOC, "of_id", "own", "total", F.size("at").alias("n"), chars.alias("chars"), drops.alias("gone"))
    whole = (~F.col("own")) & (F.col("chars") >= F.col("total") * copy_share)
    gone = parts.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.sum("n").alias("n_recurring"), F.bool_or(whole).alias("copy"), F.max(F.when(whole, F.col("of_id"))).alias("copy_of"), F.flatten(F.collect_list("gone")).alias("gone")
    )
    drop = F.when(~F.col("copy"), F.col("gone")).otherwise(F.array().cast("array<int>")) if keep_copies else F.col("gone")
    gone = shared.stored(gone.select("d", "h", "n_recurring", "copy_of", drop.alias("drop")), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *ids)
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").withColumn("text", F.col("row")[text])
    out = out.withColumn("lines", F.when(F.col("text").isNotNull(), F.split("text", "\n", -1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"), lambda i: F.get("lines", i))
    fresh = F.when(F.coalesce(F.size("drop"), F.lit(0)) <= 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    cols = [fresh.alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    count = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long")
    return out.select(*cols, count(F.size("lines")).alias("n_lines"), count(F.col("n_recurring")).alias("n_recurring"), count(F.size("drop")).alias("n_dropped"), "copy_of")


def op8_line_templates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_recurring, n_dropped, copy_of and kept_sha256 of all `documents`; null texts hash as empty ones."""
    out = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_recurring", "n_dropped", "copy_of", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
