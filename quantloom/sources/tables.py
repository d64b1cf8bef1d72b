"""Tables in the shapes in which they come, and how they are extended, filled and updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain_positions(chains: DataFrame) -> DataFrame:
    """(chain, code, position) of (chain, codes in order): 0 for the first to 1 for the last; 0 where there is one."""
    each = chains.select("chain", F.greatest(F.size("codes") - 1, F.lit(1)).alias("n"), F.posexplode("codes").alias("i", "code"))
    return each.select("chain", "code", (F.col("i") / F.col("n")).alias("position"))


def statements(long: DataFrame, keys: list[str], types: list[str], kind: str = "type", value: str = "value", order: str = "order") -> DataFrame:
    """Long rows, of which only `types` count, as a column a type: of several values the first by `order` that is known."""
    first = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
    return long.filter(F.col(kind).isin(*types)).groupBy(*keys).pivot(kind, types).agg(first)


def long_series(bars: DataFrame, least: int) -> DataFrame:
    """Bars of codes that have more than `least` of them."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("code"))).filter(F.col("_n") > least).drop("_n")


def lookup(instruments: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """Instruments (code, name) whose code begins with, or whose name contains, one of some texts, whatever the case."""
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.startswith(F.col("code").cast("string"), F.lit(text)) | F.contains(F.lower("name"), F.lit(text.lower()))
    return instruments.filter(hit)


def extend(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks; repeated keys within `new` count once. Only keys of `old` are read for that."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def back_fill(old: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`old` with missing values of some columns from the rows of `fresh` with the same keys; known values stay."""
    new = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(new, keys, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*old.columns)


def update(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """`old` with columns set by rules over `old` and `new`, its value and that of the row of `new` with the same keys; other rows stay."""
    other = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in rules), F.lit(True).alias("_met"))
    out = old.join(other, keys, "left")
    value = lambda c, rule: F.when(F.col("_met"), F.expr(f"transform(array(struct({c} AS old, _new_{c} AS new)), x -> {rule.replace('old', 'x.old').replace('new', 'x.new')})[0]")).otherwise(F.col(c))
    return out.withColumns({c: value(c, rule) for c, rule in rules.items()}).select(*old.columns)


def carried(rows: DataFrame, known: DataFrame, on: list[str], columns: list[str], key: str = "code", order: str = "date") -> DataFrame:
    """`rows` with columns of `known` that match all of `on` exactly, carried on along each key; what matches no row is lost."""
    met = rows.join(known, on, "left")
    w = Window.partitionBy(key).orderBy(order)
    return met.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
