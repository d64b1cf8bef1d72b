"""Trades as brokers export them: files of any of the usual headings, dates and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a heading by which a column is known, in order; the first column of a heading counts last.
HEADINGS = {
    "date": ("日期", "date", "交易日"),
    "code": ("代號", "代碼", "code", "股號", "證券代號"),
    "name": ("名稱", "name", "股名", "證券名稱"),
    "action": ("買賣", "action", "交易", "買賣別"),
    "shares": ("股數", "shares", "成交股數", "數量"),
    "price": ("價格", "price", "成交價", "單價", "成交價格"),
}
#: Parts of an action that mean buying and selling.
BUYING, SELLING = ("買", "buy", "Buy", "B"), ("賣", "sell", "Sell", "S")


def headings(columns: list[str]) -> dict[str, str]:
    """Which column is which."""
    out: dict[str, str] = {}
    for column in columns:
        low = column.lower().strip()
        kind = next((k for k, parts in HEADINGS.items() if any(p in low for p in parts)), None)
        if kind:
            out[kind] = column
    return out


def trade_date(text: Column) -> Column:
    """2024-01-15, 2024/1/15, 20240115 or 113/01/15 (years since 1911); anything else is null."""
    text = F.trim(text)
    parts = F.split(F.regexp_replace(text, "/", "-"), "-")
    year = F.try_to_number(parts[0], F.lit("9999")).cast("int")
    whole = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).when(
        text.rlike(r"^\d{2,4}[-/]\d{1,2}[-/]\d{1,2}$"), F.concat_ws("-", F.lpad(F.when(year < 1000, year + 1911).otherwise(year).cast("string"), 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    )
    return F.try_to_date(whole, "yyyy-MM-dd")


def normalised_trades(rows: DataFrame, order: str | None = None) -> DataFrame:
    """date, code, name, lots, price, side (1 bought, -1 sold, 0 neither) and seq of rows of text columns.

    Columns are found by headings(); without one for date or code it is an error, without one for the action all is bought.
    Rows without a date or code, and those without shares or a price above 0, are left out. A lot is 1,000 shares, rounded
    down, but for one at least. `order` is a column that orders the trades of a day; else their rows do.
    """
    of = headings([c for c in rows.columns if c != order])
    if not {"date", "code"} <= of.keys():
        raise ValueError(f"no columns for date and code among {rows.columns}")
    text = lambda k, default: F.trim(F.coalesce(F.col(f"`{of[k]}`"), F.lit(""))) if k in of else F.lit(default)
    number = lambda k: F.expr(f"try_cast(replace(`{of[k]}`, ',', '') AS double)") if k in of else F.lit(0.0)
    some = lambda x, parts: F.coalesce(*(F.when(F.contains(x, F.lit(p)), True) for p in parts), F.lit(False))
    action = text("action", BUYING[0])
    side = F.when(some(action, BUYING), 1).when(some(action, SELLING), -1).otherwise(0)
    seq = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    out = rows.select(trade_date(text("date", "")).alias("date"), F.regexp_replace(text("code", ""), r"\.(TW|tw)", "").alias("code"), text("name", "").alias("name"), number("shares").cast("long").alias("shares"), number("price").alias("price"), side.alias("side"), seq.alias("seq"))
    out = out.filter("date IS NOT NULL AND code <> '' AND shares > 0 AND price > 0")
    return out.select("date", "code", "name", F.greatest(F.floor(F.col("shares") / 1000), F.lit(1)).cast("long").alias("lots"), "price", "side", "seq")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """normalised_trades() of CSV files with a line of headings."""
    return normalised_trades(spark.read.option("header", True).csv(path))
