"""Feature families: technicals for the feature matrix, relative strength against an index or a median, institutions, brokers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, deviation, full, history, lag, last_rows, mean, numbered, rank_pct, run_length
from quantloom.operators.indicators import moving, recursive


def _slope(x: str, n: int) -> Column:
    """Least-squares slope of the last n rows by row number; needs numbered()."""
    return full(n, F.regr_slope(F.col(x), F.col("_row").cast("double")).over(last_rows(n)), x)


def _position(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def feature_technicals(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The technical columns of a feature matrix, per bar: returns, ratios to averages, band position, RSI as a share,
    MACD histogram over the close, stochastic of 14 bars and its 3-bar mean, ranges, gap, slope and volatility.

    `keep` names columns of the bars, of moving(), or _row, a bar's number, to return, too.
    """
    rows = numbered(bars)
    low, high = full(14, F.min("low").over(last_rows(14)), "low"), full(14, F.max("high").over(last_rows(14)), "high")
    rows = rows.withColumns({"ret_1d": change("close"), "ret_5d": change("close", 5), "ret_20d": change("close", 20), "kd_k": _position(F.col("close"), low, high), "trend_slope_20": F.try_divide(_slope("close", 20), "close")})
    rows = recursive(rows.withColumns({"kd_d": mean("kd_k", 3), "volatility_20": deviation("ret_1d", 20), "gap_pct": F.try_divide("open", lag("close")) - 1}), only=(*(x := ("sma_5", "sma_20", "sma_60", "bb_pct", "rsi_span", "macd_hist", "atr_pct", "vol_ratio", "vol_20")), *(c for c in keep if c not in (*x, "_row", *bars.columns))))
    ratio = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return rows.select(
        "code", "date", "ret_1d", "ret_5d", "ret_20d", ratio("close", "sma_5").alias("ma5_ratio"), ratio("close", "sma_20").alias("ma20_ratio"), ratio("close", "sma_60").alias("ma60_ratio"), F.col("bb_pct").alias("bb_position"),
        F.col("rsi_span").alias("rsi_14"), ratio("macd_hist", "close").alias("macd_hist"), "kd_k", "kd_d", "atr_pct", F.col("vol_ratio").alias("vol_ratio_5"), ratio("volume", "vol_20").alias("vol_ratio_20"),
        F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("high_low_range"), _position(F.col("close"), F.col("low"), F.col("high")).alias("close_vs_high"), "gap_pct", "trend_slope_20", "volatility_20", *keep,
    )


def close_technicals(bars: DataFrame, least: int = 60) -> DataFrame:
    """The same from closes alone, for codes of at least `least` bars; the range is the absolute return, the average range its exponential mean."""
    enough = F.count(F.lit(1)).over(Window.partitionBy("code")) >= least
    rows = numbered(bars.select("code", "date", "high", "low", "close").withColumn("_enough", enough).filter("_enough").drop("_enough"))
    low, high = full(14, F.min("close").over(last_rows(14)), "close"), full(14, F.max("close").over(last_rows(14)), "close")
    top = full(20, F.max("close").over(last_rows(20)), "close")
    rows = rows.withColumns({"ret_1d": change("close"), "kd_k": _position(F.col("close"), low, high), "trend_slope_20": F.try_divide(_slope("close", 20), "close"), "close_vs_high": F.try_divide(F.col("close"), top), "ret_60": change("close", 60)})
    rows = recursive(rows.withColumns({"kd_d": mean("kd_k", 3), "volatility_20": deviation("ret_1d", 20)}), only=("rsi_alpha", "macd_hist", "atr_ewm"))
    rows = rows.withColumn("rs_raw", (1 + F.col("ret_60")) / (1 + F.median("ret_60").over(Window.partitionBy("date"))) - 1)
    return rows.select("code", "date", "ret_1d", F.col("rsi_alpha").alias("rsi_14"), F.try_divide("macd_hist", "close").alias("macd_hist"), "kd_k", "kd_d", F.col("atr_ewm").alias("atr_pct"), F.abs("ret_1d").alias("high_low_range"), "close_vs_high", "trend_slope_20", "volatility_20", rank_pct("rs_raw").alias("rs_rating"))


def latest_technicals(bars: DataFrame) -> DataFrame:
    """Per code of at least 20 bars its last close, change, ratios to averages, RSI and mean absolute return of 14 bars."""
    rows = bars.withColumn("move", F.abs(change("close"))).withColumns({"mean_move": mean("move", 14), "change_pct": change("close"), "n": F.count(F.lit(1)).over(Window.partitionBy("code"))})
    rows = recursive(rows, last=1, only=("sma_5", "sma_20", "sma_60", "rsi_span")).filter("n >= 20")
    return rows.select("code", "date", "close", "change_pct", *(F.try_divide("close", f"sma_{k}").alias(f"ma{k}_ratio") for k in (5, 20, 60)), (F.col("rsi_span") * 100).alias("rsi_14"), F.col("mean_move").alias("atr_pct"))


def strength_to_index(bars: DataFrame, index: DataFrame, days: int = 63) -> DataFrame:
    """Return over `days` bars less the index's, and its rank of the day as a share. The index is a row a day."""
    whole = index.withColumn("code", F.lit(0)).select("date", change("close", days).alias("index_ret"))
    rows = bars.select("code", "date", change("close", days).alias("ret")).join(whole, "date", "left").withColumn("rs_raw", F.col("ret") - F.col("index_ret"))
    return rows.select("code", "date", "rs_raw", rank_pct("rs_raw").alias("rs_rating"))


def strength_to_median(bars: DataFrame, days: int = 60) -> DataFrame:
    """Growth over `days` bars against the day's median growth, and its rank of the day as a share."""
    rows = bars.select("code", "date", change("close", days).alias("ret")).withColumn("rs_raw", (1 + F.col("ret")) / (1 + F.median("ret").over(Window.partitionBy("date"))) - 1)
    return rows.select("code", "date", "rs_raw", rank_pct("rs_raw").alias("rs_rating"))


def strength_of_pool(bars: DataFrame, least: int = 5) -> DataFrame:
    """Each day's rating of all codes with 140 bars of history: (p0/p120)^.6 (p20/p140)^.4, place / (n - 1) * 100; none for fewer than `least` codes."""
    ratio = F.pow(F.try_divide("close", lag("close", 120)), 0.6) * F.pow(F.try_divide(lag("close", 20), lag("close", 140)), 0.4)
    rows = bars.select("code", "date", ratio.alias("rs")).filter("rs IS NOT NULL")
    day = Window.partitionBy("date")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(day), "place": F.row_number().over(day.orderBy("rs", "code")) - 1}).filter(F.col("n") >= least)
    return rows.select("code", "date", "rs", (F.col("place") / (F.col("n") - 1) * 100).alias("rating"))


def strength_summary(scan: DataFrame) -> DataFrame:
    """One row for a strength scan (rs_ratio): codes, mean, median and sample deviation."""
    return scan.agg(F.count("rs_ratio").alias("codes"), F.avg("rs_ratio").alias("mean"), F.median("rs_ratio").alias("median"), F.stddev_samp("rs_ratio").alias("sd"))


def cluster_risk(sectors: DataFrame, heat: str = "heat", share: str = "diamond_share") -> DataFrame:
    """Sectors with their crowding: danger, caution or normal by the share of top-rated codes and heat; missing heat is 0."""
    # Fixed values.
    danger, caution = (0.5, 0.75), (0.3, 0.6)
    over = lambda at: (F.col(share) >= at[0]) & (F.coalesce(F.col(heat), F.lit(0.0)) >= at[1])
    return sectors.withColumn("risk", F.when(over(danger), "danger").when(over(caution), "caution").otherwise("normal"))


def sector_concentration(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Share of a sector's codes among all codes of the day: a row a day and sector."""
    n = bars.join(sectors, "code").groupBy("date", "sector").agg(F.count(F.lit(1)).alias("n"))
    return n.select("date", "sector", (F.col("n") / F.sum("n").over(Window.partitionBy("date"))).alias("sector_concentration"))


def regime_tag(index: DataFrame, days: int = 200) -> DataFrame:
    """Per day of the index 1 above its average of `days` bars, -1 at or below it, 0 where that is unknown."""
    rows = index.withColumn("code", F.lit(0)).withColumn("average", mean("close", days))
    return rows.select("date", F.when(F.col("average").isNull() | F.col("close").isNull(), 0).when(F.col("close") > F.col("average"), 1).otherwise(-1).alias("regime_tag"))


def institutional(bars: DataFrame, nets: DataFrame, margin: DataFrame, holdings: DataFrame) -> DataFrame:
    """Net buying of three kinds of institutions and of all over the volume, its 5-row sum, changes of margin and short
    balances and their use, and of the last known foreign holding."""
    rows = bars.select("code", "date", "volume").join(nets, ["code", "date"], "left").join(margin, ["code", "date"], "left").join(holdings, ["code", "date"], "left")
    return institutional_columns(rows)


def institutional_columns(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """institutional() of bars' rows (code, date, volume) that have all of its other columns; `keep` names columns to return, too."""
    rows = rows.withColumns({f"inst_{k}_net": F.try_divide(f"{k}_net", "volume") for k in ("foreign", "trust", "dealer", "total")})
    known = F.last("foreign_holding", ignorenulls=True).over(history())
    rows = rows.withColumns({"inst_5d_sum": F.sum("inst_total_net").over(last_rows(5)), "margin_balance_chg": change("margin_balance"), "short_balance_chg": change("short_balance"), "tdcc_concentration": known})
    rows = rows.withColumn("tdcc_big_chg", F.col("tdcc_concentration") - lag("tdcc_concentration"))
    return rows.select("code", "date", "inst_foreign_net", "inst_trust_net", "inst_dealer_net", "inst_total_net", "inst_5d_sum", "margin_balance_chg", "short_balance_chg", "margin_utilization", (-F.col("tdcc_big_chg")).alias("tdcc_retail_chg"), "tdcc_big_chg", "tdcc_concentration", *keep)


def broker_day(flows: DataFrame, foreign: tuple[int, ...] = (), registry: DataFrame | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """The fourteen broker features of a code's day but for the price divergence: a row for each day with flows.

    `flows` is (code, broker, date, buy, sell), `registry` (broker, tier): winners are the brokers of a tier. Buyers and sellers are ranked by their net; shares are net over turnover.
    What hangs on earlier days reads the days before this one that have flows. `also` has further sums of the day's flows, by name.
    """
    net = F.col("buy") - F.col("sell")
    day = Window.partitionBy("code", "date")
    tiers = registry.select("broker", "tier").filter("tier IS NOT NULL") if registry is not None else None
    rows = flows.join(F.broadcast(tiers), "broker", "left") if tiers is not None else flows.withColumn("tier", F.lit(None).cast("int"))
    rows = rows.withColumns({"net": net, "turnover": F.sum(F.col("buy") + F.col("sell")).over(day)}).withColumn("pct", F.try_divide(F.abs("net"), "turnover"))
    rows = rows.withColumns({"up": F.row_number().over(day.orderBy(F.desc("net"), "broker")), "down": F.row_number().over(day.orderBy("net", "broker"))})
    # A row a day and broker, whatever the number of codes: so the flows need not be shuffled by them.
    bought = flows.filter(net > 0).groupBy(F.col("date").alias("_date"), F.col("broker").alias("_broker")).agg(F.count(F.lit(1)).alias("spread_of"))
    rows = rows.join(F.broadcast(bought), F.col("date").eqNullSafe(F.col("_date")) & F.col("broker").eqNullSafe(F.col("_broker")), "left")
    buyer, seller = F.col("net") > 0, F.col("net") < 0
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0))
    some = lambda ids: F.col("broker").isin(*ids) if ids else F.lit(False)
    top3 = buyer & (F.col("up") <= 3)
    out = rows.groupBy("code", "date").agg(
        F.sum(F.when(F.col("pct") > 0, F.col("pct") * F.col("pct"))).alias("hhi"), F.sum(F.when(top3, F.col("pct"))).alias("top3_pct"), total(buyer & (F.col("up") <= 5), "net").alias("b5"), total(seller & (F.col("down") <= 5), "net").alias("s5"),
        F.count(F.when(buyer, 1)).alias("buyers"), F.count(F.when(seller, 1)).alias("sellers"), F.count(F.when(top3 & F.col("tier").isNotNull(), 1)).alias("won"), F.count(F.when(top3 & (F.col("tier") == 1), 1)).alias("first_rank"),
        F.try_divide(total(buyer & some(foreign), "buy"), total(buyer, "buy")).alias("foreign_pct"), F.avg(F.when(buyer & (F.col("up") <= 5), F.col("spread_of"))).alias("overlap"), F.first("turnover").alias("turnover"),
        *(x.alias(c) for c, x in (also or {}).items()),
    )
    weight = F.abs("b5") + F.abs("s5")
    out = numbered(out.withColumn("net_buy_ratio", F.when(weight > 0, F.col("b5") / weight).otherwise(0.5)))
    w5, w20 = last_rows(5), last_rows(20)
    strong = F.coalesce("top3_pct", F.lit(0.0)) >= 0.4
    purity = F.col("top3_pct") * 100 * (F.try_divide(F.col("won"), F.least(F.lit(3), "buyers")) if registry is not None else F.lit(0.5))
    out = out.withColumns({"_up": F.col("net_buy_ratio") > 0.5, "_down": F.col("net_buy_ratio") < 0.5})
    return out.select(
        "code", "date", "hhi", "top3_pct", (F.col("hhi") - lag("hhi")).alias("hhi_delta"), "net_buy_ratio",
        F.when(F.col("sellers") > 0, F.col("buyers") / F.col("sellers")).when(F.col("buyers") > 0, F.col("buyers").cast("double")).otherwise(1.0).alias("spread"),
        F.when(F.count(F.lit(1)).over(w5) >= 5, F.avg("net_buy_ratio").over(w5)).otherwise(F.col("net_buy_ratio")).alias("net_momentum_5d"), F.when(strong, purity).otherwise(0.0).alias("purity"), F.coalesce("foreign_pct", F.lit(0.0)).alias("foreign_pct"),
        "overlap", F.when(F.count(F.lit(1)).over(w20) >= 11, F.stddev_samp("net_buy_ratio").over(w20)).alias("net_buy_volatility"), (F.try_divide("turnover", lag("turnover")) - 1).alias("turnover_chg"),
        (run_length("_up") - run_length("_down")).alias("streak"), (F.least(F.col("first_rank"), F.lit(2)) * 50).alias("winner_momentum"), *(also or {}),
    )


def price_divergence(bars: DataFrame) -> DataFrame:
    """Per bar the close less its typical price over the average range; 0 where the range is none."""
    return moving(bars).select("code", "date", divergence().alias("price_divergence"))


def divergence() -> Column:
    """price_divergence() of columns high, low, close and atr_14."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.when(F.col("atr_14") > 0, (F.col("close") - typical) / F.col("atr_14")).when(F.col("atr_14").isNotNull(), 0.0)


def accumulation_score(brokers: DataFrame, days: int = 20, every: bool = False) -> DataFrame:
    """Per day with `days` rows: 0.4 winner momentum + 0.25 streak + 0.2 concentration + 0.15 net buying, means of the last rows
    of broker_day()'s purity, streak, top3_pct and net_buy_ratio, which should be normalised to have one scale; confirmed
    winners (a positive mean of winner_momentum) add a fifth to the first. Missing values are left out of their mean. With `every`, days with fewer rows have no score and stay."""
    w = last_rows(days)
    part = lambda x: F.coalesce(F.avg(x).over(w), F.lit(0.0))
    rows = brokers.withColumns({"n": F.count(F.lit(1)).over(w), "_purity": part("purity"), "_bonus": part("winner_momentum"), "_streak": part("streak"), "_top3": part("top3_pct"), "_net": part("net_buy_ratio")})
    rows = rows if every else rows.filter(F.col("n") >= days)
    winner = F.col("_purity") * F.when(F.col("_bonus") > 0, 1.2).otherwise(1.0)
    score = 0.4 * winner + 0.25 * F.col("_streak") + 0.2 * F.col("_top3") + 0.15 * F.col("_net")
    return rows.select("code", "date", F.when(F.col("n") >= days, score).alias("score"))
