"""What trades, signals and portfolios have done: multiples of risk, discipline, decay, paths, drift, stops, sizes, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import history, last_rows

#: Share of a trade that both sides of it cost.
COST = 0.005855


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def r_multiples(trades: DataFrame, entry: str = "entry", exit_: str = "exit", stop: str = "stop") -> DataFrame:
    """`trades` with r, the gain in units of the initial risk (entry less stop); 0 where there is no risk."""
    risk = F.col(entry) - F.col(stop)
    return trades.withColumn("r", F.when(risk > 0, (F.col(exit_) - F.col(entry)) / risk).otherwise(0.0))


def track(positions: DataFrame) -> DataFrame:
    """`positions` (entry, current, stop, exit or null) with intended_r at the current price, realized_r at the exit, gap_r
    between them (null where both prices are equal), their status by the realized or else the intended one, and the risk of a share."""
    risk = F.col("entry") - F.col("stop")
    gain = lambda price: F.when(risk > 0, (F.col(price) - F.col("entry")) / risk).otherwise(0.0)
    closed = F.col("exit").isNotNull()
    out = positions.withColumns({"intended_r": gain("current"), "realized_r": F.when(closed, gain("exit"))})
    r = F.coalesce("realized_r", "intended_r")
    status = F.when(r >= 3, "Home Run").when(r >= 1, "1R Winner").when(F.abs(r) < 0.1, "Breakeven").when(r < 0, "Initial Risk").otherwise("Partial Gain")
    gap = F.when(closed & (F.col("exit") != F.col("current")), F.col("realized_r") - F.col("intended_r"))
    return out.withColumns({"gap_r": gap, "status": status, "risk": F.when(F.col("stop") > 0, risk).otherwise(0.0), "closed": closed})


def kill_switch(signals: DataFrame, days: float = 30, win_rate: float = 0.45, profit_factor: float = 1.5) -> DataFrame:
    """One row for (ttb, d7, d21, d30, busted): five criteria, each with its value and whether it holds, and the verdict.

    Days to breakout (median), win rate, profit factor and mean of the net 21-day returns, and a 7-day median above the
    30-day one. KILL if one of the three of returns fails, WARNING if another does, NO_DATA without signals. A missing ttb is a time-out.
    """
    net = F.col("d21") - COST
    won, lost = F.sum(F.when(net > 0, net)), F.abs(F.sum(F.when(net <= 0, net)))
    out = signals.agg(
        F.count(F.lit(1)).alias("signals"), F.median("ttb").alias("ttb_median"), F.avg(F.when(net > 0, 1.0).when(net <= 0, 0.0)).alias("win_rate"), F.try_divide(F.coalesce(won, F.lit(0.0)), lost).alias("profit_factor"), F.avg(net).alias("net_return"),
        F.median("d7").alias("d7_median"), F.median("d30").alias("d30_median"), F.avg(F.when(F.col("busted"), 1.0).otherwise(0.0)).alias("busted_rate"), F.avg(F.when(F.col("ttb").isNull(), 1.0).otherwise(0.0)).alias("timeout_rate"),
    )
    tests = {"ttb_ok": F.col("ttb_median") <= days, "win_ok": F.col("win_rate") >= win_rate, "factor_ok": F.col("profit_factor") >= profit_factor, "net_ok": F.col("net_return") > 0, "decay_ok": F.col("d7_median") > F.col("d30_median")}
    out = out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in tests.items()})
    verdict = F.when(F.col("signals") == 0, "NO_DATA").when(~(F.col("win_ok") & F.col("factor_ok") & F.col("net_ok")), "KILL").when(~(F.col("ttb_ok") & F.col("decay_ok")), "WARNING").otherwise("PASS")
    return out.withColumn("verdict", verdict)


def expectancy(trades: DataFrame, *by: str, zone: float = 0.1) -> DataFrame:
    """Of (r), per group: win and loss rates, mean sizes, expectancy with its grade, extremes, and the distribution in eight buckets."""
    r = F.col("r")
    won, lost, n = r > zone, r < -zone, F.count(F.lit(1))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    count = lambda c: F.count(F.when(c, 1))
    mean = lambda c: F.coalesce(F.abs(F.avg(F.when(c, r))), F.lit(0.0))
    buckets = {"below_m2": r < -2, "m2_to_m1": (r >= -2) & (r < -1), "m1_to_0": (r >= -1) & lost, "even": F.abs(r) <= zone, "0_to_1": (r >= zone) & (r < 1), "1_to_2": (r >= 1) & (r < 2), "2_to_3": (r >= 2) & (r < 3), "above_3": r >= 3}
    out = trades.groupBy(*by).agg(
        n.alias("trades"), share(won).alias("win_rate"), share(lost).alias("loss_rate"), mean(won).alias("avg_win_r"), mean(lost).alias("avg_loss_r"), F.max("r").alias("best_r"), F.min("r").alias("worst_r"), *(count(c).alias(f"n_{k}") for k, c in buckets.items())
    )
    value = F.col("win_rate") * F.col("avg_win_r") - F.col("loss_rate") * F.col("avg_loss_r")
    grade = F.when(F.col("trades") < 10, "insufficient").when(F.col("expectancy") < 0, "losing").when(F.col("expectancy") < 0.5, "break-even").when(F.col("expectancy") < 1, "profitable").otherwise("excellent")
    return out.withColumn("expectancy", value).withColumn("grade", grade)


def discipline(trades: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: score of the confidence at entry (100 from 1 on, 70 from 0.5 on, else 30; missing or zero counts as 0.7), and how many trades of each."""
    c = F.coalesce(F.when(F.col(confidence) != 0, F.col(confidence)), F.lit(0.7))
    kind = F.when(c >= 1, 100.0).when(c >= 0.5, 70.0).otherwise(30.0)
    count = lambda x: F.count(F.when(kind == x, 1))
    return trades.agg(F.coalesce(F.avg(kind), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("trades"), count(100.0).alias("high"), count(70.0).alias("middle"), count(30.0).alias("low"))


def confidence_brackets(trades: DataFrame, edges: tuple[float, ...] = (0.5, 1.0, 1.2), confidence: str = "confidence") -> DataFrame:
    """Trades, mean return and win rate by half-open brackets of confidence (0 is below the first edge); missing confidence is in none."""
    bracket = F.lit(0)
    for k, edge in enumerate(edges, 1):
        bracket = F.when(F.col(confidence) >= edge, k).otherwise(bracket)
    rows = trades.filter(F.col(confidence).isNotNull()).groupBy(bracket.alias("bracket"))
    return rows.agg(F.count(F.lit(1)).alias("trades"), F.avg("ret").alias("avg_return"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def recent(trades: DataFrame, since: Column, exit_: str = "close_date") -> DataFrame:
    """One row for the trades that closed at or after `since`: trades, wins, win rate and mean return; zeros if there are none."""
    won = F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)
    return trades.filter(F.col(exit_) >= since).agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"), F.coalesce(F.avg(won), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg("ret"), F.lit(0.0)).alias("avg_return"))


def decay_curve(forward: DataFrame, by: str, horizons: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """Mean return and number of values at each day after a signal, per group; expected value net of COST."""
    long = forward.unpivot([by], [f"d{h}" for h in horizons], "horizon", "ret").filter("ret IS NOT NULL").withColumn("day", F.substring("horizon", 2, 9).cast("int"))
    win = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    gain, loss = (F.coalesce(F.avg(F.when(c, F.col("ret"))), F.lit(0.0)) for c in (F.col("ret") > 0, F.col("ret") <= 0))
    out = long.groupBy(by, "day").agg(F.avg("ret").alias("avg_return"), F.count(F.lit(1)).alias("n"), (win * gain - (1 - win) * F.abs(loss)).alias("ev"))
    return out.withColumns({"net_ev": F.col("ev") - COST, "cost_trap": (F.col("ev") > 0) & (F.col("ev") < COST)})


def forward_paths(bars: DataFrame, days: int) -> DataFrame:
    """`bars` with path: the closes of this bar and up to `days` after it, over this close."""
    ahead = F.collect_list("close").over(history().rowsBetween(0, days))
    return bars.withColumn("path", F.transform(ahead, lambda x: F.try_divide(x, F.col("close"))))


def path_statistics(cases: DataFrame) -> DataFrame:
    """Of (case, path): per day after the start mean, median and quartiles over all paths that reach it, and the paths that end worst and best (ties: the least case)."""
    each = cases.select("case", F.posexplode("path").alias("day", "x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    days = each.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), q.alias("q"))
    end = F.coalesce(F.element_at("path", -1), F.lit(1.0))
    ends = cases.agg(F.min_by("path", F.struct(end, "case")).alias("worst"), F.max_by("path", F.struct(end, F.negate("case"))).alias("best"))
    place = lambda c: F.get(c, F.col("day"))
    return days.crossJoin(F.broadcast(ends)).select("day", "n", "mean", *(F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("p25", "median", "p75"))), place("worst").alias("worst"), place("best").alias("best"))  # one row of ends


def confidence_score(cases: DataFrame, by: str, ret: str = "d21") -> DataFrame:
    """Per group 30 points for size (30 cases), 40 for agreement in size (deviation over mean), 30 for agreement in direction; grade; 95 % interval net of COST."""
    net = F.col(ret) - COST
    out = cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.count(ret).alias("n"), F.avg(net).alias("mean"), F.stddev_pop(net).alias("sd"), F.count(F.when(F.col(ret) > 0, 1)).alias("up"))
    mean = F.abs(F.round("mean", 4))
    spread = F.when(mean > 0.001, F.abs(F.round("sd", 4)) / mean).otherwise(10.0)
    size, same = F.least(F.col("cases") / 30.0, F.lit(1.0)) * 30, F.coalesce(_clip((3 - spread) / 2.5, 0.0, 1.0) * 40, F.lit(0.0))
    direction = F.coalesce(F.try_divide(F.greatest(F.col("up"), F.col("n") - F.col("up")), F.col("n")) * 30, F.lit(0.0))
    out = out.withColumn("score", F.bround(size + same + direction, 0))
    se = F.col("sd") / F.sqrt(F.greatest("n", F.lit(1)))
    return out.select(by, "cases", "score", F.when(F.col("score") >= 65, "HIGH").when(F.col("score") >= 40, "MEDIUM").otherwise("LOW").alias("grade"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"))


def hit_rate(forward: DataFrame, by: str, horizons: list[str]) -> DataFrame:
    """Per group the share of cases all of whose known returns are above 0; cases without any are left out."""
    known = F.array_compact(F.array(*horizons))
    return forward.filter(F.size(known) > 0).groupBy(by).agg(F.avg(F.when(F.forall(known, lambda x: x > 0), 1.0).otherwise(0.0)).alias("hit_rate"), F.count(F.lit(1)).alias("n"))


def group_success(signals: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Per group the share of signals within their bounds and the points it earns: +3 above 70 %, -5 below 40 %; none below `least` judged signals."""
    rate = F.when(F.count("inside") >= least, F.avg(F.col("inside").cast("int").cast("double")))
    out = signals.groupBy(by).agg(F.count("inside").alias("n"), rate.alias("rate"))
    return out.withColumn("adjustment", F.when(F.col("rate") > 0.7, 3).when(F.col("rate") < 0.4, -5).otherwise(0))


def slippage(fills: DataFrame, by: str, least: int = 5) -> DataFrame:
    """Of (planned, paid), per group: count, median, 95th percentile and mean in basis points, and whether that is high (median 50 or p95 150 on)."""
    rows = fills.withColumn("bps", F.try_divide(F.col("paid") - F.col("planned"), F.col("planned")) * 10000).filter("bps IS NOT NULL")
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.median("bps").alias("median_bps"), F.percentile("bps", F.lit(0.95)).alias("p95_bps"), F.avg("bps").alias("avg_bps"))
    return out.withColumn("status", F.when(F.col("n") < least, "INSUFFICIENT_DATA").when((F.col("median_bps") >= 50) | (F.col("p95_bps") >= 150), "HIGH").otherwise("LOW"))


def payload(trades: DataFrame, by: str) -> DataFrame:
    """Per group the share of all profit that the best twentieth of winning trades (one at least) makes, and trades above 50 %."""
    w = Window.partitionBy(by)
    rows = trades.withColumns({"wins": F.count(F.when(F.col("ret") > 0, 1)).over(w), "place": F.row_number().over(w.orderBy(F.desc_nulls_last("ret")))})
    top = F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("wins") * 0.05))
    gain = F.sum(F.greatest(F.col("ret"), F.lit(0.0)))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("trades"), F.coalesce(F.try_divide(F.sum(F.when(top, F.greatest(F.col("ret"), F.lit(0.0)))), gain), F.lit(0.0)).alias("payload_ratio"), F.count(F.when(F.col("ret") > 0.5, 1)).alias("home_runs"))


def score_distribution(scores: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, deviation and the deciles p10, p25, p50, p75 and p90 of a score."""
    marks = (10, 25, 50, 75, 90)
    out = scores.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.percentile(column, F.array(*(F.lit(m / 100) for m in marks))).alias("q"))
    return out.select("n", "mean", "sd", *(F.get("q", F.lit(k)).alias(f"p{m}") for k, m in enumerate(marks)))


def drift(realised: DataFrame, window: int = 20, overlap: int = 10, least: int = 5) -> DataFrame:
    """One row for realised signals (id, date, ret, expected, low, high): mean drift and z of the newest `window`, their direction,
    whether the last three half-overlapping windows get worse, and the alert. None below `least` signals.

    A signal's deviation is that of its interval, or 8 % without one.
    """
    sigma = F.coalesce((F.col("high") - F.col("low")) / 3.92, F.lit(0.08))
    rows = realised.filter("ret IS NOT NULL").withColumn("drift", F.col("ret") - F.coalesce("expected", F.lit(0.0))).withColumn("z", F.when(sigma > 0, F.col("drift") / sigma).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("date"), "id"))
    newest = rows.orderBy(F.desc("date"), "id").limit(window + 2 * overlap).withColumn("n", place)  # the windows' rows only
    at = lambda k: F.avg(F.when((F.col("n") > k * overlap) & (F.col("n") <= k * overlap + window), F.col("z")))
    out = newest.agg(F.avg(F.when(F.col("n") <= window, F.col("drift"))).alias("drift"), *(at(k).alias(f"z{k}") for k in range(3)))
    out = rows.agg(F.count(F.lit(1)).alias("signals")).crossJoin(F.broadcast(out)).filter(F.col("signals") >= least)  # one row each
    worse = (F.col("signals") >= window + 2 * overlap) & (F.col("z0") < F.col("z1")) & (F.col("z1") < F.col("z2")) & (F.col("z0") < -0.75)
    alert = F.when(F.col("expanding"), "CRITICAL").when((F.abs("z0") > 1.5) | (F.abs("drift") > 0.15), "WARNING").otherwise("NORMAL")
    out = out.withColumns({"direction": F.when(F.col("drift") > 0.01, "POSITIVE").when(F.col("drift") < -0.01, "NEGATIVE").otherwise("NEUTRAL"), "expanding": F.coalesce(worse, F.lit(False))})
    return out.select("signals", "drift", F.col("z0").alias("z"), "direction", "expanding", alert.alias("alert"))


#: Average ranges between entry and stop, by kind of entry.
RANGES = (("squeeze_breakout", 1.5), ("oversold_bounce", 2.0), ("volume_ramp", 2.0), ("momentum_breakout", 2.0))


def range_adjustment(rate: Column) -> Column:
    """What a share of shaken-out stops adds to the ranges between entry and stop: 0.2 above 30 %, -0.1 below 15 %, else nothing."""
    return F.when(rate > 0.3, 0.2).when(rate < 0.15, -0.1).otherwise(0.0)


def range_multiple(kind: Column, adjustment: Column) -> Column:
    """Average ranges between entry and stop, from 1.5 to 3.5."""
    base = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in RANGES), F.lit(2.0))
    return _clip(base + adjustment, 1.5, 3.5)


#: Prices below which a tick has that size, and the size above all.
TICKS, LARGEST_TICK = ((10, 0.01), (50, 0.05), (100, 0.1), (500, 0.5), (1000, 1.0)), 5.0


def tick_size(price: Column) -> Column:
    """The least step of a price."""
    return F.coalesce(*(F.when(price < below, F.lit(float(size))) for below, size in TICKS), F.when(price.isNotNull(), F.lit(LARGEST_TICK)))


def swing_low(bars: DataFrame, look: int = 20, near: int = 5) -> DataFrame:
    """`bars` with swing_low: the newest low of the last `look` bars that none of the `near` bars on either side undercuts, else the
    least of all; null where there are fewer bars. What stands before the look-back counts for nothing, nor do its last bar's right side."""
    recent = F.collect_list("low").over(last_rows(look))
    sides = F.transform("_lows", lambda x, i: F.when((i >= near) & (i < look - 1) & (x <= F.array_min(F.slice("_lows", F.greatest(i - near, F.lit(0)) + 1, F.lit(2 * near + 1)))), x))
    rows = bars.withColumn("_lows", F.when(F.count("low").over(last_rows(look)) >= look, recent))
    found = F.element_at(F.array_compact(F.col("_found")), -1)
    return rows.withColumn("_found", sides).withColumn("swing_low", F.coalesce(F.when(F.size(F.array_compact("_found")) > 0, found), F.array_min("_lows"))).drop("_lows", "_found")


def initial_stop(entries: DataFrame, percent: float = 0.07) -> DataFrame:
    """`entries` (entry, kind, atr, adjustment, swing_low; pivot and pivot_score for a contraction) with stop and its method.

    The lowest of the swing low, entry less average ranges and entry less `percent`; a pivot less a tick, of score 70 on,
    replaces it where that is above the range stop. A stop that is not below the entry becomes the one by percent.
    """
    entries = entries.withColumn("_pivot", F.col("pivot") - tick_size(F.col("pivot")))
    ranged = F.col("entry") - F.col("atr") * range_multiple(F.col("kind"), F.col("adjustment"))
    structural = F.when(F.col("pivot_score") >= 70, F.col("_pivot")).when(F.col("pivot_score") >= 50, F.greatest("swing_low", "_pivot")).otherwise(F.col("swing_low"))
    by_percent = F.col("entry") * (1 - percent)
    named = lambda value, name: F.when(value > 0, F.struct(value.alias("stop"), F.lit(name).alias("method")))
    lowest = F.array_min(F.array_compact(F.array(named(structural, "structural"), named(ranged, "range"), named(by_percent, "percent"))))
    pivot = (F.col("pivot_score") >= 70) & (F.col("_pivot") > ranged)
    chosen = F.when(pivot, F.struct(F.col("_pivot").alias("stop"), F.lit("pivot").alias("method"))).otherwise(lowest)
    safe = F.when(chosen["stop"] >= F.col("entry"), F.struct(by_percent.alias("stop"), F.lit("percent").alias("method"))).otherwise(chosen)
    out = entries.withColumn("_chosen", safe).withColumns({"stop": F.col("_chosen.stop"), "method": F.col("_chosen.method")}).drop("_chosen", "_pivot")
    return out.withColumn("risk", F.try_divide(F.col("entry") - F.col("stop"), "entry"))


def shakeouts(bars: DataFrame, stops: DataFrame, days: int = 3, above: float = 1.02) -> DataFrame:
    """`stops` (code, date, stop) with shaken: the highest high of the next bars is above the stop by `above`; null without a next bar."""
    ahead = F.max("high").over(history().rowsBetween(1, days))
    return stops.join(bars.select("code", "date", ahead.alias("_high")), ["code", "date"], "left").withColumn("shaken", F.col("_high") > F.col("stop") * above).drop("_high")


def circuit_breaker(days: DataFrame) -> DataFrame:
    """`days` (daily, weekly, monthly: gains as shares; losses: losing trades in a row) with reasons and triggered."""
    tests = (("daily", F.col("daily") < -0.03), ("weekly", F.col("weekly") < -0.05), ("monthly", F.col("monthly") < -0.10), ("losses", F.col("losses") >= 5))
    return days.withColumn("reasons", F.concat_ws(";", *(F.when(c, F.lit(k)) for k, c in tests))).withColumn("triggered", F.col("reasons") != "")


def running_gains(days: DataFrame) -> DataFrame:
    """Of (date, pnl): the gain of the day, of its week (from Monday) and of its month so far, and losing days in a row."""
    so_far = lambda unit: F.sum("pnl").over(Window.partitionBy(F.date_trunc(unit, "date")).orderBy("date"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # a row a day
    rows = days.withColumn("_n", F.row_number().over(w))
    won = F.max(F.when(F.col("pnl") >= 0, F.col("_n"))).over(w)
    return rows.select("date", F.col("pnl").alias("daily"), so_far("week").alias("weekly"), so_far("month").alias("monthly"), (F.col("_n") - F.coalesce(won, F.lit(0))).alias("losses"))


def position_size(candidates: DataFrame, account: float = 1_000_000.0, var_limit: float = 0.02, most: float = 0.2, lot: int = 1000) -> DataFrame:
    """`candidates` (price, sd, current_var, max_corr, beta, confidence) with lots: within the budget of value at risk and the
    position limit, cut for correlation (above 0.75 by half, 0.5 by a quarter), beta (1.5: 30 %, 1.2: 15 %) and lack of confidence; one lot at
    least, none without budget."""
    by_size = F.greatest(F.lit(1), F.floor(F.lit(account * most) / (F.col("price") * lot)))
    each = 1.65 * F.coalesce("sd", F.lit(0.02)) * F.col("price") * lot / account
    budget = var_limit - F.col("current_var")
    by_var = F.when(each > 0, F.greatest(F.lit(1), F.floor(budget / each))).otherwise(by_size)
    corr = F.when(F.col("max_corr") > 0.75, 0.5).when(F.col("max_corr") > 0.5, 0.75).otherwise(1.0)
    beta = F.when(F.col("beta") > 1.5, 0.7).when(F.col("beta") > 1.2, 0.85).otherwise(1.0)
    lots = F.greatest(F.lit(1), F.floor(F.least(by_size, by_var) * corr * beta * (0.5 + 0.5 * F.least("confidence", F.lit(1.0)))))
    out = candidates.withColumn("lots", F.when(budget > 0, lots).otherwise(0))
    return out.withColumn("projected_var", F.col("current_var") + F.col("lots") * each)


def equal_risk_size(candidates: DataFrame, equity: float, risk: float = 0.03, quiet: float = 0.018, lot: int = 1000) -> DataFrame:
    """`candidates` (price, atr_pct, stop_pct, trending) with the share of the equity, shares in whole lots, and whether a single lot is more than the risk allows."""
    calm = F.when(F.col("trending") | (F.col("atr_pct") <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.lit(quiet) / F.col("atr_pct")))
    share = _clip(F.lit(risk) / F.col("stop_pct") * calm, 0.05, 0.9)
    whole = F.floor(F.lit(equity) * share / F.col("price") / lot) * lot
    floor = (whole < lot) & (F.lit(equity) >= F.col("price") * lot * 1.01)
    out = candidates.withColumns({"over_risk": floor, "shares": F.when(floor, lot).when(whole < lot, 0).otherwise(whole).cast("long")})
    return out.withColumn("position_pct", F.when(floor, F.col("shares") * F.col("price") / equity).otherwise(share))


def sector_multiplier(trades: DataFrame, held: DataFrame, cap: float) -> DataFrame:
    """`trades` (sector) with the factor that a sector's share of the value `held` leaves: cap over share above the cap, from 0.1 to 1."""
    total = held.groupBy("sector").agg(F.sum("value").alias("_v")).withColumn("_share", F.col("_v") / F.sum("_v").over(Window.partitionBy(F.lit(1))))  # a row a sector
    factor = F.when(F.col("_share") >= cap, _clip(F.lit(cap) / F.col("_share"), 0.1, 1.0)).otherwise(1.0)
    return trades.join(F.broadcast(total), "sector", "left").withColumn("multiplier", factor).drop("_v", "_share")


#: Name, fall of the market, factor of the volatility.
SCENARIOS = (("pullback", -0.03, 1.0), ("decline", -0.05, 1.3), ("crash", -0.10, 2.0), ("black_swan", -0.20, 3.0))


def scenarios(positions: DataFrame, account: float, var: float) -> DataFrame:
    """Per scenario the loss of (value, sd) positions, whose beta is sd / 1 % between 0.5 and 2.5, its share, positions that lose more than 5 %, and the stressed value at risk."""
    beta = _clip(F.coalesce(F.col("sd") / 0.01, F.lit(1.0)), 0.5, 2.5)
    each = positions.select("value", beta.alias("beta"), F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("shock"), F.lit(v).alias("vol")) for n, s, v in SCENARIOS))).alias("x")).select("value", "beta", "x.*")
    out = each.groupBy("scenario").agg(F.sum(F.col("value") * F.col("shock") * F.col("beta")).alias("loss"), F.count(F.when(F.abs(F.col("shock") * F.col("beta")) > 0.05, 1)).alias("at_risk"), (F.first("vol") * var).alias("stressed_var"))
    return out.withColumn("loss_pct", F.col("loss") / account)


def live_performance(curve: DataFrame, rf: float = 0.015) -> DataFrame:
    """One row for an equity curve (date, equity, benchmark): total return, greatest drawdown, annual alpha, beta, correlation, Sortino and Calmar.

    Downside is the root mean square over days that moved; ratios need ten of them, alpha and beta five.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # a row a day
    step = lambda c: F.when(F.lag(c).over(w) > 0, F.col(c) / F.lag(c).over(w) - 1)
    rows = curve.withColumns({"ret": step("equity"), "bench": step("benchmark"), "peak": F.max("equity").over(w)})
    both = lambda x: F.when(F.col("ret").isNotNull() & F.col("bench").isNotNull(), F.col(x))
    excess = F.when(F.round("ret", 4) != 0, F.round("ret", 4) - rf / 252)
    out = rows.agg(
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"), F.max(F.when(F.col("peak") > 0, 1 - F.col("equity") / F.col("peak")).otherwise(0.0)).alias("max_drawdown"), F.count(both("ret")).alias("n"),
        F.covar_samp(both("ret"), both("bench")).alias("cov"), F.var_samp(both("bench")).alias("var"), F.avg(both("ret")).alias("mean"), F.avg(both("bench")).alias("bench"), F.corr(both("ret"), both("bench")).alias("corr"),
        F.count(excess).alias("days"), F.avg(excess).alias("excess"), F.sqrt(F.avg(F.when(excess < 0, excess * excess).when(excess.isNotNull(), 0.0))).alias("down"),
    )
    beta = F.coalesce(F.try_divide("cov", "var"), F.lit(1.0))
    annual = F.pow(1 + F.col("total_return"), F.lit(252.0) / F.col("days")) - 1
    enough, some = F.col("days") >= 10, F.col("n") >= 5
    return out.select(
        "total_return", "max_drawdown", F.when(some, (F.col("mean") - beta * F.col("bench")) * 252).alias("alpha"), F.when(some, beta).alias("beta"), F.when(some, F.col("corr")).alias("correlation"),
        F.when(enough, F.coalesce(F.try_divide(F.col("excess") * F.sqrt(F.lit(252.0)), F.col("down")), F.lit(0.0))).alias("sortino"), F.when(enough, F.coalesce(F.try_divide(annual, F.col("max_drawdown")), F.lit(0.0))).alias("calmar"),
    )


def rolling_alpha(bars: DataFrame, index: DataFrame, window: int = 60, rf: float = 0.015) -> DataFrame:
    """Per code and day the daily and the annualised alpha against the index over the last `window` common days, of which four fifths must be known."""
    base = index.withColumn("code", F.lit(0)).select("date", (F.try_divide("close", F.lag("close").over(history())) - 1).alias("mkt"))
    rows = bars.select("code", "date", (F.try_divide("close", F.lag("close").over(history())) - 1).alias("ret")).join(base, "date").filter("ret IS NOT NULL AND mkt IS NOT NULL")
    w = last_rows(window)
    beta = F.try_divide(F.covar_samp("ret", "mkt").over(w), F.var_samp("mkt").over(w))
    daily = F.avg("ret").over(w) - (rf / 252 + beta * (F.avg("mkt").over(w) - rf / 252))
    alpha = F.when(F.count("ret").over(w) >= int(window * 0.8), F.pow(1 + daily, 252.0) - 1)
    return rows.select("code", "date", daily.alias("daily"), alpha.alias("alpha")).filter("alpha IS NOT NULL")


