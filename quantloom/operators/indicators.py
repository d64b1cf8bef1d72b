"""Technical indicators. All window forms share one partitioning by code; the recursive ones run per code in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import change, deviation, full, history, lag, last_rows, mean


def moving(bars: DataFrame) -> DataFrame:
    """Averages, Bollinger bands, volume ratio, rate of change, true range and its average; full windows only."""
    spread = [F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close"))]
    out = bars.withColumns({f"sma_{n}": mean("close", n) for n in (5, 20, 60)} | {"sd_20": deviation("close", 20), "vol_5": mean("volume", 5), "vol_20": mean("volume", 20), "roc_12": change("close", 12) * 100, "tr": F.greatest(*spread)})
    out = out.withColumns({"bb_upper": F.col("sma_20") + 2 * F.col("sd_20"), "bb_lower": F.col("sma_20") - 2 * F.col("sd_20"), "vol_ratio": F.try_divide("volume", "vol_5"), "atr_14": mean("tr", 14)})
    return out.withColumns({"bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "sma_20"), "bb_pct": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "atr_pct": F.try_divide("atr_14", "close")}).drop("sd_20")


def squeeze(bars: DataFrame, window: int = 120, least: int = 30, quantile: float = 0.1) -> DataFrame:
    """Band width at or below its own rolling quantile while inside the Keltner channel, and the release from it."""
    out = moving(bars).withColumns({"kc_upper": F.col("sma_20") + 1.5 * mean("tr", 20), "kc_lower": F.col("sma_20") - 1.5 * mean("tr", 20)})
    low = F.when(F.count("bb_width").over(last_rows(window)) >= least, F.percentile("bb_width", F.lit(quantile)).over(last_rows(window)))
    inside = (F.col("bb_upper") < F.col("kc_upper")) & (F.col("bb_lower") > F.col("kc_lower"))
    out = out.withColumn("squeeze", F.coalesce((F.col("bb_width") <= low) & inside, F.lit(False)))
    return out.withColumn("release", F.coalesce(F.lag("squeeze").over(history()), F.lit(False)) & ~F.col("squeeze"))


def volume_patterns(bars: DataFrame) -> DataFrame:
    """Breakouts on volume, quiet pullbacks from the 10-bar high, and pullbacks within 10 bars of a breakout."""
    w = history()
    out = bars.withColumns({"ret": change("close"), "vol_5": F.when(F.count("volume").over(last_rows(5)) >= 3, F.avg("volume").over(last_rows(5))), "high_10": F.max("high").over(last_rows(10)), "at": F.row_number().over(w)})
    body = F.coalesce(F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")), F.lit(0.0))
    out = out.withColumn("breakout", F.coalesce((F.col("volume") >= 2 * F.col("vol_5")) & (F.col("ret") >= 0.015) & (body >= 0.5), F.lit(False)))
    dip = F.try_divide("close", "high_10") - 1
    out = out.withColumn("pullback", F.coalesce((F.col("volume") <= 0.6 * F.col("vol_5")) & (dip >= -0.03) & (dip < 0), F.lit(False)))
    last = F.last(F.when(F.col("breakout"), F.col("at")), ignorenulls=True).over(w.rowsBetween(-10, -1))
    return out.withColumn("sequence", F.col("pullback") & last.isNotNull()).drop("at")


_ADDED = "rsi double, macd double, macd_signal double, macd_hist double, k double, d double, plus_di double, minus_di double, adx double, atr double, rsi_span double, rsi_alpha double, atr_ewm double"


def _from(start: float, x: pd.Series, alpha: float) -> pd.Series:
    """y = (1 - alpha) * y before + alpha * x, from `start` before the first x that is known."""
    known = x.dropna()
    return pd.concat([pd.Series([start]), known]).ewm(alpha=alpha, adjust=False).mean().iloc[1:].reindex(x.index)


def _added(frame: pd.DataFrame) -> dict[str, pd.Series]:
    close, high, low = frame["close"], frame["high"], frame["low"]
    step, slow = close.diff(), {"alpha": 1 / 14, "min_periods": 14}
    gain, loss = step.clip(lower=0), -step.clip(upper=0)
    smooth = lambda x: x.fillna(0.0).ewm(adjust=True, **slow).mean()
    floor = lambda x: x.where(x != 0, 1e-10)
    ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
    strength = lambda up, down: up / down.where(down != 0)
    macd = ema(close, 12) - ema(close, 26)
    top, bottom = high.rolling(9).max(), low.rolling(9).min()
    k = _from(50.0, (close - bottom) / floor(top - bottom) * 100, 1 / 3)
    up, down, before = high.diff(), -low.diff(), close.shift()
    true_range = np.fmax(np.fmax(high - low, (high - before).abs()), (low - before).abs())
    width = floor(smooth(true_range))
    plus, minus = (100 * smooth(x.where((x > y) & (x > 0), 0.0)) / width for x, y in ((up, down), (down, up)))
    dx = 100 * (plus - minus).abs() / floor(plus + minus)
    return {
        "rsi": 100 - 100 / (1 + smooth(gain) / floor(smooth(loss))),
        "macd": macd,
        "macd_signal": ema(macd, 9),
        "macd_hist": macd - ema(macd, 9),
        "k": k,
        "d": _from(50.0, k, 1 / 3),
        "plus_di": plus,
        "minus_di": minus,
        "adx": dx.ewm(adjust=True, **slow).mean(),
        "atr": ema(true_range, 14),
        "rsi_span": 1 - 1 / (1 + strength(ema(gain, 14), ema(loss, 14))),
        "rsi_alpha": 1 - 1 / (1 + strength(*(x.ewm(adjust=False, **slow).mean() for x in (gain, loss)))),
        "atr_ewm": ema(close.pct_change(fill_method=None).abs(), 14),
    }


class _Codes:
    """Bars of whole codes, one after another, and exponential means along all of them at once: one step a bar number, over every code that has it."""

    def __init__(self, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        place = np.empty(len(lengths), np.int64)
        place[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        self.i = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        # By bar number, longer codes first: those that go on are always the first of the step before.
        self.order = np.argsort(self.i * len(lengths) + np.repeat(place, lengths), kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.i))])

    def ewm(self, values: list[np.ndarray], alphas: list[float], adjust: bool = False, first: int = 0, start: float | None = None, least: int = 0) -> np.ndarray:
        """pandas' ewm().mean() of each of `values` from a code's bar number `first` on (before: NaN), or from `start` before it; NaN for fewer than `least` values."""
        x = np.stack(values)[:, self.order]
        y = np.full_like(x, np.nan)
        decay = np.array([[1 - 1 / (1 + (1 - a) / a)] for a in alphas])
        share = 1.0 if adjust else 1 - decay
        weight = np.ones_like(decay)
        if start is not None:
            state = np.full((len(values), self.ends[1]), start)
        for t in range(first, len(self.ends) - 1):
            now = x[:, self.ends[t] : self.ends[t + 1]]
            if t == first and start is None:
                state = now
            else:
                state, weight = state[:, : now.shape[1]], weight * decay
                state = np.where(state != now, (weight * state + share * now) / (weight + share), state)
                weight = weight + share if adjust else np.ones_like(decay)
            if t - first + 1 >= least:
                y[:, self.ends[t] : self.ends[t + 1]] = state
        out = np.empty_like(y)
        out[:, self.order] = y
        return out

    def before(self, x: np.ndarray) -> np.ndarray:
        """The bar before; NaN on a code's first."""
        return np.where(self.i > 0, np.concatenate([[np.nan], x[:-1]]), np.nan)

    def rolling(self, x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
        out = x.copy()
        for k in range(1, n):
            out[k:] = of(out[k:], x[:-k])
        return np.where(self.i >= n - 1, out, np.nan)


def _added_to_all(close: np.ndarray, high: np.ndarray, low: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """What _added() gives, for many codes at once whose values are all finite and whose closes are not 0."""
    codes, slow = _Codes(lengths), 1 / 14
    span = lambda n: 2 / (n + 1)
    floor = lambda x: np.where(x != 0, x, 1e-10)
    strength = lambda up, down: up / np.where(down != 0, down, np.nan)
    known = lambda x: np.where(codes.i > 0, x, 0.0)
    before = codes.before(close)
    step = close - before
    gain, loss = np.where(step < 0, 0.0, step), -np.where(step > 0, 0.0, step)
    up, down = high - codes.before(high), -(low - codes.before(low))
    true_range = np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))
    fast, long, atr = codes.ewm([close, close, true_range], [span(12), span(26), span(14)])
    gain_span, loss_span, moves = codes.ewm([gain, loss, np.abs(close / before - 1)], [span(14)] * 3, first=1)
    gain_alpha, loss_alpha = codes.ewm([gain, loss], [slow] * 2, first=1, least=14)
    directed = (np.where((x > y) & (x > 0), x, 0.0) for x, y in ((up, down), (down, up)))
    gains, losses, width, plus, minus = codes.ewm([known(gain), known(loss), true_range, *directed], [slow] * 5, adjust=True, least=14)
    macd = fast - long
    (signal,) = codes.ewm([macd], [span(9)])
    top, bottom = codes.rolling(high, 9, np.maximum), codes.rolling(low, 9, np.minimum)
    (k,) = codes.ewm([(close - bottom) / floor(top - bottom) * 100], [1 / 3], first=8, start=50.0)
    (d,) = codes.ewm([k], [1 / 3], first=8, start=50.0)
    plus, minus = 100 * plus / floor(width), 100 * minus / floor(width)
    (adx,) = codes.ewm([100 * np.abs(plus - minus) / floor(plus + minus)], [slow], adjust=True, first=13, least=14)
    return {
        "rsi": 100 - 100 / (1 + gains / floor(losses)), "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "k": k, "d": d, "plus_di": plus, "minus_di": minus, "adx": adx, "atr": atr,
        "rsi_span": 1 - 1 / (1 + strength(gain_span, loss_span)), "rsi_alpha": 1 - 1 / (1 + strength(gain_alpha, loss_alpha)), "atr_ewm": moves,
    }


#: Bars of whole codes that are computed at once.
ROWS = 1 << 17


def _whole_codes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches in order of codes, put together to tables of at least so many rows, or what is left, that hold whole codes (_i counts a code's rows from 1)."""
    kept, n, limit = [], 0, rows
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(kept)
        last = int(np.flatnonzero(table["_i"].to_numpy() == 1)[-1])  # a code that may go on
        if last:
            yield table.slice(0, last)
        kept, n = table.slice(last).to_batches(), n - last
        limit = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(kept)


def _rolling_share(x: np.ndarray, i: np.ndarray, window: int, share: float) -> np.ndarray:
    """The interpolated quantile, as percentile() gives it, of each row's last `window` values; NaN unless the code has so many by then (`i` counts its rows from 1), all known."""
    out = np.full(len(x), np.nan)
    at = share * (window - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    ends = np.flatnonzero(i >= window)
    for some in np.array_split(ends, len(ends) // (1 << 14) + 1):
        values = np.partition(x[some[:, None] + np.arange(1 - window, 1)], (low, high), axis=1)
        a, b = values[:, low], values[:, high]
        found = np.where(a == b, a, (high - at) * a + (at - low) * b)
        out[some] = np.where(np.isnan(values).any(axis=1), np.nan, found)
    return out


#: Values and where they are null.
_Series = tuple[np.ndarray, np.ndarray]


def _of(f: Callable[..., np.ndarray], *series: _Series) -> _Series:
    """f of the values, null where any of them is."""
    return f(*(x for x, _ in series)), np.logical_or.reduce([null for _, null in series])


def _ratio(a: _Series, b: _Series) -> _Series:
    """As try_divide(): null where the divisor is zero."""
    x, null = _of(np.divide, a, b)
    return x, null | (b[0] == 0)


class _Bars:
    """Columns of whole codes, one after another, each worked out when it is first asked for: those of `table` (_i counts a code's rows), of `more` (NaN: null), of moving(), uptrend_days and, as x_before, those of the bar before."""

    def __init__(self, table: pa.Table, more: dict[str, np.ndarray]):
        self.table, self.i = table, table["_i"].to_numpy()
        self.found: dict[str, _Series] = {c: (x, np.isnan(x)) for c, x in more.items()}

    def __getitem__(self, name: str) -> _Series:
        if name not in self.found:
            if name in self.table.column_names:
                column = self.table[name].cast(pa.float64())
                found = column.to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            elif name in _WINDOWS:
                found = _WINDOWS[name](self)
            else:
                found = self.lag(name.removesuffix("_before"))
            self.found[name] = found
        return self.found[name]

    def lag(self, name: str, n: int = 1) -> _Series:
        x, null = self[name]
        n = min(n, len(x))
        return np.concatenate([x[:n], x[: len(x) - n]]), np.concatenate([null[:n], null[: len(x) - n]]) | (self.i <= n)

    def _full(self, null: np.ndarray, n: int) -> np.ndarray:
        """Where the last n rows of the code are not all known."""
        known = np.concatenate([np.zeros(n, np.int64), np.cumsum(~null)])
        return (self.i < n) | (known[n:] - known[:-n] < n)

    def _shifts(self, x: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """For the rows from number n - 1 on the oldest value of their window, then the next one, up to their own: each row adds up its window in the order in which Spark does."""
        for k in range(max(len(x) - n + 1, 0) and n):
            yield x[k : len(x) - n + 1 + k]

    def mean(self, name: str, n: int) -> _Series:
        x, null = self[name]
        out = np.zeros(len(x))
        for value in self._shifts(x, n):
            out[n - 1 :] += value
        return out / n, self._full(null, n)

    def deviation(self, name: str, n: int) -> _Series:
        x, null = self[name]
        average, squares = np.zeros((2, len(x)))
        for k, value in enumerate(self._shifts(x, n), 1):
            delta = value - average[n - 1 :]
            part = delta / k
            average[n - 1 :] += part
            squares[n - 1 :] += delta * (delta - part)
        return np.sqrt(squares / (n - 1)), self._full(null, n)

    def true_range(self) -> _Series:
        high, low, before = self["high"], self["low"], self["close_before"]
        parts = [_of(np.subtract, high, low), *(_of(lambda x, y: np.abs(x - y), x, before) for x in (high, low))]
        return np.maximum.reduce([np.where(null, -np.inf, x) for x, null in parts]), np.logical_and.reduce([null for _, null in parts])

    def uptrend_days(self) -> _Series:
        up, unknown = _of(lambda x, y: (x > y) | (np.isnan(x) & ~np.isnan(y)), self["sma_20"], self["sma_60"])
        at = np.arange(len(up))
        stop = np.where(up & ~unknown, np.where(self.i == 1, at - 1, -1), at)
        return (at - np.maximum.accumulate(stop)).astype(np.int32), np.zeros(len(up), bool)


_WINDOWS: dict[str, Callable[[_Bars], _Series]] = {
    "sma_5": lambda b: b.mean("close", 5),
    "sma_20": lambda b: b.mean("close", 20),
    "sma_60": lambda b: b.mean("close", 60),
    "sd_20": lambda b: b.deviation("close", 20),
    "vol_5": lambda b: b.mean("volume", 5),
    "vol_20": lambda b: b.mean("volume", 20),
    "roc_12": lambda b: _of(lambda x: (x - 1) * 100, _ratio(b["close"], b.lag("close", 12))),
    "tr": lambda b: b.true_range(),
    "bb_upper": lambda b: _of(lambda x, sd: x + 2 * sd, b["sma_20"], b["sd_20"]),
    "bb_lower": lambda b: _of(lambda x, sd: x - 2 * sd, b["sma_20"], b["sd_20"]),
    "vol_ratio": lambda b: _ratio(b["volume"], b["vol_5"]),
    "atr_14": lambda b: b.mean("tr", 14),
    "bb_width": lambda b: _ratio(_of(np.subtract, b["bb_upper"], b["bb_lower"]), b["sma_20"]),
    "bb_pct": lambda b: _ratio(_of(np.subtract, b["close"], b["bb_lower"]), _of(np.subtract, b["bb_upper"], b["bb_lower"])),
    "atr_pct": lambda b: _ratio(b["atr_14"], b["close"]),
    "uptrend_days": lambda b: b.uptrend_days(),
}

#: The columns of moving() and those that recursive() adds.
MOVING = tuple(c for c in _WINDOWS if c not in ("sd_20", "uptrend_days"))
RECURSIVE = tuple(x.split()[0] for x in _ADDED.split(", "))


def _with_added(table: pa.Table, last: int | None = None, shares: dict[str, tuple[str, int, float]] | None = None, only: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """Bars of whole codes, in order (_i counts a code's), with the recursive columns; codes with gaps in their prices take the plain path."""
    first = table["_i"].to_numpy() == 1
    lengths = np.diff(np.append(np.flatnonzero(first), len(first)))
    close, high, low = (table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("close", "high", "low"))
    with np.errstate(all="ignore"):
        odd = np.add.reduceat(~np.isfinite(close) | ~np.isfinite(high) | ~np.isfinite(low) | (close == 0), np.flatnonzero(first), dtype=np.int64) > 0
        whole = ~np.repeat(odd, lengths)
        out = {c: np.full(len(close), np.nan) for c in (x.split()[0] for x in _ADDED.split(", "))}
        if whole.any():
            for c, x in _added_to_all(close[whole], high[whole], low[whole], lengths[~odd]).items():
                out[c][whole] = x
    for at, n in zip(np.flatnonzero(first)[odd].tolist(), lengths[odd].tolist(), strict=True):
        here = slice(at, at + n)
        for c, x in _added(pd.DataFrame({"close": close[here], "high": high[here], "low": low[here]})).items():
            out[c][here] = x.to_numpy(float)
    i = table["_i"].to_numpy()
    for name, (c, window, share) in (shares or {}).items():
        out[name] = _rolling_share(out[c], i, window, share)
    if only is None:
        series = {c: (x, np.isnan(x)) for c, x in out.items()}
    else:
        columns = _Bars(table, out)
        with np.errstate(all="ignore"):
            series = {c: columns[c] for c in (*only, *(shares or {}))}
    table = table.drop_columns("_i")
    if last is not None:
        kept = np.repeat(lengths, lengths) - i < last
        table, series = table.filter(pa.array(kept)), {c: (x[kept], null[kept]) for c, (x, null) in series.items()}
    for c, (x, null) in series.items():
        table = table.append_column(c, pa.array(x, mask=null))
    yield from table.to_batches(max_chunksize=10_000)


def recursive(bars: DataFrame, last: int | None = None, shares: dict[str, tuple[str, int, float]] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """`bars`, with all their columns, and RSI(14), MACD(12, 26, 9), KD(9), directional indexes(14), exponential ATR(14),
    RSI(14) as a share by span and by alpha, and the exponential mean of absolute returns.

    Each value hangs on the one before it, so a code's bars stay together, some thousands at most; many codes take each step at
    once. After windows by code, no further shuffle is needed. With `last`, only so many last bars of each code come back.
    `shares` names further columns: (one of the new columns, bars, share) for its exact quantile over full windows of so many bars.
    `only` names the new columns that come back. They may also be those of moving(), uptrend_days and, as x_before, the bar
    before's: these come with the same pass, to the last bit as windows give them, so none is added up again for each row.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_codes(batches, ROWS):
            yield from _with_added(table, last, shares, only)

    own = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes)
    new = _ADDED if only is None else ", ".join(f"`{c}` {'int' if c == 'uptrend_days' else 'double'}" for c in only)
    return bars.withColumn("_i", F.row_number().over(history())).mapInArrow(added, ", ".join([own, *filter(None, [new]), *(f"`{c}` double" for c in shares or {})]))


#: Values, rows times columns, of whole codes that are normalised at once.
VALUES = 1 << 20


def _moments(codes: _Codes, x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sum of squared deviations of the known values from each block's first row to each row: one step a row number, over every block and column."""
    x, known = x[:, codes.order], known[:, codes.order].astype(float)
    out = np.empty((3, *x.shape))
    n, m, s = np.zeros((3, len(x), codes.ends[1]))
    for t in range(len(codes.ends) - 1):
        here = slice(codes.ends[t], codes.ends[t + 1])
        now, some = x[:, here], known[:, here]
        width = now.shape[1]
        n = n[:, :width] + some
        delta = (now - m[:, :width]) * some
        part = delta / np.maximum(n, 1)
        m, s = m[:, :width] + part, s[:, :width] + delta * (delta - part)
        out[0, :, here], out[1, :, here], out[2, :, here] = n, m, s
    back = np.empty_like(out)
    back[:, :, codes.order] = out
    return back[0], back[1], back[2]


def _z_scores(x: np.ndarray, lengths: np.ndarray, window: int, least: int, clip: float) -> np.ndarray:
    """Rolling z-scores of rows of values (NaN where missing) of whole codes, one after another."""
    counts = -(-lengths // window)
    blocks = np.full(counts.sum(), window)
    blocks[np.cumsum(counts) - 1] = lengths - (counts - 1) * window
    codes = _Codes(blocks)
    known = ~np.isnan(x)
    x = np.where(known, x, 0.0)
    n2, m2, s2 = _moments(codes, x, known)
    # Reversed, a block's sums go from its last row to each of its rows.
    n1, m1, s1 = (v[:, ::-1] for v in _moments(_Codes(blocks[::-1]), x[:, ::-1], known[:, ::-1]))
    # The last row of a block has all of its window in the block, those of a code's first block have nothing before it.
    first = np.arange(x.shape[1]) - np.repeat(np.cumsum(lengths) - lengths, lengths) < window
    alone = first | (codes.i == window - 1)
    before = np.maximum(np.arange(x.shape[1]) - (window - 1), 0)
    n1, m1, s1 = (np.where(alone, 0.0, v[:, before]) for v in (n1, m1, s1))
    n = n1 + n2
    apart = m2 - m1
    average = m1 + apart * n2 / np.maximum(n, 1)
    squares = s1 + s2 + apart * apart * n1 * n2 / np.maximum(n, 1)
    deviation = np.sqrt(squares / np.maximum(n - 1, 1))
    some = known & (n >= max(least, 2)) & ~(deviation <= 1e-6 * np.abs(average))
    z = (x - average) / np.where(some, deviation, 1.0)
    return np.where(some, np.where(z < clip, np.maximum(z, -clip), clip), 0.0)


def normalised(bars: DataFrame, columns: list[str], window: int = 252, least: int = 60, clip: float = 5.0, prefix: str = "z_") -> DataFrame:
    """Rolling z-scores per code, clipped; 0 where a value is missing, the history too short, or flat (a deviation of no more than a millionth of the mean).

    Rows are cut into blocks of the window's length. A window is the end of one block and the beginning of the next; the
    means and variances of both are running sums and are merged, so a row costs the same whatever the window, and nothing is
    subtracted that has left it. A code's rows stay together; all blocks and columns of many codes take each step at once.
    `prefix` names the new columns; with none they replace the old ones.
    """
    own = [c for c in bars.columns if prefix or c not in columns]
    packed = bars.select(*own, F.array(*(F.col(c).cast("double") for c in columns)).alias("_v"))
    scores = normalised_arrays(packed, {"_v": columns}, columns, window, least, clip, prefix)
    return scores.select(*bars.columns, *(f"{prefix}{c}" for c in columns if prefix))


def normalised_arrays(
    rows: DataFrame, packed: dict[str, list[str]], columns: list[str], window: int = 252, least: int = 60, clip: float = 5.0, prefix: str = "", unless: str | None = None, hidden: tuple[str, ...] = (), only: str | None = None
) -> DataFrame:
    """normalised() of values that come as arrays of doubles, with the names of each array's elements; a missing array is one of missing values.

    `columns`, in this order, replace the arrays. Rows of many columns are slow to join, to sort and to project: code for all
    of them is too long to be compiled. Where the boolean column `unless` holds, those in `hidden` are null; it does not come back.
    With `only`, just the rows where that boolean column holds come back, without it. Rows that come from recursive() with their
    number as _i are whole codes in order already, and are not shuffled and sorted again.
    """
    own = [(c, t) for c, t in rows.dtypes if c not in packed and c not in (unless, only, "_i")]
    given = [c for names in packed.values() for c in names]
    order = [given.index(c) for c in columns]

    def unpacked(table: pa.Table, name: str) -> np.ndarray:
        arrays = table[name].combine_chunks()
        out = np.full((len(arrays), len(packed[name])), np.nan)
        out[arrays.is_valid().to_numpy(zero_copy_only=False)] = arrays.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(packed[name]))
        return out.T

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_codes(batches, max(VALUES // len(columns), 1)):
            first = np.flatnonzero(table["_i"].to_numpy() == 1)
            x = np.concatenate([unpacked(table, name) for name in packed])[order]
            with np.errstate(all="ignore"):
                z = _z_scores(np.where(np.isfinite(x), x, np.nan), np.diff(np.append(first, x.shape[1])), window, least, clip)
            out = table.select([c for c, _ in own])
            mask = table[unless].to_numpy() if unless else None
            if only:
                some = table[only].to_numpy()
                out, z, mask = out.filter(pa.array(some)), z[:, some], mask[some] if unless else None
            for c, values in zip(columns, z, strict=True):
                out = out.append_column(f"{prefix}{c}", pa.array(values, mask=mask if c in hidden else None))
            yield from out.to_batches(max_chunksize=10_000)

    schema = ", ".join([f"`{c}` {t}" for c, t in own] + [f"`{prefix}{c}` double" for c in columns])
    if only:
        rows = rows.withColumn(only, F.coalesce(only, F.lit(False)))
    return (rows if "_i" in rows.columns else rows.withColumn("_i", F.row_number().over(history()))).mapInArrow(scored, schema)


def rolling_rank(rows: DataFrame, column: str, window: int = 252, least: int = 60, name: str = "rank_pct") -> DataFrame:
    """`rows` (a row a code and date) with the rank of a column among its values of the last `window` rows, as a share, ties at their average.

    Null where the value is missing or fewer than `least` are known. No window is collected: rows are cut into blocks of the
    window's length, and each meets the rows of its own block and of the one before by equality; what it meets is counted
    at once, so a row costs at most two blocks of comparisons.
    """
    own = rows.select("code", "date", F.col(column).cast("double").alias("_x"), (F.row_number().over(history()) - 1).alias("_i")).withColumn("_b", F.floor(F.col("_i") / window))
    known = own.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    seen = known.select("code", F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"), F.col("_x").alias("_y"), F.col("_i").alias("_j"))
    inside = (F.col("_j") <= F.col("_i")) & (F.col("_j") > F.col("_i") - window)
    counted = known.join(seen, ["code", "_b"]).filter(inside).groupBy("code", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_y") < F.col("_x"), 1)).alias("_less"), F.count(F.when(F.col("_y") == F.col("_x"), 1)).alias("_same")
    )
    rank = F.when(F.col("_n") >= least, (F.col("_less") + (F.col("_same") + 1) / 2) / F.col("_n"))
    return rows.join(counted.select("code", "date", rank.alias(name)), ["code", "date"], "left")


def volatility_guard(bars: DataFrame, above: float = 0.9) -> DataFrame:
    """`bars` with rank_pct, where the mean absolute return of 20 bars stands in the last 252, and guarded: it stands above `above` while the close is below its 20-bar average (of 10 at least)."""
    rows = bars.withColumn("_move", F.abs(change("close"))).withColumn("_range", mean("_move", 20))
    w = last_rows(20)
    average = F.when(F.count("close").over(w) >= 10, F.avg("close").over(w))
    ranked = rolling_rank(rows.withColumn("_average", average), "_range")
    return ranked.withColumn("guarded", F.coalesce((F.col("rank_pct") > above) & (F.col("close") < F.col("_average")), F.lit(False))).drop("_move", "_range", "_average")


__all__ = ["moving", "squeeze", "volume_patterns", "recursive", "normalised", "rolling_rank", "volatility_guard", "full"]
