"""A subset of the 191 published short-horizon price and volume factors, by number."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.fields import close, high, low, open_, position, ret, spread, true_range, volume, vwap
from ..operators.cross import rank
from ..operators.series import (
    absolute, correlation, count_true, covariance, decay_linear, delay, delta, largest, log, only, present, regression_slope, sign, sma, smallest, ts_argmax, ts_argmin, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum, where,
)
from ..plans.expression import Expression
from .registry import register

before = delay(close, 1)
change = close - before
typical = vwap
middle = (high + low) / 2


def up(x):
    return largest(x, 0.0)


def ratio(n):
    return (close - delay(close, n)) / delay(close, n)


def signed_volume():
    """The volume with the sign of the day's change."""
    return sign(change) * volume


def stochastic(n):
    """How far the close stands below the highest high, in percent of the range."""
    top = ts_max(high, n)
    return (top - close) / (top - ts_min(low, n)) * 100


def raw_k(n):
    bottom = ts_min(low, n)
    return (close - bottom) / (ts_max(high, n) - bottom)


def strength(x, n):
    """Smoothed gains against all smoothed changes, in percent."""
    return sma(up(x), n, 1) / sma(absolute(x), n, 1) * 100


def distance(n):
    m = ts_mean(close, n)
    return (close - m) / m * 100


def daily_move():
    gap = middle - (delay(high, 1) + delay(low, 1)) / 2
    return gap * spread / volume


def opened(more: bool):
    was = delay(open_, 1)
    side, move = (open_ > was, largest(high - open_, open_ - was)) if more else (open_ < was, largest(open_ - low, open_ - was))
    return only(present(open_) & present(was), where(side, move, 0.0))


def gtja_059():
    base = where(close > before, smallest(low, before), largest(high, before))
    return ts_sum(only(present(close) & present(before), where(close > before, close - base, where(close < before, close - base, 0.0))), 20)


def gtja_128():
    flow, was = typical * volume, delay(typical, 1)
    rose, fell = ts_sum(where(typical > was, flow, 0.0), 14), ts_sum(where(typical < was, flow, 0.0), 14)
    return 100 - 100 / (1 + rose / fell)


def gtja_112():
    rose, fell = ts_sum(up(change), 12), ts_sum(up(-change), 12)
    return (rose - fell) / (rose + fell) * 100


def gtja_173():
    first, logs = sma(close, 13, 2), sma(log(close), 13, 2)
    return 3 * first - 2 * sma(first, 13, 2) + sma(sma(logs, 13, 2), 13, 2)


def macd(x, times):
    dif = sma(x, 13, 2) - sma(x, 27, 2)
    return times * (dif - sma(dif, 10, 2))


def balance(x, y, n):
    return ts_sum(up(x), n) / ts_sum(up(y), n) * 100


def smoothed_twice():
    once = sma(spread, 10, 2)
    return once / sma(once, 10, 2)


FORMULAS: dict[str, tuple[str, Callable[[], Expression]]] = {
    "001": ("cross_sectional volume", lambda: -correlation(rank(delta(log(volume), 1)), rank((close - open_) / open_), 6)),
    "002": ("time_series reversal", lambda: -delta(position(), 1)),
    "005": ("cross_sectional volume", lambda: -ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)),
    "006": ("cross_sectional momentum", lambda: -rank(sign(delta(open_ * 0.85 + high * 0.15, 4)))),
    "007": ("cross_sectional volume", lambda: (rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))),
    "008": ("cross_sectional reversal", lambda: rank(-delta(middle * 0.2 + vwap * 0.8, 4))),
    "009": ("time_series volume", lambda: sma(daily_move(), 7, 2)),
    "011": ("time_series volume", lambda: ts_sum(position() * volume, 6)),
    "012": ("cross_sectional reversal", lambda: rank(open_ - ts_sum(vwap, 10) / 10) * -rank(absolute(close - vwap))),
    "013": ("time_series", lambda: (high * low) ** 0.5 - vwap),
    "014": ("time_series momentum", lambda: close - delay(close, 5)),
    "015": ("time_series reversal", lambda: open_ / before - 1),
    "016": ("cross_sectional volume", lambda: -ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5)),
    "018": ("time_series momentum", lambda: close / delay(close, 5)),
    "020": ("time_series momentum", lambda: ratio(6) * 100),
    "024": ("time_series momentum", lambda: sma(close - delay(close, 5), 5, 1)),
    "025": ("cross_sectional volume", lambda: -rank(delta(close, 7) * (1 - rank(decay_linear(volume / ts_mean(volume, 20), 9)))) * (1 + rank(ts_sum(ret, 250)))),
    "026": ("time_series", lambda: ts_sum(close, 7) / 7 - close + correlation(vwap, delay(close, 5), 230)),
    "029": ("time_series volume", lambda: ratio(6) * volume),
    "031": ("time_series reversal", lambda: distance(12)),
    "032": ("cross_sectional volume", lambda: -ts_sum(rank(correlation(rank(high), rank(volume), 3)), 3)),
    "033": ("cross_sectional reversal", lambda: (-ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((ts_sum(ret, 240) - ts_sum(ret, 20)) / 220) * ts_rank(volume, 5)),
    "034": ("time_series reversal", lambda: ts_mean(close, 12) / close),
    "037": ("cross_sectional momentum", lambda: -rank(ts_sum(open_, 5) * ts_sum(ret, 5) - delay(ts_sum(open_, 5) * ts_sum(ret, 5), 10))),
    "040": ("time_series volume", lambda: ts_sum(where(close > before, volume, 0.0), 26) / ts_sum(where(close <= before, volume, 0.0), 26) * 100),
    "041": ("cross_sectional reversal", lambda: -rank(ts_max(delta(vwap, 3), 5))),
    "042": ("cross_sectional volume", lambda: -rank(ts_std(high, 10)) * correlation(high, volume, 10)),
    "043": ("time_series volume", lambda: ts_sum(signed_volume(), 6)),
    "045": ("cross_sectional volume", lambda: rank(delta(close * 0.6 + open_ * 0.4, 1)) * rank(correlation(vwap, ts_mean(volume, 150), 15))),
    "046": ("time_series reversal", lambda: (ts_mean(close, 3) + ts_mean(close, 6) + ts_mean(close, 12) + ts_mean(close, 24)) / (4 * close)),
    "047": ("time_series reversal", lambda: sma(stochastic(6), 9, 1)),
    "048": ("cross_sectional volume", lambda: -rank(sign(change) + sign(before - delay(close, 2)) + sign(delay(close, 2) - delay(close, 3))) * (ts_sum(volume, 5) / ts_sum(volume, 20))),
    "052": ("time_series momentum", lambda: balance(high - delay(typical, 1), delay(typical, 1) - low, 26)),
    "053": ("time_series momentum", lambda: count_true(close > before, 12) / 12 * 100),
    "057": ("time_series reversal", lambda: sma(raw_k(9) * 100, 3, 1)),
    "058": ("time_series momentum", lambda: count_true(close > before, 20) / 20 * 100),
    "059": ("time_series momentum", gtja_059),
    "060": ("time_series volume", lambda: ts_sum(position() * volume, 20)),
    "063": ("time_series momentum", lambda: strength(change, 6)),
    "065": ("time_series reversal", lambda: ts_mean(close, 6) / close),
    "066": ("time_series reversal", lambda: distance(6)),
    "067": ("time_series momentum", lambda: strength(change, 24)),
    "068": ("time_series volume", lambda: sma(daily_move(), 15, 2)),
    "071": ("time_series reversal", lambda: distance(24)),
    "072": ("time_series reversal", lambda: sma(stochastic(6), 15, 1)),
    "076": ("time_series volume", lambda: ts_std(absolute(ret) / volume, 20) / ts_mean(absolute(ret) / volume, 20)),
    "078": ("time_series reversal", lambda: (typical - ts_mean(typical, 12)) / (0.015 * ts_mean(absolute(close - ts_mean(typical, 12)), 12))),
    "079": ("time_series momentum", lambda: strength(change, 12)),
    "080": ("time_series volume", lambda: (volume - delay(volume, 5)) / delay(volume, 5) * 100),
    "081": ("time_series volume", lambda: sma(volume, 21, 2)),
    "082": ("time_series reversal", lambda: sma(stochastic(6), 20, 1)),
    "083": ("cross_sectional volume", lambda: -rank(covariance(rank(high), rank(volume), 5))),
    "084": ("time_series volume", lambda: ts_sum(signed_volume(), 20)),
    "085": ("time_series volume", lambda: ts_rank(volume / ts_mean(volume, 20), 20) * ts_rank(-delta(close, 7), 8)),
    "088": ("time_series momentum", lambda: ratio(20) * 100),
    "089": ("time_series momentum", lambda: macd(close, 2)),
    "090": ("cross_sectional volume", lambda: -rank(correlation(rank(vwap), rank(volume), 5))),
    "091": ("cross_sectional volume", lambda: -(rank(close - ts_max(close, 5)) * rank(correlation(ts_mean(volume, 40), low, 5)))),
    "093": ("time_series momentum", lambda: ts_sum(opened(False), 20)),
    "094": ("time_series volume", lambda: ts_sum(signed_volume(), 30)),
    "096": ("time_series reversal", lambda: sma(sma(raw_k(9) * 100, 3, 1), 3, 1)),
    "097": ("time_series volume", lambda: ts_std(volume, 10)),
    "099": ("cross_sectional volume", lambda: -rank(covariance(rank(close), rank(volume), 5))),
    "100": ("time_series volume", lambda: ts_std(volume, 20)),
    "102": ("time_series volume", lambda: strength(delta(volume, 1), 6)),
    "103": ("time_series reversal", lambda: (20 - ts_argmin(low, 20)) / 20 * 100),
    "104": ("cross_sectional volume", lambda: -(delta(correlation(high, volume, 5), 5) * rank(ts_std(close, 20)))),
    "105": ("cross_sectional volume", lambda: -correlation(rank(open_), rank(volume), 10)),
    "106": ("time_series momentum", lambda: close - delay(close, 20)),
    "107": ("cross_sectional reversal", lambda: -rank(open_ - delay(high, 1)) * rank(open_ - before) * rank(open_ - delay(low, 1))),
    "109": ("time_series", smoothed_twice),
    "110": ("time_series momentum", lambda: balance(high - before, before - low, 20)),
    "111": ("time_series volume", lambda: sma(volume * position(), 11, 2) - sma(volume * position(), 4, 2)),
    "112": ("time_series momentum", gtja_112),
    "116": ("time_series momentum", lambda: regression_slope(close, 20)),
    "118": ("time_series", lambda: ts_sum(high - open_, 20) / ts_sum(open_ - low, 20) * 100),
    "120": ("cross_sectional", lambda: rank(vwap - close) / rank(vwap + close)),
    "126": ("time_series", lambda: (close + high + low) / 3),
    "128": ("time_series volume", gtja_128),
    "129": ("time_series reversal", lambda: ts_sum(up(-change), 12)),
    "133": ("time_series reversal", lambda: (20 - ts_argmax(high, 20)) / 20 * 100 - (20 - ts_argmin(low, 20)) / 20 * 100),
    "134": ("time_series volume", lambda: ratio(12) * volume),
    "135": ("time_series momentum", lambda: sma(delay(close / delay(close, 20), 1), 20, 1)),
    "136": ("cross_sectional volume", lambda: -rank(delta(ret, 3)) * correlation(open_, volume, 10)),
    "139": ("cross_sectional volume", lambda: -correlation(open_, volume, 10)),
    "141": ("cross_sectional volume", lambda: -rank(correlation(rank(high), rank(ts_mean(volume, 15)), 9))),
    "142": ("cross_sectional volume", lambda: -rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / ts_mean(volume, 20), 5))),
    "145": ("time_series volume", lambda: (ts_mean(volume, 9) - ts_mean(volume, 26)) / ts_mean(volume, 12) * 100),
    "147": ("time_series momentum", lambda: regression_slope(ts_mean(close, 12), 12)),
    "150": ("time_series volume", lambda: typical * volume),
    "151": ("time_series momentum", lambda: sma(close - delay(close, 20), 20, 1)),
    "153": ("time_series reversal", lambda: (ts_mean(close, 3) + ts_mean(close, 6) + ts_mean(close, 12) + ts_mean(close, 24)) / 4),
    "155": ("time_series volume", lambda: macd(volume, 1)),
    "158": ("time_series", lambda: (high - sma(close, 15, 2) - (low - sma(close, 15, 2))) / close),
    "161": ("time_series", lambda: ts_mean(true_range(), 12)),
    "167": ("time_series momentum", lambda: ts_sum(up(change), 12)),
    "168": ("time_series volume", lambda: -(volume / ts_mean(volume, 20))),
    "171": ("time_series", lambda: -((low - close) * open_**5) / ((close - high) * close**5)),
    "173": ("time_series momentum", gtja_173),
    "175": ("time_series", lambda: ts_mean(true_range(), 6)),
    "176": ("cross_sectional volume", lambda: correlation(rank(raw_k(12)), rank(volume), 6)),
    "177": ("time_series reversal", lambda: (20 - ts_argmax(high, 20)) / 20 * 100),
    "178": ("time_series volume", lambda: ratio(1) * volume),
    "179": ("cross_sectional volume", lambda: rank(correlation(vwap, volume, 4)) * rank(correlation(rank(low), rank(ts_mean(volume, 50)), 12))),
    "180": ("time_series volume", lambda: where(ts_mean(volume, 20) < volume, -ts_rank(absolute(delta(close, 7)), 60) * sign(delta(close, 7)), -volume)),
    "184": ("cross_sectional reversal", lambda: rank(correlation(delay(open_ - close, 1), close, 200)) + rank(open_ - close)),
    "185": ("cross_sectional reversal", lambda: rank(-((1 - open_ / close) ** 2))),
    "187": ("time_series momentum", lambda: ts_sum(opened(True), 20)),
    "188": ("time_series", lambda: (spread - sma(spread, 11, 2)) / sma(spread, 11, 2) * 100),
    "189": ("time_series", lambda: ts_mean(absolute(close - ts_mean(close, 6)), 6)),
    "191": ("cross_sectional volume", lambda: correlation(ts_mean(volume, 20), low, 5) + middle - close),
}

for _number, (_kinds, _build) in FORMULAS.items():
    register(f"gtja_{_number}", _kinds, "gtja191")(_build)

