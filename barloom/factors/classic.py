"""Technical, statistical, volume, range and breadth factors."""

from __future__ import annotations

import math

from ..functions.fields import close, high, low, open_, ret, spread, true_range, volume, vwap
from ..operators.cross import day_mean, day_share, day_skew, day_std, industry_strength, rank, scale
from ..operators.series import (
    absolute, at_least, at_most, correlation, decay_linear, delay, ema, ewm, ewm_half, ewm_half_std, filled, flag, log, mean, nonzero, only, pct_change, present, rolling, rolling_kurt, rolling_skew, sign, sqrt, ts_max, ts_min,
)
from ..plans.expression import element
from .registry import register

TIME, ACROSS = "time_series", "cross_sectional"


def std0(x, n):
    return rolling("stddev_pop", x, n)


def std1(x, n):
    return rolling("stddev_samp", x, n)


def traded():
    return log(nonzero(volume))


def zscore(x, n):
    return (x - mean(x, n)) / std0(x, n)


@register("momentum", f"momentum {TIME}", "technical")
def momentum(n=20):
    return pct_change(close, n)


@register("macd_hist", f"momentum {TIME}", "technical")
def macd_hist(fast=12, slow=26, signal=9):
    dif = ema(close, fast) - ema(close, slow)
    return 2 * (dif - ema(dif, signal))


@register("macd_dif_norm", f"momentum {TIME}", "technical")
def macd_dif_norm(fast=12, slow=26, signal=9):
    return (ema(close, fast) - ema(close, slow)) / close


@register("rsi_centered", f"reversal {TIME}", "technical")
def rsi_centered(n=14):
    """Without any loss the strength counts as 0."""
    change = close - delay(close, 1)
    gain, loss = ewm(at_least(change, 0.0), 1 / n), ewm(at_least(-change, 0.0), 1 / n)
    strength = filled(gain / loss, 0.0)
    return only(present(gain), 50 - 100 / (1 + strength))


@register("kdj_j", f"reversal {TIME}", "technical")
def kdj_j(n=9, m1=3, m2=3):
    bottom = ts_min(low, n)
    k = ewm(filled((close - bottom) / (ts_max(high, n) - bottom) * 100, 50.0), 1 / m1)
    return only(present(ts_min(filled(low, 0.0), n)), 3 * k - 2 * ewm(k, 1 / m2) - 50)


@register("ma_distance", f"reversal {TIME}", "technical")
def ma_distance(n=20):
    return (close - mean(close, n)) / mean(close, n)


@register("ma_slope", f"momentum {TIME}", "technical")
def ma_slope(n=20, k=5):
    before = delay(mean(close, n), k)
    return (mean(close, n) - before) / before


@register("vol_ratio", f"volume {TIME}", "technical")
def vol_ratio(n=5):
    return volume / delay(mean(volume, n), 1) - 1


@register("boll_position", f"reversal {TIME}", "technical")
def boll_position(n=20, k=2):
    return (close - mean(close, n)) / (float(k) * std0(close, n))


@register("hl_range", f"volatility {TIME}", "technical")
def hl_range(n=20):
    return (ts_max(high, n) - ts_min(low, n)) / close


@register("close_std", f"volatility {TIME}", "statistics")
def close_std(n=20):
    return std1(close, n) / close


@register("close_skew", f"volatility {TIME}", "statistics")
def close_skew(n=20):
    return rolling_skew(close, n)


@register("close_kurt", f"volatility {TIME}", "statistics")
def close_kurt(n=20):
    return rolling_kurt(close, n)


@register("volume_skew", f"volume {TIME}", "statistics")
def volume_skew(n=20):
    return rolling_skew(volume, n)


@register("volume_kurt", f"volume {TIME}", "statistics")
def volume_kurt(n=20):
    return rolling_kurt(volume, n)


@register("range_std", f"volatility {TIME}", "statistics")
def range_std(n=20):
    return std1(spread, n) / close


@register("volume_std", f"volume {TIME}", "statistics")
def volume_std(n=20):
    return std1(volume, n) / mean(volume, n)


@register("ewma_momentum", f"momentum {TIME}", "ewma")
def ewma_momentum(h=10):
    level = ewm_half(close, h)
    return (close - level) / level


@register("ewma_vol", f"volatility {TIME}", "ewma")
def ewma_vol(h=10):
    return ewm_half_std(ret, h)


@register("ewma_turnover_z", f"volume {TIME}", "ewma")
def ewma_turnover_z(h=10):
    return (traded() - ewm_half(traded(), h)) / ewm_half_std(traded(), h)


@register("ewma_close_dev", f"reversal {TIME}", "ewma")
def ewma_close_dev(h=10):
    return (close - ewm_half(close, h)) / ewm_half_std(close, h)


@register("ewma_volume_ratio", f"volume {TIME}", "ewma")
def ewma_volume_ratio(h=10):
    return volume / delay(ewm_half(volume, h), 1) - 1


@register("vwap_dev", f"reversal {TIME}", "vwap")
def vwap_dev(n=5):
    return mean((close - vwap) / vwap, n)


@register("vwap_weighted_mom", f"momentum volume {TIME}", "vwap")
def vwap_weighted_mom(n=5):
    return rolling("sum", (close - vwap) * volume, n) / rolling("sum", volume, n) / vwap


@register("vwap_above_ratio", f"momentum {TIME}", "vwap")
def vwap_above_ratio(n=5):
    return mean(flag(close > vwap), n)


@register("vwap_dev_std", f"volatility {TIME}", "vwap")
def vwap_dev_std(n=20):
    return std0((close - vwap) / vwap, n)


def _within():
    return (close - low) / spread


@register("close_pos", f"reversal {TIME}", "position")
def close_pos(n=5):
    return mean(_within(), n)


@register("close_pos_cum", f"momentum {TIME}", "position")
def close_pos_cum(n=5):
    return rolling("sum", _within() - 0.5, n)


@register("close_pos_ema", f"momentum {TIME}", "position")
def close_pos_ema(n=5):
    return ema(_within(), n)


@register("turnover_z", f"volume {TIME}", "turnover")
def turnover_z(n=5):
    return zscore(traded(), n)


@register("amount_z", f"volume {TIME}", "turnover")
def amount_z(n=5):
    return zscore(log(nonzero(volume * close)), n)


@register("volume_ratio_short", f"volume {TIME}", "turnover")
def volume_ratio_short(n=5):
    return nonzero(volume) / delay(mean(nonzero(volume), n), 1) - 1


@register("mom_accel", f"momentum {TIME}", "acceleration")
def mom_accel(n=5):
    return pct_change(close, n) - delay(pct_change(close, n), n)


@register("vol_accel", f"volume {TIME}", "acceleration")
def vol_accel(n=5):
    return traded() - 2 * delay(traded(), n) + delay(traded(), 2 * n)


@register("turnover_accel", f"volume {TIME}", "acceleration")
def turnover_accel(n=5):
    return zscore(traded(), n) - delay(zscore(traded(), n), n)


@register("atr", f"volatility {TIME}", "range")
def atr(n=14):
    return ewm(true_range(), 1 / n)


@register("cci", f"reversal {TIME}", "range")
def cci(n=20):
    level = mean(vwap, n)
    return (vwap - level) / (0.015 * mean(absolute(vwap - level), n))


@register("amp", f"volatility {TIME}", "range")
def amp(n=5):
    return mean(spread / close, n)


@register("park_vol", f"volatility {TIME}", "range")
def park_vol(n=20):
    wide = log(high / low)
    return sqrt(mean(wide * wide / (4 * math.log(2)), n))


@register("gk_vol", f"volatility {TIME}", "range")
def gk_vol(n=20):
    wide, moved = log(high / low), log(close / open_)
    return sqrt(mean(0.5 * wide * wide - (2 * math.log(2) - 1) * moved * moved, n))


@register("rank_signed_mom", f"momentum {ACROSS}", "composite")
def rank_signed_mom(n=10):
    return rank(pct_change(close, n)) * sign(pct_change(volume, n))


@register("decay_corr_pv", f"volume {ACROSS}", "composite")
def decay_corr_pv(n=20):
    return decay_linear(correlation(rank(close), rank(volume), n), n)


@register("scale_decay_mom", f"momentum {ACROSS}", "composite")
def scale_decay_mom(n=10):
    return scale(decay_linear(pct_change(close, n), n))


@register("mom_vol_interact", f"momentum volume {TIME}", "composite")
def mom_vol_interact(n=10):
    return pct_change(close, n) * volume_ratio_short(n)


@register("corr_pv", f"volume {ACROSS}", "correlation")
def corr_pv(n=20):
    return correlation(rank(close), rank(volume), n)


@register("corr_high_low", f"volatility {TIME}", "correlation")
def corr_high_low(n=20):
    return correlation(high, low, n)


@register("corr_close_vwap", f"reversal {TIME}", "correlation")
def corr_close_vwap(n=20):
    return correlation(close, vwap, n)


@register("corr_mom_vol", f"volume {TIME}", "correlation")
def corr_mom_vol(n=20):
    return correlation(ret, pct_change(volume), n)


@register("corr_close_close_lag", f"momentum {TIME}", "correlation")
def corr_close_close_lag(n=20):
    return correlation(close, delay(close, 1), n)


@register("breadth_above_ma", f"market {ACROSS}", "breadth")
def breadth_above_ma(n=20):
    return day_share(close > mean(close, n))


@register("breadth_advance", f"market {ACROSS}", "breadth")
def breadth_advance():
    return day_share(ret > 0)


@register("breadth_limit_up", f"market {ACROSS}", "breadth")
def breadth_limit_up():
    return day_share(ret > 0.099)


@register("breadth_dispersion", f"market {ACROSS}", "breadth")
def breadth_dispersion():
    return day_std(ret)


@register("breadth_pos_skew", f"market {ACROSS}", "breadth")
def breadth_pos_skew():
    return day_skew(ret)


@register("industry_relative_strength", f"momentum {ACROSS}", "custom")
def industry_relative_strength(n=20):
    return industry_strength(pct_change(close, n))


@register("limit_up_count", f"momentum {TIME}", "custom")
def limit_up_count(n=20):
    """The first row of a code has no return, so the first window that counts begins with the second."""
    nth = element("row_number() OVER (PARTITION BY code ORDER BY date)")
    nth.kind = "t"
    return rolling("sum", only(nth > 1, flag(ret > 0.099)), n)


@register("turnover_zscore", f"volume {TIME}", "custom")
def turnover_zscore(n=60):
    return zscore(traded(), n)


def _with_market(n):
    market = day_mean(ret)
    pair = ret * market
    cov = mean(pair, n) - mean(ret, n) * mean(market, n)
    return cov, mean(market * market, n) - mean(market, n) * mean(market, n)


@register("beta", f"market {TIME}", "market")
def beta(n=60):
    cov, var = _with_market(n)
    return cov / var


@register("ivol", f"volatility {TIME}", "market")
def ivol(n=60):
    cov, var = _with_market(n)
    own = mean(ret * ret, n) - mean(ret, n) * mean(ret, n)
    return sqrt(at_least(own - cov * cov / var, 0.0))


@register("amihud", f"liquidity {TIME}", "liquidity")
def amihud(n=20):
    """Per hundred million of turnover."""
    return mean(absolute(ret) / nonzero(volume * close), n) * 1e8


@register("max_ret", f"reversal {TIME}", "extreme")
def max_ret(n=20):
    return ts_max(ret, n)


@register("min_ret", f"reversal {TIME}", "extreme")
def min_ret(n=20):
    return ts_min(ret, n)


@register("ret_skew", f"volatility {TIME}", "moments")
def ret_skew(n=20):
    return rolling_skew(ret, n)


@register("ret_kurt", f"volatility {TIME}", "moments")
def ret_kurt(n=20):
    return rolling_kurt(ret, n)


@register("downside_vol", f"volatility {TIME}", "moments")
def downside_vol(n=20):
    below = at_most(ret, 0.0)
    return sqrt(mean(below * below, n))


@register("long_term_reversal", f"reversal {TIME}", "long")
def long_term_reversal(n=240, skip=21):
    return delay(close, skip) / delay(close, n) - 1


@register("high_proximity", f"momentum {TIME}", "long")
def high_proximity(n=240):
    return close / ts_max(high, n)
