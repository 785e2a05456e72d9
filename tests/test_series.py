from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.factors import registry
from barloom.functions.fields import close, volume
from barloom.operators import cross, series
from barloom.plans.expression import column, evaluate

N = 40


@pytest.fixture(scope="module")
def wide():
    """Two codes with gaps, ties and a flat stretch; code b lists late."""
    rng = np.random.default_rng(1)
    a, b = np.round(rng.uniform(5, 15, N), 1), np.round(rng.uniform(5, 15, N), 1)
    a[7], b[:6], b[20] = np.nan, np.nan, np.nan
    a[25:33] = 9.0
    return pd.DataFrame({"a": a, "b": b})


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(days=t), None if np.isnan(x) else float(x), float(100 + t % 7)) for c in wide for t, x in enumerate(wide[c])]
    return spark.createDataFrame(rows, "code string, date date, close double, volume double")


def values(panel, expression) -> pd.DataFrame:
    found = evaluate(panel, {"value": expression}, rounded=False).toPandas()
    return found.pivot(index="date", columns="code", values="value").reset_index(drop=True).astype(float)


def last(x):
    return float((x <= x[-1]).mean())


CASES = {
    "sum": (series.ts_sum(close, 5), lambda w: w.rolling(5, min_periods=3).sum()),
    "mean": (series.ts_mean(close, 5), lambda w: w.rolling(5, min_periods=3).mean()),
    "std": (series.ts_std(close, 5), lambda w: w.rolling(5, min_periods=3).std(ddof=0)),
    "min": (series.ts_min(close, 5), lambda w: w.rolling(5).min()),
    "max": (series.ts_max(close, 5), lambda w: w.rolling(5).max()),
    "rank": (series.ts_rank(close, 5), lambda w: w.rolling(5).apply(last, raw=True)),
    "argmax": (series.ts_argmax(close, 5), lambda w: w.rolling(5).apply(lambda x: 4 - int(np.argmax(x)), raw=True)),
    "argmin": (series.ts_argmin(close, 5), lambda w: w.rolling(5).apply(lambda x: 4 - int(np.argmin(x)), raw=True)),
    "product": (series.ts_product(close, 5), lambda w: w.rolling(5, min_periods=3).apply(np.nanprod, raw=True)),
    "delay": (series.delay(close, 3), lambda w: w.shift(3)),
    "change": (series.pct_change(close, 2), lambda w: w / w.shift(2) - 1),
    "skew": (series.rolling_skew(close, 6), lambda w: w.rolling(6).skew()),
    "kurt": (series.rolling_kurt(close, 6), lambda w: w.rolling(6).kurt()),
    "ewm": (series.ewm(close, 0.3), lambda w: w.ewm(alpha=0.3, adjust=False).mean()),
    "half": (series.ewm_half(close, 4), lambda w: w.ewm(halflife=4).mean()),
    "half_std": (series.ewm_half_std(close, 4), lambda w: w.ewm(halflife=4).std()),
    "day_rank": (cross.rank(close), lambda w: w.rank(axis=1, pct=True)),
    "demean": (cross.demean(close), lambda w: w.sub(w.mean(axis=1), axis=0)),
    "zscore": (cross.zscore(close), lambda w: w.sub(w.mean(axis=1), axis=0).div(w.std(axis=1, ddof=0), axis=0).where(w.std(axis=1, ddof=0) > 1e-12, 0.0, axis=0).where(w.notna())),
    "nested": (series.ts_mean(cross.rank(series.ts_sum(close, 3)), 4), lambda w: w.rolling(3, min_periods=1).sum().round(9).rank(axis=1, pct=True).rolling(4, min_periods=2).mean()),
}


@pytest.mark.parametrize("name", CASES)
def test_operator_against_pandas(panel, wide, name):
    expression, expected = CASES[name]
    pd.testing.assert_frame_equal(values(panel, expression), expected(wide), check_names=False, atol=1e-9)


def test_decay_and_correlation(panel, wide):
    def decayed(x):
        w = np.arange(5 - len(x) + 1, 6)[-len(x) :] * ~np.isnan(x)
        return np.nansum(x * w) / w.sum()

    pd.testing.assert_frame_equal(values(panel, series.decay_linear(close, 5)), wide.rolling(5, min_periods=3).apply(decayed, raw=True), check_names=False)
    other = pd.DataFrame({c: 100.0 + np.arange(N) % 7 for c in wide})
    found, want = values(panel, series.correlation(close, volume, 6)), wide.rolling(6).corr(other)
    flat = wide.rolling(6).std(ddof=0) < 1e-7
    pd.testing.assert_frame_equal(found, want.where(~flat), check_names=False, atol=1e-7)


def test_a_missing_comparison_is_false(panel, wide):
    found = values(panel, series.flag(close > column("CAST(NULL AS DOUBLE)")))
    assert (found == 0.0).all().all()


def test_registry():
    assert len(registry.names("alpha101")) == 101 and len(registry.names("gtja191")) == 111 and len(registry.names("alpha101_variants")) == 90
    assert registry.make("momentum_20").key == registry.make("momentum").key
    assert registry.make("ewma_vol_hl10").key == registry.make("ewma_vol").key
    assert registry.make("alpha_042_compress").key == registry.make("alpha_042").key != registry.make("alpha_040_compress").key
    with pytest.raises(KeyError):
        registry.make("momentum_x")
    assert "momentum" in registry.names(kinds={"momentum"}) and "momentum" not in registry.names(kinds={"momentum", "volume"}, every=True)
