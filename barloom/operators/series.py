"""Operators along a code's bars. Windows count rows of the date grid; a missing value is NULL.

Relaxed operators need int(0.6 d) values of a window of d rows, strict ones all d.
"""

from __future__ import annotations


import numpy as np
import pandas as pd

from ..plans import blocks
from ..plans.expression import SPARK, SQL, Expression, along, element, lift, power, recursion

ORDER = "(PARTITION BY code ORDER BY date)"


def window(d: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


def relaxed(d: int) -> int:
    return max(1, int(0.6 * d))


def _enough(d: int, value: str, least: int) -> str:
    return f"CASE WHEN count({{0}}) OVER {window(d)} >= {least} THEN {value} END"


def delay(x, d: int) -> Expression:
    return along(f"lag({{0}}, {d}) OVER {ORDER}", x, run=lambda v: blocks.lag(v, d)) if d else lift(x)


def lead(x, d: int) -> Expression:
    return along(f"lead({{0}}, {d}) OVER {ORDER}", x, run=lambda v: blocks.lead(v, d))


def delta(x, d: int) -> Expression:
    return lift(x) - delay(x, d)


def pct_change(x, d: int = 1) -> Expression:
    return lift(x) / delay(x, d) - 1


def rolling(name: str, x, d: int, least: int | None = None) -> Expression:
    """sum, avg, min, max, stddev_pop or stddev_samp of the last d rows; strict unless least is given."""
    least = d if least is None else least
    return along(_enough(d, f"{name}({{0}}) OVER {window(d)}", least), x, run=lambda v: blocks.rolled(name, v, d, least))


def ts_sum(x, d: int) -> Expression:
    return rolling("sum", x, d, relaxed(d))


def ts_mean(x, d: int) -> Expression:
    return rolling("avg", x, d, relaxed(d))


def ts_std(x, d: int) -> Expression:
    return rolling("stddev_pop", x, d, relaxed(d))


def ts_min(x, d: int) -> Expression:
    return rolling("min", x, d)


def ts_max(x, d: int) -> Expression:
    return rolling("max", x, d)


def mean(x, d: int) -> Expression:
    return rolling("avg", x, d)


def adv(volume, d: int) -> Expression:
    return rolling("avg", volume, d)


def _since(best: str, x, d: int) -> Expression:
    rows = {SPARK: f"collect_list({{0}}) OVER {window(d)}", SQL: f"list({{0}}) OVER {window(d)}"}
    spark = _enough(d, f"CAST({d} - array_position({rows[SPARK]}, {best}({{0}}) OVER {window(d)}) AS DOUBLE)", d)
    return along({SPARK: spark, SQL: _enough(d, f"CAST({d} - list_position({rows[SQL]}, {best}({{0}}) OVER {window(d)}) AS DOUBLE)", d)}, x, run=lambda v: blocks.since(best, v, d))


def ts_argmax(x, d: int) -> Expression:
    """Rows since the largest value, the oldest of equal ones."""
    return _since("max", x, d)


def ts_argmin(x, d: int) -> Expression:
    return _since("min", x, d)


def ts_rank(x, d: int) -> Expression:
    """Share of the window's values that are at most today's."""
    spark = f"size(filter(collect_list({{0}}) OVER {window(d)}, v -> v <= {{0}}))"
    sql = f"len(list_filter(list({{0}}) OVER {window(d)}, lambda v: v <= {{0}}))"
    return along({SPARK: _enough(d, f"{spark} / {d}D", d), SQL: _enough(d, f"{sql} / {d}.0", d)}, x, run=lambda v: blocks.ranked(v, d))


def ts_product(x, d: int) -> Expression:
    if d == 1:
        return lift(x)
    spark = f"aggregate(collect_list({{0}}) OVER {window(d)}, 1D, (a, v) -> a * v)"
    return along({SPARK: _enough(d, spark, relaxed(d)), SQL: _enough(d, f"list_product(list({{0}}) FILTER ({{0}} IS NOT NULL) OVER {window(d)})", relaxed(d))}, x, run=lambda v: blocks.product(v, d, relaxed(d)))


def beside(x, y) -> Expression:
    """x where y is there, too."""
    return element("CASE WHEN {1} IS NOT NULL THEN {0} END", x, y, do=lambda u, v: np.where(np.isnan(v), np.nan, u))


def _paired(x, y) -> tuple[Expression, Expression]:
    return beside(x, y), beside(y, x)


def correlation(x, y, d: int) -> Expression:
    """Pearson over d complete pairs; NULL where either side hardly varies."""
    w = window(d)
    flat = f"count({{0}}) OVER {w} = {d} AND stddev_pop({{0}}) OVER {w} >= 1e-7 AND stddev_pop({{1}}) OVER {w} >= 1e-7"
    value = f"covar_pop({{0}}, {{1}}) OVER {w} / nullif(stddev_pop({{0}}) OVER {w} * stddev_pop({{1}}) OVER {w}, 0)"
    raw = along(f"CASE WHEN {flat} THEN {value} END", *_paired(x, y), run=lambda u, v: blocks.correlated(u, v, d))
    return element("CASE WHEN abs({0}) <= 1.0000000001 THEN greatest(least({0}, CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE)) END", raw, do=lambda v: np.where(np.abs(v) <= 1.0000000001, np.clip(v, -1.0, 1.0), np.nan))


def covariance(x, y, d: int) -> Expression:
    return along(f"CASE WHEN count({{0}}) OVER {window(d)} = {d} THEN covar_samp({{0}}, {{1}}) OVER {window(d)} END", *_paired(x, y), run=lambda u, v: blocks.together(u, v, d)[2] / (d - 1))


def nth() -> Expression:
    """A row's number along its code, from 1 on."""
    return along(f"CAST(row_number() OVER {ORDER} AS DOUBLE)", "code", run=lambda v: np.cumsum(np.ones_like(v), axis=0))


def decay_linear(x, d: int) -> Expression:
    """Weights 1 to d, the newest d, over the values that are there."""
    at = nth()
    own = element("CASE WHEN {0} IS NOT NULL THEN {1} END", x, at, do=lambda v, n: np.where(np.isnan(v), np.nan, n))
    w = window(d)
    top = f"sum({{1}}) OVER {w} - ({{2}} - {d}) * sum({{0}}) OVER {w}"
    bottom = f"sum({{3}}) OVER {w} - ({{2}} - {d}) * count({{0}}) OVER {w}"

    def run(v, weighted, at, there):
        above = blocks.total(weighted, d) - (at - d) * blocks.total(v, d)
        below = blocks.total(there, d) - (at - d) * blocks.count(v, d)
        return blocks.enough(v, d, relaxed(d), np.where(below == 0, np.nan, above / below))

    return along(_enough(d, f"({top}) / nullif({bottom}, 0)", relaxed(d)), x, lift(x) * at, at, own, run=run)


def regression_slope(x, d: int) -> Expression:
    def run(v, at):
        spread, _, common = blocks.together(at, v, d)
        return np.where(spread == 0, np.nan, common / spread)

    return along(_enough(d, f"regr_slope({{0}}, {{1}}) OVER {window(d)}", d), x, nth(), run=run)


def count_true(condition: Expression, d: int) -> Expression:
    flag = element("CASE WHEN {0} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", condition, do=lambda c: np.where(c, 1.0, 0.0))
    return rolling("sum", flag, d)




def _flat(v: np.ndarray, d: int) -> np.ndarray:
    return blocks.enough(v, d, d, np.where(blocks.extreme(np.fmax, v, d) == blocks.extreme(np.fmin, v, d), 1.0, 0.0))


def rolling_skew(x, d: int) -> Expression:
    """Bias-corrected; 0 for a flat window."""
    spark = f"skewness({{0}}) OVER {window(d)} * {(d * (d - 1)) ** 0.5 / (d - 2)}D"
    raw = along({SPARK: _enough(d, spark, d), SQL: _enough(d, f"skewness({{0}}) OVER {window(d)}", d)}, x, run=lambda v: blocks.skewed(v, d))
    flat = along(_enough(d, f"CASE WHEN max({{0}}) OVER {window(d)} = min({{0}}) OVER {window(d)} THEN 1 ELSE 0 END", d), x, run=lambda v: _flat(v, d))
    return element("CASE WHEN {1} = 1 THEN CAST(0 AS DOUBLE) ELSE {0} END", raw, flat)


def rolling_kurt(x, d: int) -> Expression:
    """Bias-corrected excess; -3 for a flat window."""
    a, b = (d - 1) / ((d - 2) * (d - 3)), d + 1
    spark = f"{a}D * ({b} * kurtosis({{0}}) OVER {window(d)} + 6)"
    raw = along({SPARK: _enough(d, spark, d), SQL: _enough(d, f"kurtosis({{0}}) OVER {window(d)}", d)}, x, run=lambda v: blocks.peaked(v, d))
    flat = along(_enough(d, f"CASE WHEN max({{0}}) OVER {window(d)} = min({{0}}) OVER {window(d)} THEN 1 ELSE 0 END", d), x, run=lambda v: _flat(v, d))
    return element("CASE WHEN {1} = 1 THEN CAST(-3 AS DOUBLE) ELSE {0} END", raw, flat)


def ewm(x, alpha: float) -> Expression:
    """y = alpha x + (1 - alpha) y before, seeded by the first value; over a gap the old weight decays and y stays."""
    rows = "list(struct_pack(y := CAST({0} AS DOUBLE), w := CAST(1 AS DOUBLE))) OVER (PARTITION BY code ORDER BY date)"
    keep, new = 1 - alpha, alpha
    step = (
        f"CASE WHEN v.y IS NULL THEN struct_pack(y := a.y, w := a.w * {keep!r}::DOUBLE) WHEN a.y IS NULL THEN v "
        f"ELSE struct_pack(y := (a.w * {keep!r}::DOUBLE * a.y + {new!r}::DOUBLE * v.y) / (a.w * {keep!r}::DOUBLE + {new!r}::DOUBLE), w := CAST(1 AS DOUBLE)) END"
    )
    return recursion(f"ewm_{alpha!r}", f"list_reduce({rows}, lambda a, v: {step}).y", lambda v: pd.DataFrame(v).ewm(alpha=alpha, adjust=False).mean().to_numpy(), x)


def sma(x, n: int, m: int) -> Expression:
    return ewm(x, m / n)


def ema(x, span: int) -> Expression:
    return ewm(x, 2 / (span + 1))


def _halved(h: float) -> tuple[str, str, str]:
    over = "OVER (PARTITION BY code ORDER BY date)"
    weight = f"(CASE WHEN {{0}} IS NOT NULL THEN pow(2.0, {{1}} / {h!r}) END)"
    return over, weight, f"sum({weight} * {{0}}) {over} / sum({weight}) {over}"


def ewm_half(x, h: float) -> Expression:
    """Mean with weights that halve every h rows, over all rows so far."""
    _, _, value = _halved(h)
    return recursion(f"ewm_half_{h!r}", value, lambda v, _: pd.DataFrame(v).ewm(halflife=h).mean().to_numpy(), x, nth())


def ewm_half_std(x, h: float) -> Expression:
    """The spread with the same weights, corrected for bias."""
    over, w, m = _halved(h)
    sw, sw2 = f"sum({w}) {over}", f"sum({w} * {w}) {over}"
    rows = f"list(struct_pack(w := {w}, x := {{0}})) FILTER ({{0}} IS NOT NULL) {over}"
    biased = f"list_sum(list_transform({rows}, lambda v: v.w * pow(v.x - {m}, 2))) / {sw}"
    sql = f"CASE WHEN count({{0}}) {over} > 1 THEN sqrt({biased} / (1 - {sw2} / pow({sw}, 2))) END"

    def run(v, _):
        """One value has no spread; after gaps rounding would make it 0."""
        return np.where(blocks.count(v, len(v)) >= 2, pd.DataFrame(v).ewm(halflife=h).std().to_numpy(), np.nan)

    spread = recursion(f"ewm_half_std_{h!r}", sql, run, x, nth())
    return element("CASE WHEN {0} < 1e-9 THEN CAST(0 AS DOUBLE) ELSE {0} END", spread)


def where(condition: Expression, x, y) -> Expression:
    """x where the condition is true, else y."""
    return element("CASE WHEN {0} THEN {1} ELSE {2} END", condition, x, y, do=np.where)


def only(condition: Expression, x) -> Expression:
    return element("CASE WHEN {0} THEN {1} END", condition, x, do=lambda c, v: np.where(c, v, np.nan))


def flag(condition: Expression) -> Expression:
    return where(condition, 1.0, 0.0)


def log(x) -> Expression:
    return element("ln(CASE WHEN {0} > 0 THEN {0} END)", x, do=lambda v: np.log(np.where(v > 0, v, np.nan)))


def sign(x) -> Expression:
    return element("sign({0})", x, do=np.sign)


def absolute(x) -> Expression:
    return element("abs({0})", x, do=np.abs)


def sqrt(x) -> Expression:
    return element("sqrt(CASE WHEN {0} >= 0 THEN {0} END)", x, do=lambda v: np.sqrt(np.where(v >= 0, v, np.nan)))


def signed_power(x, a, exact: bool = False) -> Expression:
    """exact: the power is the C library's, to the last bit, for results too large to be cut to digits."""
    own = element("(sign({0}) * pow(abs({0}), {1}))", x, a, do=lambda v, p: np.sign(v) * power(np.abs(v), p))
    if exact:
        own.there = element("(sign({0}) * {1})", x, along("pow(abs({0}), {1})", x, a, run=blocks.power), do=lambda v, p: np.sign(v) * p)
    return own


def largest(x, y) -> Expression:
    return element("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END", x, y, do=np.maximum)


def smallest(x, y) -> Expression:
    return element("CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END", x, y, do=np.minimum)


def at_least(x, low) -> Expression:
    return largest(x, low)


def at_most(x, high) -> Expression:
    return smallest(x, high)


def filled(x, value) -> Expression:
    return element("coalesce({0}, {1})", x, value, do=lambda v, w: np.where(np.isnan(v), w, v))


def nonzero(x) -> Expression:
    return element("nullif({0}, 0)", x, do=lambda v: np.where(np.equal(v, 0), np.nan, v))


def present(x) -> Expression:
    return element("({0} IS NOT NULL)", x, do=lambda v: ~np.isnan(v))


