"""Operators across the codes of a date. NULL values take no part and stay NULL."""

from __future__ import annotations

from ..plans import blocks
from ..plans.expression import SPARK, SQL, Expression, across, element, lift

DAY = "(PARTITION BY date)"
#: Places to which a value is rounded before it is ranked: sums in another order must not change a rank.
PLACES = 9


def rank(x) -> Expression:
    """Share of the valid codes at or below, ties at their mean."""
    key = element(f"round({{0}}, {PLACES})", x)
    at = "(PARTITION BY date ORDER BY {0} NULLS LAST)"
    ties = "(PARTITION BY date ORDER BY {0} NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    text = f"CASE WHEN {{0}} IS NOT NULL THEN (rank() OVER {at} + (count({{0}}) OVER {ties} - 1) / CAST(2 AS DOUBLE)) / count({{0}}) OVER {DAY} END"
    own = across(text, key, run=blocks.mean_rank)
    own.there = across(text.replace("{0}", f"round({{0}}, {PLACES})"), x, run=lambda v: blocks.mean_rank(blocks.places(v, PLACES)))
    return own


def scale(x, to: float = 1.0) -> Expression:
    return across(f"{{0}} * CAST({to!r} AS DOUBLE) / nullif(sum(abs({{0}})) OVER {DAY}, 0)", x, run=lambda v: blocks.scaled(v, to))


def demean(x) -> Expression:
    return across(f"{{0}} - avg({{0}}) OVER {DAY}", x, run=blocks.centred)


def industry_neutral(x, solo: str = "solo") -> Expression:
    """x less the mean of its industry; a code without an industry is its own."""
    return across(f"{{0}} - avg({{0}}) OVER (PARTITION BY date, {solo})", x, run=blocks.centred, by=solo)


def day_mean(x) -> Expression:
    return across(f"avg({{0}}) OVER {DAY}", x)


def day_std(x) -> Expression:
    return across(f"stddev_samp({{0}}) OVER {DAY}", x)


def day_skew(x) -> Expression:
    n = f"count({{0}}) OVER {DAY}"
    spark = f"CASE WHEN {n} > 2 THEN skewness({{0}}) OVER {DAY} * sqrt(CAST({n} * ({n} - 1) AS DOUBLE)) / ({n} - 2) END"
    return across({SPARK: spark, SQL: f"skewness({{0}}) OVER {DAY}"}, x)


def day_share(condition: Expression) -> Expression:
    """Share of all codes of the grid for which the condition holds."""
    flag = element("CASE WHEN {0} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", condition)
    return across(f"avg({{0}}) OVER {DAY}", flag)


def quantile(x, q: float, group: str = "date") -> Expression:
    """Linear between neighbours."""
    return across({SPARK: f"percentile({{0}}, {q!r}) OVER (PARTITION BY {group})", SQL: f"quantile_cont({{0}}, {q!r}) OVER (PARTITION BY {group})"}, x)


def winsorize(x, low: float = 0.01, high: float = 0.99) -> Expression:
    return element("CASE WHEN {0} IS NOT NULL THEN greatest(least({0}, {2}), {1}) END", x, quantile(x, low), quantile(x, high))


def zscore(x) -> Expression:
    """Population score; 0 where the day hardly varies."""
    return across(f"CASE WHEN {{0}} IS NOT NULL THEN CASE WHEN stddev_pop({{0}}) OVER {DAY} < 1e-12 THEN CAST(0 AS DOUBLE) ELSE ({{0}} - avg({{0}}) OVER {DAY}) / stddev_pop({{0}}) OVER {DAY} END END", x)


def standard(x) -> Expression:
    """Population score; NULL where the day hardly varies."""
    spread = f"stddev_pop({{0}}) OVER {DAY}"
    return across(f"CASE WHEN {spread} > 1e-12 THEN ({{0}} - avg({{0}}) OVER {DAY}) / {spread} END", x, run=blocks.standard)


def regressed(y, x, least: int = 10) -> Expression:
    """Residual of the day's regression on x; y itself where there are too few pairs, x does not vary or is missing."""
    own_y = element("CASE WHEN {1} IS NOT NULL THEN {0} END", y, x)
    own_x = element("CASE WHEN {1} IS NOT NULL THEN {0} END", x, y)
    n, var = f"count({{0}}) OVER {DAY}", f"var_pop({{1}}) OVER {DAY}"
    slope = f"covar_pop({{0}}, {{1}}) OVER {DAY} / nullif({var}, 0)"
    fit = across(f"CASE WHEN {n} >= {least} AND {var} > 1e-12 THEN avg({{0}}) OVER {DAY} + {slope} * ({{1}} - avg({{1}}) OVER {DAY}) END", own_y, own_x)
    return element("coalesce({0} - {1}, {0})", y, fit)


def industry_centred(y, bucket: str = "ind_or_unknown") -> Expression:
    return across(f"{{0}} - avg({{0}}) OVER (PARTITION BY date, {bucket})", y, run=blocks.centred, by=bucket)


def industry_and_size(y, x, bucket: str = "ind_or_unknown") -> Expression:
    """Residual on industry and x together: both sides centred within the industry, one slope a day."""
    own_y = element("CASE WHEN {1} IS NOT NULL THEN {0} END", y, x)
    own_x = element("CASE WHEN {1} IS NOT NULL THEN {0} END", x, y)
    yc, xc = industry_centred(own_y, bucket), industry_centred(own_x, bucket)
    slope = across(f"sum({{0}}) OVER {DAY} / nullif(sum({{1}}) OVER {DAY}, 0)", yc * xc, xc * xc)
    return element("coalesce({0} - {1} * {2}, {3})", yc, slope, xc, y)


def industry_strength(x, bucket: str = "ind") -> Expression:
    """x less the median of its industry, from two members on."""
    median = quantile(x, 0.5, f"date, {bucket}")
    members = across(f"count({{0}}) OVER (PARTITION BY date, {bucket})", x)
    return element("CASE WHEN {3} IS NOT NULL AND {2} >= 2 THEN {0} - {1} END", x, median, members, lift(bucket))


def industry_or_day(x, mapped: bool = True) -> Expression:
    """x less the mean of its industry, or without a map of industries less the day's mean."""
    return industry_neutral(x) if mapped else demean(x)


def preprocess(x, tags: tuple[str, ...] = (), n_codes: int | None = None, winsorise: tuple[float, float] | None = (0.01, 0.99), score: bool = True, industry: bool = True, size=None, mapped: bool = True, least_codes: int = 200) -> Expression:
    """x made comparable across a day, step by step: tails cut, score, freed of industry and size.

    Below least_codes nothing is done. Factors tagged "fundamental" keep their industry's level, those tagged
    "contains_mcap" their size; size is an expression (such as the logarithm of the market's value), or None for no such
    step; without a map of industries that step is left out.
    """
    own = lift(x)
    if n_codes is not None and n_codes < least_codes:
        return own
    if winsorise:
        own = winsorize(own, *winsorise)
    if score:
        own = zscore(own)
    by_industry, by_size = industry and mapped and "fundamental" not in tags, size is not None and "contains_mcap" not in tags
    if by_industry and by_size:
        return industry_and_size(own, size)
    return industry_centred(own) if by_industry else regressed(own, size) if by_size else own
