"""SQL written by hand for single operators, from their definitions and by other means than the operators' own.

Windows along a code are joins of numbered rows, each with the rows before it, and groups; operators across a date are
joins with that date's groups. So a mistake in an expression can't be on both sides of a comparison.
"""

from __future__ import annotations

from .plans.expression import tidy
from .sources import adapters as src

#: The rows of the grid by number, with returns and what closed higher.
NUMBERED = """SELECT p.*, q.close AS before, p.close / nullif(q.close, 0) - 1 AS r FROM
  (SELECT code, date, close, volume, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM panel) p
  LEFT JOIN (SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM panel) q ON p.code = q.code AND p.n = q.n + 1"""


def last(d: int, value: str) -> str:
    """value over the last d rows b of each row a, as a group."""
    return f"SELECT a.code, a.date, {value} AS value FROM numbered a JOIN numbered b ON a.code = b.code AND b.n BETWEEN a.n - {d - 1} AND a.n GROUP BY a.code, a.date, a.n, a.close"


def ago(d: int, value: str) -> str:
    return f"SELECT a.code, a.date, {value} AS value FROM numbered a LEFT JOIN numbered b ON a.code = b.code AND b.n = a.n - {d}"


def at(least: int, value: str, x: str = "b.close") -> str:
    return f"CASE WHEN count({x}) >= {least} THEN {value} END"


PAIR = "CASE WHEN b.volume IS NOT NULL THEN b.close END", "CASE WHEN b.close IS NOT NULL THEN b.volume END"
ALONG = {
    "delay": ago(5, "b.close"), "delta": ago(5, "a.close - b.close"), "returns": ago(1, "a.close / nullif(b.close, 0) - 1"),
    "sum": last(10, at(6, "sum(b.volume)", "b.volume")), "mean": last(10, at(6, "avg(b.close)")),
    "min": last(10, at(10, "min(b.close)")), "max": last(10, at(10, "max(b.close)")), "adv": last(20, at(20, "avg(b.volume)", "b.volume")),
    "argmax": last(10, at(10, "a.n + max(struct_pack(x := b.close, k := -b.n)).k")), "argmin": last(10, at(10, "a.n - min(struct_pack(x := b.close, k := b.n)).k")),
    "rank": last(10, at(10, "count(*) FILTER (b.close <= a.close) / 10.0")), "product": last(10, at(6, "product(1 + b.r * 0.01)", "b.r")),
    "correlation": last(10, f"CASE WHEN count({PAIR[0]}) = 10 AND stddev_pop({PAIR[0]}) >= 1e-7 AND stddev_pop({PAIR[1]}) >= 1e-7 THEN greatest(least(corr(b.close, b.volume), 1), -1) END"),
    "covariance": last(10, f"CASE WHEN count({PAIR[0]}) = 10 THEN covar_samp(b.close, b.volume) END"), "decay_linear": last(10, at(6, "sum(b.close * (10 - (a.n - b.n))) / sum(10 - (a.n - b.n)) FILTER (b.close IS NOT NULL)")),
    "count": last(10, "CASE WHEN count(*) = 10 THEN count(*) FILTER (b.close > b.before) END"), "slope": last(10, at(10, "regr_slope(b.close, b.n)")),
}
# the spread by deviations from the mean, in two steps: one pass over squares would lose digits
ALONG["std"] = f"SELECT code, date, CASE WHEN k >= 6 THEN sqrt(list_sum(list_transform(xs, lambda x: (x - m) * (x - m))) / k) END AS value FROM ({last(10, 'list(b.close) FILTER (b.close IS NOT NULL)').replace(' AS value', ' AS xs, avg(b.close) AS m, count(b.close) AS k')})"

RETURNED = "SELECT p.*, n.r FROM panel p JOIN numbered n USING (code, date)"
ACROSS = {
    "scale": "SELECT code, date, r / nullif(s, 0) AS value FROM returned LEFT JOIN (SELECT date, sum(abs(r)) AS s FROM returned GROUP BY date) USING (date)",
    "demean": "SELECT code, date, close - m AS value FROM returned JOIN (SELECT date, avg(close) AS m FROM returned GROUP BY date) USING (date)",
    "industry_neutral": "SELECT code, date, close - avg(close) OVER (PARTITION BY date, solo) AS value FROM returned",
    "winsorize": "SELECT code, date, CASE WHEN r < lo THEN lo WHEN r > hi THEN hi ELSE r END AS value FROM returned JOIN (SELECT date, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM returned GROUP BY date) USING (date)",
    "zscore": "SELECT code, date, CASE WHEN r IS NOT NULL THEN CASE WHEN s < 1e-12 THEN 0 ELSE (r - m) / s END END AS value FROM returned JOIN (SELECT date, avg(r) AS m, stddev_pop(r) AS s FROM returned GROUP BY date) USING (date)",
    "rank": """SELECT a.code, a.date, (count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2.0) / nullif(count(b.close), 0) AS value FROM (SELECT code, date, round(close, 9) AS close FROM panel) a
      JOIN (SELECT code, date, round(close, 9) AS close FROM panel) b USING (date) WHERE a.close IS NOT NULL GROUP BY a.code, a.date, a.close UNION ALL SELECT code, date, NULL FROM panel WHERE close IS NULL""",
    "industry_centred": "SELECT code, date, r - m AS value FROM returned JOIN (SELECT date, ind_or_unknown, avg(r) AS m FROM returned GROUP BY date, ind_or_unknown) USING (date, ind_or_unknown)",
    "breadth": "SELECT code, date, value FROM returned JOIN (SELECT date, count(*) FILTER (r > 0)::DOUBLE / count(*) AS value FROM returned GROUP BY date) USING (date)",
    "industry_strength": "SELECT code, date, CASE WHEN ind IS NOT NULL AND k >= 2 THEN r - m END AS value FROM returned LEFT JOIN (SELECT date, ind, median(r) AS m, count(r) AS k FROM returned GROUP BY date, ind) USING (date, ind)",
}


def oracles() -> dict[str, str]:
    of = lambda sql: src.with_tables(f"SELECT code, date, {tidy('value')} AS value FROM (SELECT code, date, CAST(value AS DOUBLE) AS value FROM ({sql}))", numbered=NUMBERED, returned=RETURNED)
    return {f"ts_{k}": of(v) for k, v in ALONG.items()} | {f"cs_{k}": of(v) for k, v in ACROSS.items()}

#: Factors of each structure: means and ranges along a code, differences, correlations, ranks across a day, and these nested.
FACTORS = ["momentum_20", "ma_distance_20", "ma_slope_20_5", "vol_ratio_5", "boll_position_20", "hl_range_20", "alpha_004", "alpha_006", "alpha_012", "alpha_033", "alpha_040", "alpha_041", "alpha_053", "alpha_054", "alpha_101"]
GRID = "SELECT code, date, open, high, low, close, volume, row_number() OVER (PARTITION BY code ORDER BY date) AS n, ((close - low) - (high - close)) / nullif(close - low, 0) AS place FROM panel"
OF_20 = """SELECT code, n, CASE WHEN k = 20 THEN m END AS mean, CASE WHEN k = 20 THEN sqrt(list_sum(list_transform(xs, lambda x: (x - m) * (x - m))) / 20) END AS sd, CASE WHEN kh = 20 THEN hi END AS hi, CASE WHEN kl = 20 THEN lo END AS lo FROM (
  SELECT a.code, a.n, count(b.close) AS k, avg(b.close) AS m, list(b.close) FILTER (b.close IS NOT NULL) AS xs, count(b.high) AS kh, max(b.high) AS hi, count(b.low) AS kl, min(b.low) AS lo FROM grid a JOIN grid b ON a.code = b.code AND b.n BETWEEN a.n - 19 AND a.n GROUP BY a.code, a.n)"""
_PAIRED = lambda x: f"CASE WHEN b.volume IS NOT NULL THEN b.{x} END", lambda x: f"CASE WHEN b.{x} IS NOT NULL THEN b.volume END"
_CORR = lambda x: f"CASE WHEN count({_PAIRED[0](x)}) = 10 AND stddev_pop({_PAIRED[0](x)}) >= 1e-7 AND stddev_pop({_PAIRED[1](x)}) >= 1e-7 THEN greatest(least(corr(b.{x}, b.volume), 1), -1) END"
OF_10 = f"""SELECT a.code, a.n, a.date, {_CORR("open")} AS open_volume, {_CORR("high")} AS high_volume, CASE WHEN count(b.high) >= 6 THEN round(stddev_pop(b.high), 9) END AS high_sd FROM grid a JOIN grid b ON a.code = b.code AND b.n BETWEEN a.n - 9 AND a.n GROUP BY a.code, a.n, a.date"""
OF_5 = "SELECT a.code, a.n, CASE WHEN count(b.volume) = 5 THEN avg(b.volume) END AS mean FROM grid a JOIN grid b ON a.code = b.code AND b.n BETWEEN a.n - 4 AND a.n GROUP BY a.code, a.n"


def ranked(rows: str, x: str) -> str:
    """(code, date, share): the share of the day's codes at or below, ties at their mean, by counting pairs of a day's codes."""
    own = f"(SELECT code, date, {x} AS x FROM {rows})"
    return f"SELECT a.code, a.date, (count(*) FILTER (b.x < a.x) + (count(*) FILTER (b.x = a.x) + 1) / 2.0) / count(b.x) AS share FROM {own} a JOIN {own} b USING (date) WHERE a.x IS NOT NULL GROUP BY a.code, a.date, a.x"


LOW_RANKS = "SELECT g.code, g.n, g.date, r.share FROM grid g LEFT JOIN low_shares r USING (code, date)"
LOW_9 = "SELECT a.code, a.n, CASE WHEN count(b.share) = 9 THEN count(*) FILTER (b.share <= a.share) / 9.0 END AS share FROM low_ranks a JOIN low_ranks b ON a.code = b.code AND b.n BETWEEN a.n - 8 AND a.n GROUP BY a.code, a.n, a.share"
BY_HAND = f"""SELECT g.code, g.date, g.close / nullif(b20.close, 0) - 1 AS momentum_20, (g.close - w.mean) / nullif(w.mean, 0) AS ma_distance_20, (w.mean - w5.mean) / nullif(w5.mean, 0) AS ma_slope_20_5, g.volume / nullif(v5.mean, 0) - 1 AS vol_ratio_5,
  (g.close - w.mean) / nullif(2 * w.sd, 0) AS boll_position_20, (w.hi - w.lo) / nullif(g.close, 0) AS hl_range_20, - l9.share AS alpha_004, - t.open_volume AS alpha_006, sign(g.volume - b1.volume) * (b1.close - g.close) AS alpha_012,
  rg.share AS alpha_033, - rs.share * t.high_volume AS alpha_040, sqrt(g.high * g.low) - round((g.high + g.low + g.close) / 3, 8) AS alpha_041, b9.place - g.place AS alpha_053, - (g.low - g.close) * pow(g.open, 5) / nullif((g.low - g.high) * pow(g.close, 5), 0) AS alpha_054, (g.close - g.open) / (g.high - g.low + 0.001) AS alpha_101
  FROM grid g LEFT JOIN of_20 w ON g.code = w.code AND g.n = w.n LEFT JOIN of_20 w5 ON g.code = w5.code AND g.n = w5.n + 5 LEFT JOIN of_5 v5 ON g.code = v5.code AND g.n = v5.n + 1 LEFT JOIN of_10 t ON g.code = t.code AND g.n = t.n
  LEFT JOIN grid b1 ON g.code = b1.code AND g.n = b1.n + 1 LEFT JOIN grid b9 ON g.code = b9.code AND g.n = b9.n + 9 LEFT JOIN grid b20 ON g.code = b20.code AND g.n = b20.n + 20
  LEFT JOIN low_9 l9 ON g.code = l9.code AND g.n = l9.n LEFT JOIN gap_shares rg ON g.code = rg.code AND g.date = rg.date LEFT JOIN sd_shares rs ON g.code = rs.code AND g.date = rs.date"""


def factors() -> str:
    parts = {
        "grid": GRID, "of_20": OF_20, "of_10": OF_10, "of_5": OF_5, "low_shares": ranked("grid", "round(low, 9)"), "low_ranks": LOW_RANKS, "low_9": LOW_9, "gap_shares": ranked("grid", "round(- (1 - open / nullif(close, 0)), 9)"),
        "sd_shares": ranked("of_10", "high_sd"), "by_hand": BY_HAND,
    }
    return src.with_tables(f"SELECT code, date, {', '.join(f'{tidy(f)} AS {f}' for f in FACTORS)} FROM (SELECT code, date, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FACTORS)} FROM by_hand)", **parts)
