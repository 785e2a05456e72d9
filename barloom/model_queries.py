"""Queries of the series and cross-section operators, indicators, fundamentals, models, simulators and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from . import hand_sql
from .functions.fields import close, open_, ret, volume
from .market_queries import CORR, FACTORS, IC_TABLES, SCORES, labelled, r6, scores
from .operators import analysis, cross, fundamentals, indicators, modelling, ranking, series, simulate
from .plans.expression import as_sql, column, evaluate
from .sources import adapters as src
from .sources import shared
from .streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = src.with_tables(sql, **more)
        return run

    return add


def expressions(name: str, outputs: dict) -> None:
    QUERIES[name] = lambda spark, d: evaluate(src.panel(spark, d), outputs)
    ORACLES[name] = src.with_tables(as_sql("SELECT * FROM panel", outputs))


back = series.delay(close, 1)
for _name, _value in {
    "delay": series.delay(close, 5), "delta": series.delta(close, 5), "sum": series.ts_sum(volume, 10), "mean": series.ts_mean(close, 10), "std": series.ts_std(close, 10), "min": series.ts_min(close, 10), "max": series.ts_max(close, 10),
    "argmax": series.ts_argmax(close, 10), "argmin": series.ts_argmin(close, 10), "rank": series.ts_rank(close, 10), "product": series.ts_product(1 + ret * 0.01, 10), "correlation": series.correlation(close, volume, 10),
    "covariance": series.covariance(close, volume, 10), "decay_linear": series.decay_linear(close, 10), "returns": ret, "adv": series.adv(volume, 20), "count": series.count_true(close > back, 10), "sma": series.sma(close, 6, 1),
    "slope": series.regression_slope(close, 10), "skew": series.rolling_skew(close, 10), "kurt": series.rolling_kurt(close, 10), "ewm_half": series.ewm_half(close, 5), "ewm_half_std": series.ewm_half_std(close, 5),
}.items():
    expressions(f"ts_{_name}", {"value": _value})
for _name, _value in {
    "rank": cross.rank(close), "scale": cross.scale(ret), "demean": cross.demean(close), "industry_neutral": cross.industry_neutral(close), "winsorize": cross.winsorize(ret, 0.05, 0.95), "zscore": cross.zscore(ret),
    "size_neutral": cross.regressed(ret, series.log(volume)), "industry_centred": cross.industry_centred(ret), "industry_and_size": cross.industry_and_size(ret, series.log(volume)), "industry_strength": cross.industry_strength(ret),
    "breadth": cross.day_share(ret > 0), "skew": cross.day_skew(ret),
    "pipeline": cross.industry_and_size(cross.zscore(cross.winsorize(ret, 0.05, 0.95)), series.log(volume)),
}.items():
    expressions(f"cs_{_name}", {"value": _value})
expressions("fn_math", {"signed_power": series.signed_power(ret, 0.5), "safe_div": close / column("nullif(volume, 10)"), "larger": series.largest(open_, close), "log": series.log(volume), "limited": series.at_most(series.at_least(ret, -0.5), 0.5)})
expressions("indicators", indicators.indicators())

ORACLES |= hand_sql.oracles()

# hand-written twins of single operators, so that a mistake in the expressions can't pass both sides


@query("ts_mean_by_hand", "SELECT code, date, round(CASE WHEN count(close) OVER w >= 6 THEN avg(close) OVER w END, 4) AS value FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def ts_mean_by_hand(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(src.panel(spark, d), {"value": series.ts_mean(close, 10)}, rounded=False).withColumn("value", F.round("value", 4))


@query(
    "ts_decay_by_hand",
    """SELECT code, date, round(CASE WHEN count(x) >= 6 THEN sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END) END, 4) AS value FROM (
         SELECT a.code, a.date, b.close AS x, 10 - (a.n - b.n) AS w FROM nth a JOIN nth b ON a.code = b.code AND b.n BETWEEN a.n - 9 AND a.n) GROUP BY code, date""",
    nth="SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM panel",
)
def ts_decay_by_hand(spark, d):
    return evaluate(src.panel(spark, d), {"value": series.decay_linear(close, 10)}, rounded=False).withColumn("value", F.round("value", 4))


@query("cs_rank_by_hand", "SELECT code, date, round(CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY close NULLS LAST) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(close) OVER (PARTITION BY date) END, 6) AS value FROM panel")
def cs_rank_by_hand(spark, d):
    return evaluate(src.panel(spark, d), {"value": cross.rank(close)})


@query(
    "cs_size_neutral_by_hand",
    """SELECT code, date, round(CASE WHEN n >= 10 AND v > 1e-12 AND x IS NOT NULL THEN y - (slope * x + cut) ELSE y END, 6) + 0 AS value FROM (
         SELECT code, date, y, x, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER d AS n, var_pop(CASE WHEN y IS NOT NULL THEN x END) OVER d AS v, regr_slope(y, x) OVER d AS slope, regr_intercept(y, x) OVER d AS cut FROM (
           SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS y, ln(volume) AS x FROM panel) WINDOW d AS (PARTITION BY date))""",
)
def cs_size_neutral_by_hand(spark, d):
    return evaluate(src.panel(spark, d), {"value": cross.regressed(ret, series.log(volume))}, rounded=False).withColumn("value", F.round("value", 6) + 0)


# scalar functions


@query(
    "fn_text",
    """SELECT s_suppkey AS k, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS filled, list_last(string_split('sh.' || s_suppkey, '.')) AS bare, regexp_replace(s_name, '[#/ ]', '_', 'g') AS path, upper(s_name) LIKE '%SUPP%' AS has,
              sha256(s_name) AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'sh.' ELSE 'sz.' END || s_suppkey AS coded, TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_acctbal AS VARCHAR) END AS DOUBLE) AS number FROM supplier""",
)
def fn_text(spark, d):
    k = F.col("s_suppkey").cast("string")
    coded = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "sh.").otherwise("sz."), k)
    number = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_acctbal").cast("string"))
    return src.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.lpad(k, 6, "0").alias("filled"), F.element_at(F.split(F.concat(F.lit("sh."), k), r"\."), -1).alias("bare"), F.regexp_replace("s_name", "[#/ ]", "_").alias("path"),
        F.upper("s_name").contains("SUPP").alias("has"), F.sha2("s_name", 256).alias("key"), coded.alias("coded"), number.try_cast("double").alias("number"),
    )


@query(
    "fn_dates",
    """SELECT date, CAST(date + 3 AS DATE) AS later, isodow(date) - 1 AS weekday, CAST(week(date) AS INTEGER) AS week, CAST(isoyear(date) AS INTEGER) AS week_year, quarter(date) AS quarter, year(date) * 4 + quarter(date) AS q, CAST(date_trunc('month', date) AS DATE) AS month FROM (SELECT DISTINCT date FROM bars)""",
)
def fn_dates(spark, d):
    day = F.col("date")
    return src.bars(spark, d).select("date").distinct().select(
        "date", F.date_add(day, 3).alias("later"), F.weekday(day).cast("long").alias("weekday"), F.weekofyear(day).alias("week"), F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("week_year"),
        F.quarter(day).cast("long").alias("quarter"), (F.year(day) * 4 + F.quarter(day)).cast("long").alias("q"), F.trunc(day, "month").alias("month"),
    )


@query("set_traded_codes", "SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'only_b' WHEN b.code IS NULL THEN 'only_a' ELSE 'both' END AS side FROM (SELECT DISTINCT code FROM bars WHERE date < DATE '1995-06-01') a FULL JOIN (SELECT DISTINCT code FROM bars WHERE volume > 150) b USING (code)")
def set_traded_codes(spark, d):
    own = src.bars(spark, d)
    a, b = own.where("date < '1995-06-01'").select("code").distinct(), own.where("volume > 150").select("code").distinct()
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    return tag(a.subtract(b), "only_a").union(tag(b.subtract(a), "only_b")).union(tag(a.intersect(b), "both"))


# fundamentals

FIELDS = ("roe", "net_profit", "total_share", "eps_ttm", "gross_margin", "net_margin", "revenue", "yoy_ni", "yoy_asset", "yoy_eps", "debt_to_asset", "asset_to_equity", "cfo_to_np")
KNOWN = [*(f for f in FIELDS if f not in ("net_profit", "revenue")), "profit4", "revenue_yoy", "equity", "roe_ttm"]
REPORT = {
    "roe": "n * 0.01", "net_profit": "s * 0.1 - 100000", "total_share": "1000 + n * 10", "eps_ttm": "s * 0.00001 - 2", "gross_margin": "n * 0.02", "net_margin": "n * 0.0125", "revenue": "s", "yoy_ni": "n * 0.005 - 0.1",
    "yoy_asset": "n * 0.002", "yoy_eps": "n * 0.003 - 0.05", "debt_to_asset": "1 / (1.0 + n)", "asset_to_equity": "1 + n * 0.1", "cfo_to_np": "n * 0.25",
}


def facts(spark, d):
    """Reports from orders: a row a code and quarter, fields as text, some of them empty."""
    orders = src.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.trunc("o_orderdate", "quarter").alias("q"), "o_totalprice")
    own = orders.groupBy("k", "q").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("s")).withColumn("stat_date", F.last_day(F.add_months("q", 2)))
    values = [F.when((F.col("n") + k) % 9 == 0, "").otherwise(F.round(F.expr(e), 4).cast("double").cast("string")).alias(f) for k, (f, e) in enumerate(REPORT.items())]
    return own.select(src.code_of("k").alias("code"), "stat_date", F.date_add("stat_date", 30).alias("pub_date"), *values)


FACTS = f"""SELECT {src.code_sql("k")} AS code, stat_date, CAST(stat_date + 30 AS DATE) AS pub_date, {", ".join(f"CASE WHEN (n + {k}) % 9 = 0 THEN NULL ELSE round(CAST({e} AS DOUBLE), 4) END AS {f}" for k, (f, e) in enumerate(REPORT.items()))}
  FROM (SELECT o_custkey % 50 AS k, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS stat_date, count(*) AS n, round(sum(o_totalprice), 0) AS s FROM orders GROUP BY 1, 2)"""
DERIVED = """SELECT *, CASE WHEN count(single) OVER f = 4 THEN sum(single) OVER f END AS roe_ttm FROM (
  SELECT *, CASE WHEN quarter(stat_date) = 1 THEN roe ELSE roe - max(roe) OVER (PARTITION BY code ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS single FROM (
    SELECT *, CASE WHEN count(net_profit) OVER w = 4 THEN sum(net_profit) OVER w END AS profit4, CASE WHEN abs(lag(revenue, 4) OVER r) > 1e-9 THEN (revenue - lag(revenue, 4) OVER r) / abs(lag(revenue, 4) OVER r) END AS revenue_yoy,
           CASE WHEN roe > 1e-9 AND net_profit / roe > 0 THEN net_profit / roe END AS equity, year(stat_date) * 4 + quarter(stat_date) AS q
    FROM facts WINDOW w AS (PARTITION BY code ORDER BY pub_date, stat_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), r AS (PARTITION BY code ORDER BY pub_date, stat_date)))
  WINDOW f AS (PARTITION BY code ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"""
PIT = f"""SELECT p.code, p.date, p.close, {", ".join(KNOWN)} FROM panel p JOIN (
  SELECT code, date, {", ".join(f"last_value({f} IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 250 PRECEDING AND CURRENT ROW) AS {f}" for f in KNOWN)}
  FROM (SELECT code, date FROM (SELECT DISTINCT code FROM panel) CROSS JOIN (SELECT date FROM panel UNION SELECT pub_date FROM derived)) g
  LEFT JOIN (SELECT code, pub_date AS date, {", ".join(f"arg_max({f}, stat_date) FILTER ({f} IS NOT NULL) AS {f}" for f in KNOWN)} FROM derived GROUP BY 1, 2) v USING (code, date)) k USING (code, date)"""
FUNDAMENTALS = {"facts": FACTS, "derived": DERIVED, "pit": PIT}


def known(spark, d):
    return fundamentals.as_of(src.panel(spark, d), fundamentals.derived(facts(spark, d)), KNOWN)


@query("facts_as_of", "SELECT code, date, round(roe, 6) AS roe, round(profit4, 2) AS profit4, round(revenue_yoy, 6) AS revenue_yoy, round(roe_ttm, 6) AS roe_ttm FROM pit", **FUNDAMENTALS)
def facts_as_of(spark, d):
    return known(spark, d).select("code", "date", F.round("roe", 6).alias("roe"), F.round("profit4", 2).alias("profit4"), *r6("revenue_yoy", "roe_ttm"))


@query(
    "factors_fundamental",
    """SELECT code, date, round(roe, 6) AS roe, round(CASE WHEN asset_to_equity > 0 THEN roe / asset_to_equity END, 6) AS roa, round(gross_margin, 6) AS gross_margin, round(net_margin, 6) AS net_margin, round(revenue_yoy, 6) AS revenue_yoy,
         round(CASE WHEN profit4 > 0 THEN close * total_share / profit4 END, 6) AS pe, round(CASE WHEN equity > 0 THEN close * total_share / equity END, 6) AS pb, round(close * total_share, 2) AS market_cap,
         round(ln(CASE WHEN close * total_share > 0 THEN close * total_share END), 6) AS log_market_cap, round(yoy_ni, 6) AS netprofit_yoy, round(yoy_asset, 6) AS asset_yoy, round(yoy_eps, 6) AS eps_yoy, round(debt_to_asset, 6) AS debt_to_asset,
         round(cfo_to_np, 6) AS cfo_to_np, round(eps_ttm / nullif(close, 0), 8) AS ep, round(1 / nullif(CASE WHEN eps_ttm > 0 THEN close / eps_ttm END * CASE WHEN roe_ttm > 0 THEN roe_ttm END, 0), 6) AS bp FROM pit""",
    **FUNDAMENTALS,
)
def factors_fundamental(spark, d):
    found = fundamentals.factors(known(spark, d))
    places = {"market_cap": 2, "ep": 8}
    return found.select("code", "date", *(F.round(c, places.get(c, 6)).alias(c) for c in found.columns[2:]))


# triggers, verdicts, metrics


def judged(spark, d):
    rows = indicators.triggers(indicators.with_indicators(src.bars(spark, d)))
    return rows.withColumn("daily_score", indicators.score()).withColumn("verdict", indicators.verdict(F.col("daily_score")))


INDICATED = "SELECT b.*, i.* EXCLUDE (code, date) FROM bars b JOIN (" + as_sql("SELECT * FROM bars", indicators.indicators(), rounded=False) + ") i USING (code, date)"
LAGGED = "SELECT *, " + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("ma5", "ma20", "dif", "dea", "hist", "k", "d", "close", "lower", "upper")) + ", lag(hist, 2) OVER w AS p2, lag(hist, 3) OVER w AS p3 FROM indicated WINDOW w AS (PARTITION BY code ORDER BY date)"
RULES = {
    "ma_golden_cross": "p_ma5 <= p_ma20 AND ma5 > ma20", "ma_dead_cross": "p_ma5 >= p_ma20 AND ma5 < ma20", "ma_bull_alignment": "ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60", "ma_bear_alignment": "ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60",
    "macd_golden_above": "p_dif <= p_dea AND dif > dea AND dif > 0", "macd_golden_below": "p_dif <= p_dea AND dif > dea AND dif <= 0", "macd_dead": "p_dif >= p_dea AND dif < dea",
    "hist_expanding_up": "hist > 0 AND hist > p_hist AND p_hist > p2 AND p3 IS NOT NULL", "hist_expanding_down": "hist < 0 AND hist < p_hist AND p_hist < p2 AND p3 IS NOT NULL",
    "kdj_golden_oversold": "p_k <= p_d AND k > d AND j < 20", "kdj_dead_overbought": "p_k >= p_d AND k < d AND j > 80", "rsi_oversold": "rsi6 < 20", "rsi_overbought": "rsi6 > 80",
    "boll_lower_reentry": "p_close < p_lower AND close >= lower", "boll_upper_reentry": "NOT coalesce(p_close < p_lower AND close >= lower, false) AND p_close > p_upper AND close <= upper",
    "volume_up": "volume_ratio > 1.5 AND close > open", "volume_down": "volume_ratio > 1.5 AND close < open",
}
JUDGED = f"""SELECT code, date, close, types, daily_score, CASE WHEN daily_score >= 6 THEN 'strong_buy' WHEN daily_score >= 2 THEN 'buy' WHEN daily_score <= -6 THEN 'strong_sell' WHEN daily_score <= -2 THEN 'sell' ELSE 'neutral' END AS verdict FROM (
  SELECT code, date, close, concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}) AS types,
         greatest(least({" + ".join(f"CASE WHEN {rule} THEN {indicators.TRIGGERS[name][0] * indicators.TRIGGERS[name][1]} ELSE 0 END" for name, rule in RULES.items())}, 10), -10) AS daily_score FROM lagged)"""
JUDGING = {"indicated": INDICATED, "lagged": LAGGED, "judged": JUDGED}


@query("triggers", "SELECT code, date, types, daily_score, verdict FROM judged", **JUDGING)
def triggers(spark, d):
    return judged(spark, d).select("code", "date", F.array_join(F.transform("triggers", lambda t: t["type"]), ",").alias("types"), "daily_score", "verdict")


DIRECTION = "CASE " + " ".join(f"WHEN type = '{n}' THEN {d}" for n, (d, _) in indicators.TRIGGERS.items()) + " END"


@query(
    "hit_rates",
    f"""SELECT type, horizon, count(*) AS n, round(avg(fwd) * 100, 6) AS mean_pct, round(avg(CASE WHEN {DIRECTION} * fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM (
         SELECT unnest(string_split(types, ',')) AS type, horizon, fwd FROM (
           SELECT types, 5 AS horizon, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM judged UNION ALL
           SELECT types, 10, lead(close, 10) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 FROM judged) WHERE fwd IS NOT NULL AND types <> '') GROUP BY type, horizon""",
    **JUDGING,
)
def hit_rates(spark, d):
    return indicators.hit_rates(judged(spark, d)).select("type", "horizon", "n", *r6("mean_pct", "win_rate"))


@query(
    "verdict_buckets",
    """SELECT verdict, coalesce(n, 0) AS n, mean_pct FROM (SELECT unnest(['strong_buy', 'buy', 'neutral', 'sell', 'strong_sell']) AS verdict) LEFT JOIN (
         SELECT verdict, count(*) AS n, round(avg(fwd) * 100, 6) AS mean_pct FROM (SELECT verdict, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM judged) WHERE fwd IS NOT NULL GROUP BY verdict) USING (verdict)""",
    **JUDGING,
)
def verdict_buckets(spark, d):
    return indicators.verdict_buckets(judged(spark, d)).select("verdict", "n", *r6("mean_pct"))


@query("buy_and_hold", "SELECT code, date, round(close / nullif(first_value(open) OVER (PARTITION BY code ORDER BY date), 0), 6) AS equity FROM bars")
def buy_and_hold(spark, d):
    return simulate.buy_and_hold(src.bars(spark, d)).select("code", "date", *r6("equity"))


METRICS = """SELECT code, n, round(t, 6) AS total_return, round(CASE WHEN n > 1 AND t > -1 THEN pow(1 + t, 252.0 / n) - 1 ELSE 0 END, 6) AS annual_return, round(dd, 6) AS max_drawdown, round(CASE WHEN n > 2 AND s > 1e-12 THEN m / s * sqrt(252) ELSE 0 END, 6) AS sharpe FROM (
  SELECT code, count(*) AS n, arg_max(e, date) / nullif(arg_min(e, date), 0) - 1 AS t, min(e / peak - 1) AS dd, avg(r - (pow(1.02, 1 / 252.0) - 1)) AS m, stddev_samp(r) AS s FROM (
    SELECT code, date, e, max(e) OVER (PARTITION BY code ORDER BY date) AS peak, e / nullif(lag(e) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM (
      SELECT code, date, close / nullif(first_value(open) OVER (PARTITION BY code ORDER BY date), 0) AS e FROM bars)) GROUP BY code)"""


@query("curve_metrics", METRICS)
def curve_metrics(spark, d):
    return simulate.metrics(simulate.buy_and_hold(src.bars(spark, d)), "code").select("code", "n", *r6("total_return", "annual_return", "max_drawdown", "sharpe"))


@query(
    "lot_sizes",
    """SELECT code, date, round(greatest(least(CASE WHEN s IS NULL THEN 0.25 WHEN s < 1e-12 THEN 0.5 ELSE 0.25 * 0.2 / s END, 0.5), 0.05), 6) AS size FROM (
         SELECT code, date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END * sqrt(252) AS s FROM (
           SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM bars) WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
)
def lot_sizes(spark, d):
    return simulate.lot_size(src.bars(spark, d)).select("code", "date", *r6("size"))


@query(
    "equal_weight_baseline",
    "SELECT date, round(avg(x), 6) AS equity FROM (SELECT date, last_value(close IGNORE NULLS) OVER w / nullif(first_value(close IGNORE NULLS) OVER w, 0) AS x FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY date",
)
def equal_weight_baseline(spark, d):
    return simulate.equal_weight_baseline(src.panel(spark, d)).select("date", *r6("equity"))


# simulators


def signals(spark, d):
    """A moving-average cross on the bars that there are: enter above, leave below, reset on a new cross."""
    along = Window.partitionBy("code").orderBy("date")
    mean = lambda n: F.when(F.count("close").over(along.rowsBetween(1 - n, 0)) == n, F.avg("close").over(along.rowsBetween(1 - n, 0)))
    rows = src.bars(spark, d).withColumn("above", F.coalesce(mean(5) > mean(20), F.lit(False)))
    fresh = F.col("above") & ~F.coalesce(F.lag("above").over(along), F.lit(False))
    return rows.withColumns({"enter": F.col("above"), "leave": ~F.col("above"), "reset": fresh}).drop("above")


@query("simulate_single")
def simulate_single(spark, d):
    return simulate.single(signals(spark, d), [5, 10]).select("code", "hold", "date", *r6("equity"), "position", "trades")


@query("simulate_lots")
def simulate_lots(spark, d):
    own = simulate.lot_size(src.bars(spark, d)).select("code", "date", "size")
    return simulate.lots(signals(spark, d).join(own, ["code", "date"])).select("code", "date", *r6("equity"), "position", *r6("cash"))


def staggered(spark, d, k: int = 10, every: int = 5):
    """The momentum portfolio from each of the offsets: which codes are chosen, and the quotes of those."""
    own = src.panel(spark, d)
    days = own.select("date").distinct().withColumn("didx", F.row_number().over(Window.orderBy("date")) - 1)
    offsets = spark.range(every).select(F.col("id").cast("int").alias("offset"))
    best = scores(spark, d).where("score is not null").withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "code"))).where(F.col("place") <= k)
    chosen = simulate.targets(best.join(days, "date").crossJoin(offsets), every).select("offset", "didx", "date", "code")
    quotes = own.select("code", "date", "open", "close").join(days, "date").join(chosen.select("offset", "code").distinct(), "code").select("offset", "didx", "date", "code", "open", "close")
    return simulate.portfolio(quotes, chosen)


@query("simulate_portfolio")
def simulate_portfolio(spark, d):
    return staggered(spark, d).select("offset", "date", *r6("equity"), "num_positions", *r6("cash_ratio"))


@query("portfolio_envelope")
def portfolio_envelope(spark, d):
    return simulate.envelope(staggered(spark, d)).select("date", *r6("low", "p25", "median", "p75", "high", "mean"))


TARGETS = """SELECT o AS "offset", date, list_sort(list(code)) AS target_codes, count(*) AS num_target FROM (
    SELECT code, date, didx, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM scores JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS didx FROM (SELECT DISTINCT date FROM panel)) USING (date) WHERE score IS NOT NULL), (SELECT unnest(range(5)) AS o)
  WHERE place <= 10 AND didx >= o AND (didx - o) % 5 = 0 GROUP BY 1, 2"""


@query("rebalance_log", 'SELECT "offset", date, array_to_string(target_codes, \',\') AS target_codes, num_target FROM targets', scores=SCORES, targets=TARGETS)
def rebalance_log(spark, d):
    days = src.panel(spark, d).select("date").distinct().withColumn("didx", F.row_number().over(Window.orderBy("date")) - 1)
    best = scores(spark, d).where("score is not null").withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "code"))).where("place <= 10")
    chosen = simulate.targets(best.join(days, "date").crossJoin(spark.range(5).select(F.col("id").alias("offset"))), 5)
    return chosen.groupBy("offset", "date").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("target_codes"), F.count("*").alias("num_target"))


@query("compare_arms")
def compare_arms(spark, d):
    curves = simulate.single(signals(spark, d), [5, 10])
    arm = lambda h: simulate.metrics(curves.where(F.col("hold") == h), "code")
    found = simulate.compare(arm(5), arm(10), "code", {"total_return": True, "annual_return": True, "max_drawdown": True, "sharpe": True})
    return found.select("metric", *r6("mean_a", "mean_b", "median_a", "median_b", "mean_diff"), "a_wins", "b_wins", "n")


@query("contributions", "SELECT code, round(c, 6) AS contribution, n AS trades, round(abs(c) / nullif(sum(abs(c)) OVER (), 0), 6) AS share FROM (SELECT code, sum(volume / 100 * (close / open - 1)) AS c, count(*) AS n FROM bars WHERE open > 0 GROUP BY code)")
def contributions(spark, d):
    trades = src.bars(spark, d).where("open > 0").select("code", (F.col("volume") / 100).alias("weight"), (F.col("close") / F.col("open") - 1).alias("ret"))
    return simulate.contributions(trades).select("code", *r6("contribution"), "trades", *r6("share"))


# models


def training(spark, d):
    """Factors and labels, with the day on which a label has ended and the embargo has passed."""
    own = labelled(spark, d)
    days = own.select("date").distinct().withColumn("known", F.lead("date", 10).over(Window.orderBy("date")))
    return own.join(days, "date")


NAMES = FACTORS[:4]


@query("walk_forward_scores")
def walk_forward_scores(spark, d):
    return modelling.walk_forward(training(spark, d), NAMES)[0].select("code", "date", *r6("score"))


@query("walk_forward_models")
def walk_forward_models(spark, d):
    return modelling.walk_forward(training(spark, d), NAMES)[1].select("month", "factor", *r6("mean", "sd", "weight"), "n")


@query("score_contributions")
def score_contributions(spark, d):
    rows = training(spark, d)
    found = modelling.top_contributions(rows, modelling.walk_forward(rows, NAMES)[1], NAMES)
    return found.select("code", "date", F.array_join(F.transform("factors", lambda x: x["factor"]), ",").alias("factors"))


@query("score_ic")
def score_ic(spark, d):
    found, _ = modelling.walk_forward(training(spark, d), NAMES)
    both = found.join(labelled(spark, d).select("code", "date", "fwd"), ["code", "date"])
    return analysis.summary(analysis.daily_ic(both, ["score"])).select("factor", "days", *r6("mean_ic", "ic_std", "ic_ir"))


@query(
    "factor_pick",
    f"""SELECT place, factor FROM (WITH RECURSIVE ordered AS (SELECT factor, row_number() OVER (ORDER BY s DESC, factor) AS nth FROM (SELECT factor, avg(abs(ic)) AS s FROM ic GROUP BY factor HAVING count(ic) > 0)),
       near AS (SELECT p.factor AS a, q.factor AS b FROM (SELECT factor, date, ic AS x FROM ic WHERE ic IS NOT NULL) p JOIN (SELECT factor, date, ic AS y FROM ic WHERE ic IS NOT NULL) q USING (date) GROUP BY 1, 2 HAVING abs({CORR}) >= 0.7),
       walk AS (SELECT 0::BIGINT AS nth, []::VARCHAR[] AS held UNION ALL
         SELECT o.nth, CASE WHEN len(w.held) < 3 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.a = o.factor AND list_contains(w.held, n.b)) THEN list_append(w.held, o.factor) ELSE w.held END FROM walk w JOIN ordered o ON o.nth = w.nth + 1)
       SELECT unnest(range(1, len(held) + 1))::INTEGER AS place, unnest(held) AS factor FROM (SELECT held FROM walk ORDER BY nth DESC LIMIT 1))""",
    **IC_TABLES,
)
def factor_pick(spark, d):
    ic = analysis.daily_ic(labelled(spark, d), FACTORS)
    best = analysis.pick(analysis.summary(ic), analysis.ic_correlation(ic), 3)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(best)], "place int, factor string")


@query("factor_registry")
def factor_registry(spark, d):
    from .factors import registry

    return spark.createDataFrame(registry.describe(), "factor string, family string, kinds string")


@query("window_inventory")
def window_inventory(spark, d):
    from .factors import alpha101

    return spark.createDataFrame(alpha101.window_inventory(), "alpha_id string, op string, window int, count_in_alpha int")


# streams


@query(
    "stream_weekly_volume",
    "SELECT code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) AS volume FROM (SELECT " + src.code_sql("l_suppkey") + " AS code, l_shipdate, l_quantity FROM lineitem) GROUP BY 1, 2",
)
def stream_weekly_volume(spark, d):
    """The weekly volumes as a stream that processes all files and stops."""
    path, out = f"{d}/lineitem.parquet", shared.folder(spark, "stream")
    events = ingest.arrivals(spark, f"{path}*", spark.read.parquet(path).schema).select(src.code_of("l_suppkey").alias("code"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("volume"))
    ingest.run_once(ingest.weekly_volume(events), f"{out}/rows", f"{out}/state", "update")
    return ingest.latest(spark, f"{out}/rows", ["code", "w"]).select("code", F.to_date("w.start").alias("date"), "volume")




# verdicts by quantiles, experiments, reshaping, results as text


@query(
    "quantile_verdicts",
    """SELECT code, date, CASE WHEN score IS NULL THEN 'neutral' WHEN score >= a THEN 'strong_buy' WHEN score <= e THEN 'strong_sell' WHEN score >= b THEN 'buy' WHEN score <= c THEN 'sell' ELSE 'neutral' END AS verdict
       FROM scores, (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.7) AS b, quantile_cont(score, 0.3) AS c, quantile_cont(score, 0.1) AS e FROM scores WHERE date < DATE '2000-01-03')""",
    scores=SCORES,
)
def quantile_verdicts(spark, d):
    own = scores(spark, d)
    cuts = ranking.quantiles(own.where("date < '2000-01-03'"), "score", [0.9, 0.7, 0.3, 0.1])
    cuts = cuts.agg(*(F.max(F.when(F.col("share") == q, F.col("score"))).alias(n) for n, q in (("best", 0.9), ("good", 0.7), ("poor", 0.3), ("worst", 0.1))))
    judged = indicators.quantile_verdict(F.col("score"), *map(F.col, ("best", "good", "poor", "worst")))
    return own.crossJoin(F.broadcast(cuts)).select("code", "date", judged.alias("verdict"))  # the cuts are one row


RETURNS = "SELECT date, avg(r) FILTER (code LIKE '600%') AS a, avg(r) FILTER (code LIKE '300%') AS b FROM (SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM panel) GROUP BY date"


def arm_returns(spark, d):
    along = Window.partitionBy("code").orderBy("date")
    own = src.panel(spark, d).withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(along)) - 1)
    return own.groupBy("date").agg(*(F.avg(F.when(F.col("code").startswith(p), F.col("r"))).alias(n) for n, p in (("a", "600"), ("b", "300"))))


@query(
    "subperiod_deltas",
    """SELECT part, n, round(CASE WHEN sb > 1e-12 THEN mb / sb * sqrt(252) ELSE 0 END - CASE WHEN sa > 1e-12 THEN ma / sa * sqrt(252) ELSE 0 END, 6) AS diff FROM (
         SELECT part, count(*) AS n, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM (
           SELECT a, b, ((row_number() OVER (ORDER BY date) - 1) * 3) // count(*) OVER () AS part FROM arms WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY part)""",
    arms=RETURNS,
)
def subperiod_deltas(spark, d):
    return simulate.subperiods(arm_returns(spark, d)).select("part", "n", *r6("diff"))


@query("bootstrap_deltas")
def bootstrap_deltas(spark, d):
    return simulate.bootstrap_sharpe(arm_returns(spark, d)).select("draw", *r6("diff"))


@query("facts_wide", "SELECT stat_date, " + ", ".join(f"max(roe) FILTER (k = {k}) AS c{k}" for k in range(4)) + " FROM (SELECT *, CAST(substr(code, 4) AS INTEGER) AS k FROM facts) GROUP BY stat_date", facts=FACTS)
def facts_wide(spark, d):
    own = fundamentals.derived(facts(spark, d)).select("stat_date", F.concat(F.lit("c"), F.substring("code", 4, 9).cast("int").cast("string")).alias("k"), "roe")
    return own.groupBy("stat_date").pivot("k", [f"c{k}" for k in range(4)]).agg(F.max("roe"))


@query("results_as_json")
def results_as_json(spark, d):
    from .sources import store

    return store.as_json(analysis.summary(analysis.daily_ic(labelled(spark, d), FACTORS)).orderBy("factor"))


@query(
    "index_verdicts",
    "SELECT date, CASE WHEN close > sma AND sma > was THEN 'up' WHEN close < sma AND sma < was THEN 'down' ELSE 'flat' END AS verdict FROM (SELECT date, close, sma, lag(sma, 3) OVER (ORDER BY date) AS was FROM (SELECT date, close, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma FROM idx WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))",
    idx="SELECT date, round(avg(close), 4) AS close FROM bars GROUP BY date",
)
def index_verdicts(spark, d):
    found = analysis.regimes(src.bars(spark, d).groupBy("date").agg(F.round(F.avg("close"), 4).alias("close")), 20, 3)
    return found.select("date", F.when(F.col("regime") == "bull", "up").when(F.col("regime") == "bear", "down").otherwise("flat").alias("verdict"))


@query("fetch_plan", "SELECT code, CASE WHEN last IS NOT NULL THEN CAST(last + 1 AS DATE) END AS since FROM (SELECT code FROM industries) LEFT JOIN (SELECT code, max(date) AS last FROM bars WHERE code NOT LIKE '830%' AND date < DATE '2001-01-01' GROUP BY code) USING (code)")
def fetch_plan(spark, d):
    from .sources import store

    stored = src.bars(spark, d).where("code not like '830%' and date < '2001-01-01'")
    return store.to_fetch(src.industries(spark, d), stored, "2001-08-01")
