"""Queries of the verdicts as of each day, selections and reports, with their SQL written by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .market_queries import CORR, FACTORS, IC_TABLES, labelled, r6, ranked_sql
from .model_queries import JUDGING, METRICS, judged
from .operators import analysis, indicators, library_analysis, selection, simulate, walkforward
from .sources import adapters as src
from .sources import shared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = src.with_tables(sql, **more)
        return run

    return add


@query("combined_verdicts")
def combined_verdicts(spark, d):
    """No SQL: every day's running week makes a series of its own. Tested against those series one by one."""
    return walkforward.verdicts(src.bars(spark, d, "day")).select("code", "date", "open", "close", "verdict", "daily_score", "weekly_score", *r6("final_score"))


@query(
    "verdict_statistics",
    """SELECT verdict, horizon, coalesce(n, 0) AS n, coalesce(sample, 0) AS sample, coalesce(mean_pct, 0) AS mean_pct, coalesce(win_rate, 0) AS win_rate
       FROM (SELECT unnest(['strong_buy', 'buy', 'neutral', 'sell', 'strong_sell']) AS verdict) CROSS JOIN (SELECT unnest([5, 10]) AS horizon)
       LEFT JOIN (SELECT verdict, count(*) AS n FROM judged GROUP BY verdict) USING (verdict)
       LEFT JOIN (SELECT verdict, horizon, count(*) AS sample, round(avg(fwd) * 100, 6) AS mean_pct, round(avg(CASE WHEN verdict LIKE '%sell' THEN CASE WHEN fwd < 0 THEN 1.0 ELSE 0.0 END WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM (
         SELECT verdict, 5 AS horizon, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM judged UNION ALL
         SELECT verdict, 10, lead(close, 10) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 FROM judged) WHERE fwd IS NOT NULL GROUP BY verdict, horizon) USING (verdict, horizon)""",
    **JUDGING,
)
def verdict_statistics(spark, d):
    return indicators.verdict_statistics(judged(spark, d)).select("verdict", "horizon", "n", "sample", *r6("mean_pct", "win_rate"))


@query("bars_after_warmup", "SELECT code, date, close FROM (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS nth, count(*) OVER (PARTITION BY code) AS have FROM bars) WHERE have <= 60 OR nth > 60")
def bars_after_warmup(spark, d):
    return selection.after_warmup(src.bars(spark, d).select("code", "date", "close"), 60)


@query("orders_on_trading_days", "SELECT o_orderdate AS date, count(*) AS orders FROM orders WHERE o_orderdate IN (SELECT date FROM bars) GROUP BY 1")
def orders_on_trading_days(spark, d):
    own = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return selection.on_trading_days(own, src.bars(spark, d)).groupBy("date").agg(F.count("*").alias("orders"))


TEXTS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-02-30') ELSE '' END"


@query("fn_date_text", f"SELECT o_orderkey AS k, CASE WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(t AS DATE) END AS day FROM (SELECT o_orderkey, {TEXTS} AS t FROM orders)")
def fn_date_text(spark, d):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "yyyy/MM/dd")).when(kind == 2, F.concat(F.date_format(day, "yyyy"), F.lit("-02-30"))).otherwise("")
    return src.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), selection.date_of_text(text).alias("day"))


@query(
    "recent_quarters",
    "SELECT code, CAST((q - k) // 4 AS INTEGER) AS year, CAST((q - k) % 4 + 1 AS INTEGER) AS quarter FROM (SELECT code, year(max(date)) * 4 + quarter(max(date)) - 1 AS q FROM bars GROUP BY code) CROSS JOIN (SELECT unnest(range(16)) AS k)",
)
def recent_quarters(spark, d):
    last = src.bars(spark, d).groupBy("code").agg(F.max("date").alias("last"))
    return last.select("code", F.inline(selection.recent_quarters(F.col("last"))))


SPREAD = ("total_return", "annual_return", "max_drawdown", "sharpe")


@query("metric_spread", " UNION ALL ".join(f"SELECT '{m}' AS metric, min({m}) AS low, round(median({m}), 6) AS median, max({m}) AS high FROM curves" for m in SPREAD), curves=METRICS)
def metric_spread(spark, d):
    found = simulate.metrics(simulate.buy_and_hold(src.bars(spark, d)), "code").select("code", *r6(*SPREAD))
    return selection.spread(found, list(SPREAD)).select("metric", "low", F.round("median", 6).alias("median"), "high")


# variants of a factor against their base on two halves of the days

WINDOWS, BASE, CUT = (5, 10, 20, 60), 20, "1998-06-01"
MOMENTA = " UNION ALL ".join(
    f"SELECT code, date, date >= DATE '{CUT}' AS late, close, 'momentum_{n}' AS factor, round(close / nullif(lag(close, {n}) OVER w, 0) - 1, 9) AS value, lead(close, 5) OVER w / nullif(close, 0) - 1 AS fwd FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)" for n in WINDOWS
)
HALVES = f"""SELECT factor, late, avg(abs(ic)) AS a, avg(ic) / nullif(stddev_pop(ic), 0) AS ir, avg(bad) AS degenerate FROM (
  SELECT factor, late, date, CASE WHEN count(x) >= 2 AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12 THEN {CORR} END AS ic FROM (
    SELECT factor, late, date, {ranked_sql("x", "factor, date")} AS x, {ranked_sql("y", "factor, date")} AS y FROM (
      SELECT *, CASE WHEN fwd IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN fwd END AS y FROM momenta)) GROUP BY factor, late, date)
  LEFT JOIN (SELECT factor, date, CASE WHEN count(DISTINCT value) / count(value) <= 0.01 OR count(value) / nullif(count(close), 0) < 0.05 THEN 1.0 ELSE 0.0 END AS bad FROM momenta GROUP BY factor, date HAVING count(value) > 0) USING (factor, date)
  GROUP BY factor, late"""


@query(
    "variant_winners",
    f"""SELECT base, variant, round(gain_abs, 6) AS gain_abs, round(gain_ir, 6) AS gain_ir, coalesce(degenerate <= 0.1 AND gain_abs >= 0.002 AND gain_ir >= 0.01, false) AS passes FROM (
         SELECT b.factor AS base, v.factor AS variant, CASE WHEN count(v.a - b.a) = 2 THEN min(v.a - b.a) END AS gain_abs, CASE WHEN count(v.ir - b.ir) = 2 THEN min(abs(v.ir) - abs(b.ir)) END AS gain_ir, max(coalesce(v.degenerate, 0)) AS degenerate
         FROM halves b JOIN halves v ON b.late = v.late AND b.factor = 'momentum_{BASE}' AND v.factor <> b.factor GROUP BY 1, 2)""",
    momenta=MOMENTA,
    halves=HALVES,
)
def variant_winners(spark, d):
    """Thresholds of a tenth of the defaults, as random prices leave nothing to gain."""
    along, names = Window.partitionBy("code").orderBy("date"), [f"momentum_{n}" for n in WINDOWS]
    own = analysis.forward_return(src.panel(spark, d), 5).select("code", "date", "close", "fwd", *(F.round(F.try_divide(F.col("close"), F.lag("close", n).over(along)) - 1, 9).alias(f"momentum_{n}") for n in WINDOWS))

    def half(rows):
        return analysis.summary(analysis.daily_ic(rows, names)).join(analysis.degenerate_days(rows, names), "factor", "left")

    pairs = spark.createDataFrame([(f"momentum_{BASE}", n) for n in names if n != f"momentum_{BASE}"], "base string, variant string")
    found = selection.winners(half(own.where(F.col("date") < CUT)), half(own.where(F.col("date") >= CUT)), pairs, 0.002, 0.01)
    return found.select("base", "variant", *r6("gain_abs", "gain_ir"), "passes")


# selections

GATED = f"""SELECT place, factor FROM (WITH RECURSIVE
  metrics AS (SELECT factor, avg(abs(ic)) AS a, abs(avg(ic) / nullif(stddev_pop(ic), 0)) AS ir FROM ic GROUP BY factor),
  bad AS (SELECT factor, avg(CASE WHEN u / n <= 0.01 OR n / nullif(h, 0) < 0.05 THEN 1.0 ELSE 0.0 END) AS degenerate FROM (
    SELECT factor, date, count(value)::DOUBLE AS n, count(DISTINCT value)::DOUBLE AS u, count(close)::DOUBLE AS h FROM long GROUP BY factor, date) WHERE n > 0 GROUP BY factor),
  line AS (SELECT factor, row_number() OVER (ORDER BY a DESC, factor) AS spot FROM metrics LEFT JOIN bad USING (factor) WHERE a IS NOT NULL AND ir >= 0.001 AND coalesce(degenerate, 0) <= 0.5),
  near AS (SELECT a, list(b) AS bs FROM (SELECT p.factor AS a, q.factor AS b, p.ic AS x, q.ic AS y FROM ic p JOIN ic q USING (date) WHERE p.ic IS NOT NULL AND q.ic IS NOT NULL AND p.factor <> q.factor) GROUP BY a, b HAVING abs({CORR}) >= 0.6),
  nears AS (SELECT a AS factor, flatten(list(bs)) AS bs FROM near GROUP BY a),
  walk AS (SELECT 0::BIGINT AS spot, []::VARCHAR[] AS held UNION ALL
    SELECT line.spot, CASE WHEN len(held) < 3 AND NOT list_has_any(held, coalesce(bs, []::VARCHAR[])) THEN list_append(held, line.factor) ELSE held END FROM walk JOIN line ON line.spot = walk.spot + 1 LEFT JOIN nears ON nears.factor = line.factor)
  SELECT unnest(range(1, len(held) + 1))::INTEGER AS place, unnest(held) AS factor FROM (SELECT held FROM walk ORDER BY spot DESC LIMIT 1))"""


def chosen(spark, d):
    """A day's codes travel once for the five factors; what is left is a row a factor and day, written and read three times."""
    ic = shared.written(library_analysis.daily_ic_wide(labelled(spark, d), FACTORS, None, also_degenerate=True))
    degenerate = ic.where("usable").groupBy("factor").agg(F.avg(F.col("degenerate").cast("double")).alias("degenerate"))
    best = analysis.pick(analysis.summary(ic), analysis.ic_correlation(ic), 3, 0.6, least_ir=0.001, degenerate=degenerate)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(best)], "place int, factor string")


@query("selection_gated", GATED, **IC_TABLES)
def selection_gated(spark, d):
    return chosen(spark, d)


@query("selection_json", """SELECT '{"factors":[' || string_agg('"' || factor || '"', ',' ORDER BY place) || ']}' AS value FROM gated""", **IC_TABLES, gated=GATED)
def selection_json(spark, d):
    return selection.as_json(chosen(spark, d))


@query(
    "selection_diff",
    f"SELECT coalesce(a.factor, b.factor) AS factor, CASE WHEN a.factor IS NULL THEN 'added' WHEN b.factor IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM (SELECT unnest({FACTORS[:3]!r}) AS factor) a FULL JOIN gated b ON a.factor = b.factor",
    **IC_TABLES,
    gated=GATED,
)
def selection_diff(spark, d):
    return selection.difference(spark.createDataFrame([(f,) for f in FACTORS[:3]], "factor string"), chosen(spark, d))


@query(
    "ir_weights",
    f"""SELECT factor, round(CASE WHEN sum(abs(ir)) OVER () >= 1e-12 THEN ir / sum(abs(ir)) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM (
         SELECT factor, CASE WHEN stddev_pop(ic) < 1e-12 THEN avg(ic) ELSE avg(ic) / stddev_pop(ic) END AS ir FROM (
           SELECT factor, coalesce({CORR}, 0) AS ic FROM (SELECT factor, chunk, {ranked_sql("value", "factor, chunk")} AS x, {ranked_sql("fwd", "factor, chunk")} AS y FROM (
             SELECT *, ((row_number() OVER (PARTITION BY factor ORDER BY code, date)) * 6 - 1) // count(*) OVER (PARTITION BY factor) AS chunk FROM long WHERE fwd IS NOT NULL AND value IS NOT NULL)) GROUP BY factor, chunk) GROUP BY factor)""",
    **IC_TABLES,
)
def ir_weights(spark, d):
    found = analysis.chunk_ir(labelled(spark, d), FACTORS, 6)
    return analysis.ic_weights(found.select("factor", F.coalesce("ir", "mean_ic").alias("ic"))).select("factor", *r6("weight"))
