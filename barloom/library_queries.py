"""Queries of the stores, global ranks, trades, models and experiments, with their SQL written by hand."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from .factors import library, registry, table
from .market_queries import CORR, FACTORS, IC_TABLES, SCORES, labelled, r6, ranked_sql, scores
from .functions.fields import ret
from .operators import analysis, arms, boosting, cross, gram, library_analysis, pipeline, ranking, series, trades, universe
from .plans.expression import column, evaluate
from .sources import adapters as src
from .sources import shared, store
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


# stores


def stored_table(spark, d) -> str:
    """The weekly bars of a folder as a bucketed catalog table of its own name."""
    name = f"barloom_bars_{hashlib.md5(d.encode()).hexdigest()[:12]}"
    store.save_bars(src.bars(spark, d), name, 32)
    return name


@query(
    "bars_from_store",
    "SELECT code, date, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS ret, min(low) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS low_5, max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS high_20 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)",
)
def bars_from_store(spark, d):
    """Windows along a code over the bucketed table: no exchange stands under them."""
    along = Window.partitionBy("code").orderBy("date")
    own = store.table_bars(spark, stored_table(spark, d))
    ret = F.try_divide("close", F.lag("close").over(along)) - 1
    return own.select("code", "date", F.round(ret, 6).alias("ret"), F.min("low").over(along.rowsBetween(-4, 0)).alias("low_5"), F.max("high").over(along.rowsBetween(-19, 0)).alias("high_20"))


@query(
    "bars_of_codes",
    "SELECT code, date, close FROM bars WHERE code IN (SELECT code FROM bars GROUP BY code ORDER BY sum(volume) DESC, code LIMIT 10)",
)
def bars_of_codes(spark, d):
    """The ten codes of largest volume, read from their buckets alone."""
    name = stored_table(spark, d)
    best = store.table_bars(spark, name).groupBy("code").agg(F.sum("volume").alias("v")).orderBy(F.col("v").desc(), "code").limit(10)
    return store.table_bars(spark, name, [r["code"] for r in best.collect()]).select("code", "date", "close")


ARRIVALS = """SELECT code, date, close, 'a' AS source, 1 AS arrival FROM bars WHERE date < DATE '1996-01-01' UNION ALL
  SELECT code, date, close + 1, 'a', 2 FROM bars WHERE date >= DATE '1995-06-01' AND date < DATE '1999-01-01' AND code NOT LIKE '300%' UNION ALL
  SELECT code, date, close + 2, 'b', 3 FROM bars WHERE code LIKE '688%'"""
MERGED = """SELECT code, date, arg_min(close, arrival) AS close, arg_min(source, arrival) AS source FROM arrivals WHERE code NOT LIKE '688%' OR arrival = 3 GROUP BY code, date"""


def merged_store(spark, d) -> str:
    """A store after three arrivals: the first part, a second that overlaps it (twice, as after a crash), a new source for some codes."""
    path, own = shared.folder(spark, "store"), src.bars(spark, d)
    part = lambda where, more, source: own.where(where).select("code", "date", (F.col("close") + more).alias("close"), F.lit(source).alias("source"))
    second = part("date >= '1995-06-01' and date < '1999-01-01' and code not like '300%'", 1, "a")
    third = part("code like '688%'", 2, "b")
    store.merge(spark, path, part("date < '1996-01-01'", 0, "a"), ["code", "date"])
    store.merge(spark, path, second, ["code", "date"])
    store.merge(spark, path, second, ["code", "date"])
    store.merge(spark, path, third, ["code", "date"], replace=third)
    return path


SCHEMA = "code string, date date, close double, source string"


@query("bars_merged_store", "SELECT * FROM merged", arrivals=ARRIVALS, merged=MERGED)
def bars_merged_store(spark, d):
    return store.current(spark, merged_store(spark, d), SCHEMA)


@query(
    "fetch_states",
    """SELECT code, state, CASE WHEN state IN ('short', 'stale') THEN CAST(last + 1 AS DATE) END AS since FROM (
         SELECT code, last, CASE WHEN last IS NULL THEN 'missing' WHEN source <> 'b' AND code LIKE '000%' THEN 'changed' WHEN n < 60 THEN 'short' WHEN last < DATE '1998-12-28' THEN 'stale' ELSE 'fresh' END AS state
         FROM (SELECT code FROM industries) LEFT JOIN (SELECT code, max(date) AS last, count(*) AS n, max(CASE WHEN code LIKE '000%' THEN source ELSE 'b' END) AS source FROM merged WHERE code NOT LIKE '830%' GROUP BY code) USING (code))""",
    arrivals=ARRIVALS, merged=MERGED,
)
def fetch_states(spark, d):
    own = store.current(spark, merged_store(spark, d), SCHEMA).where("code not like '830%'")
    marked = own.withColumn("source", F.when(F.col("code").startswith("000"), F.col("source")).otherwise("b"))
    return store.states(src.industries(spark, d), marked, "1998-12-28", 60, "b")


@query(
    "quarters_to_load",
    """SELECT code, stat_date FROM (SELECT code FROM industries) CROSS JOIN (SELECT CAST(DATE '2001-07-01' - INTERVAL (3 * k) MONTH - INTERVAL 1 DAY AS DATE) AS stat_date FROM (SELECT unnest(range(16)) AS k))
       WHERE (code, stat_date) NOT IN (SELECT code, CAST(date_trunc('quarter', date) - INTERVAL 1 DAY AS DATE) FROM bars WHERE code NOT LIKE '688%' AND date >= DATE '2001-06-15' - 2000)""",
)
def quarters_to_load(spark, d):
    """What a load of 16 quarters lacks where one that broke off has stored the quarters before bars that are not too old."""
    done = src.bars(spark, d).where("code not like '688%'").select("code", F.date_sub(F.trunc("date", "quarter"), 1).alias("stat_date"), F.col("date").alias("loaded"))
    return store.quarters_to_load(src.industries(spark, d), done, "2001-09-15", max_age_days=2092)


@query("iso_weeks", "SELECT week, count(*) AS bars FROM (SELECT CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS week FROM bars) GROUP BY week")
def iso_weeks(spark, d):
    return src.bars(spark, d).select(store.iso_week("date").alias("week")).groupBy("week").agg(F.count("*").alias("bars"))


# global ranks and quantiles


@query("global_ranks", "SELECT code, date, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0 AS volume_rank, rank() OVER (PARTITION BY substr(code, 1, 3) ORDER BY close) AS close_rank FROM bars")
def global_ranks(spark, d):
    own = src.bars(spark, d).select("code", "date", "volume", "close", F.substring("code", 1, 3).alias("prefix"))
    least = ranking.placed(own, "close", ["prefix"]).select("prefix", "close", (F.col("before") + 1).alias("close_rank"))
    return ranking.mean_ranks(own, "volume", "volume_rank").join(least, ["prefix", "close"]).select("code", "date", "volume_rank", "close_rank")


SHARES = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@query("global_quantiles", " UNION ALL ".join(f"SELECT substr(code, 1, 3) AS prefix, CAST({q} AS DOUBLE) AS share, round(quantile_cont(volume, {q}), 6) AS volume FROM bars GROUP BY 1" for q in SHARES))
def global_quantiles(spark, d):
    own = src.bars(spark, d).select(F.substring("code", 1, 3).alias("prefix"), "volume")
    return ranking.quantiles(own, "volume", SHARES, ["prefix"]).select("prefix", "share", *r6("volume"))


# trades

POSITIONS = """SELECT code, date, open, close, coalesce(lag(f > s) OVER (PARTITION BY code ORDER BY date), false) AS position FROM (
  SELECT *, CASE WHEN count(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 THEN avg(close) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS f,
         CASE WHEN count(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS s FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))"""
TRADES = """SELECT code, min(date) AS entry, arg_max_null(n, date) AS exit, count(*) AS bars, arg_min(open, date) AS p, arg_max(coalesce(no, close), date) AS q FROM (
  SELECT *, nth - row_number() OVER (PARTITION BY code ORDER BY date) AS island FROM (
    SELECT *, lead(date) OVER w AS n, lead(open) OVER w AS no, row_number() OVER w AS nth FROM positions WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE position) GROUP BY code, island"""


def crossed(rows, fast: int, slow: int):
    """rows with position: held on the bar after one that closes with a fast mean above a slow one."""
    along = Window.partitionBy("code").orderBy("date")
    mean = lambda n: F.when(F.count("close").over(along.rowsBetween(1 - n, 0)) == n, F.avg("close").over(along.rowsBetween(1 - n, 0)))
    own = rows.withColumn("above", mean(fast) > mean(slow))
    return own.withColumn("position", F.coalesce(F.lag("above").over(along), F.lit(False))).drop("above")


def positions(spark, d):
    return crossed(src.bars(spark, d), 5, 20)


@query("trade_list", "SELECT code, entry, max(exit) AS exit, max(bars) AS bars, round(max(q / nullif(p, 0)) - 1, 6) AS ret FROM trades GROUP BY code, entry", positions=POSITIONS, trades=TRADES)
def trade_list(spark, d):
    return trades.trades(positions(spark, d)).select("code", "entry", "exit", "bars", *r6("ret"))


@query(
    "trade_statistics",
    """SELECT code, count(exit) AS trades, count(*) - count(exit) AS open_trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (exit IS NOT NULL), 6) AS win_rate, round(avg(r) FILTER (exit IS NOT NULL) * 100, 6) AS mean_pct,
       round(max(r) FILTER (exit IS NOT NULL) * 100, 6) AS best_pct, round(min(r) FILTER (exit IS NOT NULL) * 100, 6) AS worst_pct, round(avg(bars) FILTER (exit IS NOT NULL), 6) AS mean_bars FROM (SELECT *, q / nullif(p, 0) - 1 AS r FROM trades) GROUP BY code""",
    positions=POSITIONS, trades=TRADES,
)
def trade_statistics(spark, d):
    return trades.statistics(trades.trades(positions(spark, d))).select("code", "trades", "open_trades", *r6("win_rate", "mean_pct", "best_pct", "worst_pct", "mean_bars"))


# the whole library: one family of more than a hundred factors

LIBRARY = registry.names("gtja191")
LIBRARY_LONG = " UNION ALL ".join(
    f"SELECT factor, code, date, value FROM (UNPIVOT (SELECT * FROM f{k}) ON {', '.join(batch)} INTO NAME factor VALUE value)" for k, batch in enumerate(library.batches("gtja191"))
)
LIBRARY_PARTS = {f"f{k}": library.factors_sql("SELECT * FROM panel", batch) for k, batch in enumerate(library.batches("gtja191"))}
LIBRARY_IC = f"""SELECT factor, date, CASE WHEN NOT bad AND count(x) >= 2 AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12 THEN {CORR} END AS ic, any_value(bad) AS degenerate FROM (
  SELECT factor, date, bad, {ranked_sql("x", "factor, date")} AS x, {ranked_sql("y", "factor, date")} AS y FROM (
    SELECT factor, date, bad, CASE WHEN fwd IS NOT NULL THEN round(least(greatest(v, lo), hi), 9) END AS x, fwd AS y FROM (
      SELECT factor, date, round(value, 9) AS v, fwd, quantile_cont(round(value, 9), 0.01) OVER w AS lo, quantile_cont(round(value, 9), 0.99) OVER w AS hi
      FROM library JOIN labels_of USING (code, date) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY factor, date)) JOIN (
      SELECT factor, date, count(DISTINCT round(value, 9))::DOUBLE / count(*) <= 0.01 OR count(*)::DOUBLE / max(held) < 0.05 AS bad FROM library JOIN (SELECT date, count(close) AS held FROM panel GROUP BY date) USING (date) WHERE value IS NOT NULL GROUP BY factor, date) USING (factor, date)))
  GROUP BY factor, date, bad"""
LIBRARY_TABLES = {**LIBRARY_PARTS, "library": LIBRARY_LONG, "labels_of": "SELECT code, date, close, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM panel", "lic": LIBRARY_IC}


def library_panel(spark, d):
    """The stored panel with its labels, which every batch of the family reads."""
    return table.stored_panel(analysis.forward_return(src.panel(spark, d), 5))


@query(
    "library_summary",
    """SELECT factor, days, round(m, 6) AS mean_ic, round(s, 6) AS ic_std, round(CASE WHEN s > 1e-12 THEN m / s END, 6) AS ic_ir, round(a, 6) AS abs_ic_mean, round(g, 6) AS degenerate
       FROM (SELECT factor, count(ic) AS days, avg(ic) AS m, stddev_pop(ic) AS s, avg(abs(ic)) AS a, avg(CASE WHEN degenerate THEN 1.0 ELSE 0.0 END) AS g FROM lic GROUP BY factor)""",
    **LIBRARY_TABLES,
)
def library_summary(spark, d):
    found = library_analysis.summary(table.daily_ic(library_panel(spark, d), LIBRARY))
    return found.where("degenerate is not null").select("factor", "days", *r6("mean_ic", "ic_std", "ic_ir", "abs_ic_mean", "degenerate"))


@query(
    "library_picks",
    """SELECT place, factor FROM (WITH RECURSIVE ordered AS (SELECT factor, row_number() OVER (ORDER BY abs_ic DESC, factor) AS nth FROM (SELECT factor, avg(abs(ic)) AS abs_ic FROM lic GROUP BY factor HAVING count(ic) > 0 AND avg(CASE WHEN degenerate THEN 1.0 ELSE 0.0 END) <= 0.5)),
       near AS (SELECT p.factor AS a, q.factor AS b FROM lic p JOIN lic q USING (date) WHERE p.ic IS NOT NULL AND q.ic IS NOT NULL GROUP BY 1, 2 HAVING abs(covar_pop(p.ic, q.ic) / nullif(stddev_pop(p.ic) * stddev_pop(q.ic), 0)) >= 0.7),
       walk AS (SELECT 0::BIGINT AS nth, []::VARCHAR[] AS held UNION ALL
         SELECT o.nth, CASE WHEN len(w.held) < 10 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.a = o.factor AND list_contains(w.held, n.b)) THEN list_append(w.held, o.factor) ELSE w.held END FROM walk w JOIN ordered o ON o.nth = w.nth + 1)
       SELECT unnest(range(1, len(held) + 1))::INTEGER AS place, unnest(held) AS factor FROM (SELECT held FROM walk ORDER BY nth DESC LIMIT 1))""",
    **LIBRARY_TABLES,
)
def library_picks(spark, d):
    """Two parts analysed apart and merged, all correlations at once, and the ten best of which none is near another."""
    panel = library_panel(spark, d)
    half = len(LIBRARY) // 2
    parts = [table.daily_ic(panel, part) for part in (LIBRARY[: half + 5], LIBRARY[half:])]
    ic = shared.written(library_analysis.merged(parts))
    found = library_analysis.summary(ic)
    best = analysis.pick(found.drop("degenerate"), library_analysis.ic_correlation(ic, LIBRARY), 10, degenerate=found)
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(best)], "place int, factor string")


@query("walk_forward_library")
def walk_forward_library(spark, d):
    """All factors of the family as scores across a day, learnt from the sums of products of each month."""
    parts = table.score_parts(analysis.forward_return(src.panel(spark, d), 5), LIBRARY, also=("fwd",))
    found, _ = gram.walk_forward(table.gathered(parts, ("fwd",)), len(LIBRARY), nulls="zero", days=parts.where("has"))
    return found.select("code", "date", *r6("score"))


@query("walk_forward_hosts")
def walk_forward_hosts(spark, d):
    """Four factors, a refit every 12 bars on the last 8 of such periods, without the rows of the code that is scored."""
    names, panel = ["momentum_5", "momentum_10", "momentum_20", "alpha_101"], src.panel(spark, d)
    labels = analysis.forward_return(panel, 5).select("code", "date", "fwd")
    rows = library.factors(panel, names).join(labels, ["code", "date"]).select("code", "date", "fwd", F.array(*names).alias("x"))
    found, _ = gram.walk_forward(rows, len(names), every=12, window=8, exclude_host=True)
    return found.select("code", "date", *r6("score"))


# boosted trees, and both steps as estimators: learnt from the days before a cut, told for the days from then on

CUT = "2000-01-03"
TREE_FACTORS = registry.names("technical") + registry.names("statistics")


def tree_rows(spark, d):
    """Labels come with the panel: a join with them would be as large as the panel on both sides."""
    return shared.written(library.factors(analysis.forward_return(src.panel(spark, d), 5), TREE_FACTORS, also=("fwd",)))


@query("boosted_pick")
def boosted_pick(spark, d):
    """The factors of largest gain, at most 20, with a hundredth of the first one's or more."""
    trees = boosting.grow(tree_rows(spark, d).where(F.col("date") < CUT), TREE_FACTORS)
    return spark.createDataFrame([(k + 1, n, float(v)) for k, (n, v) in enumerate(boosting.picked(trees))], "place int, factor string, gain double")


@query("boosted_contributions")
def boosted_contributions(spark, d):
    """The eight factors that move each score most, with the score."""
    rows = tree_rows(spark, d)
    trees = boosting.grow(rows.where(F.col("date") < CUT), TREE_FACTORS)
    later = rows.where(F.col("date") >= CUT)
    return boosting.explained(later, trees, ["code", "date"], 8).select("code", "date", "nth", "factor", *r6("part", "score"))


WHOLE = f"SELECT code, date, fwd, {', '.join(FACTORS)} FROM labelled WHERE date < DATE '{CUT}' AND fwd IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in FACTORS)}"
STATS = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, (SELECT avg({f}) FROM whole) AS mean, (SELECT stddev_pop({f}) FROM whole) AS sd, (SELECT {CORR} FROM (SELECT {ranked_sql('x', '1')} AS x, {ranked_sql('y', '1')} AS y FROM (SELECT round({f}, 9) AS x, fwd AS y FROM whole))) AS ic" for f in FACTORS
)
OF = "(SELECT {} FROM stats WHERE factor = '{}')"
WEIGHED = " + ".join(
    f"coalesce(({f} - {OF.format('coalesce(mean, 0)', f)}) / {OF.format('CASE WHEN sd >= 1e-12 THEN sd ELSE 1 END', f)}, 0) * {OF.format('CASE WHEN size > 1e-12 THEN coalesce(ic, 0) / size ELSE 0.2 END', f)}" for f in FACTORS
)


@query(
    "weigher_scores",
    f"SELECT code, date, round(CASE WHEN coalesce({', '.join(FACTORS)}) IS NOT NULL THEN {WEIGHED} END, 6) AS score FROM labelled WHERE date >= DATE '{CUT}'",
    **IC_TABLES, whole=WHOLE, each=STATS, stats="SELECT *, coalesce(sum(abs(ic)) OVER (), 0) AS size FROM each",
)
def weigher_scores(spark, d):
    """The weigher by rank coefficients alone, on all five factors."""
    rows = shared.written(labelled(spark, d))
    model = pipeline.ICWeigher(names=FACTORS).fit(rows.where(F.col("date") < CUT))
    return model.transform(rows.where(F.col("date") >= CUT)).select("code", "date", *r6("score"))


@query("two_step_scores")
def two_step_scores(spark, d):
    """Lasso chooses, ratios of chunks weigh."""
    rows = shared.written(labelled(spark, d))
    model = pipeline.TwoStep(pipeline.LassoSelector(names=FACTORS), pipeline.IRWeigher(names=FACTORS)).fit(rows.where(F.col("date") < CUT))
    return model.transform(rows.where(F.col("date") >= CUT)).select("code", "date", *r6("score"))


@query("latest_scores")
def latest_scores(spark, d):
    """Each code's last bar by the newest monthly model, saved and read again."""
    rows, path = shared.written(labelled(spark, d)), shared.folder(spark, "models")
    pipeline.Monthly(names=FACTORS).fit(rows).save(path)
    return pipeline.MonthlyModel.load(path).latest(rows).select("code", "date", "model_month", *r6("score"))


# streams of three arrivals


def arrived(spark, d):
    """RUNNING after three arrivals of daily bars, each its own start of the stream: the second repeats the 30 days before
    it and lacks some codes, the third brings those, and once more what some codes had long before."""
    path, own = shared.folder(spark, "stream"), shared.written(src.bars(spark, d, "day"))
    own = own.select("code", "date", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
    arrivals = (
        own.where("date < '1996-01-10'"),
        own.where("date >= '1995-12-11' and date < '1999-03-04' and code not like '300%'"),
        own.where("date >= '1999-03-04' or (code like '300%' and date >= '1996-01-10') or (code like '688%' and date < '1995-06-01')"),
    )
    for k, rows in enumerate(arrivals):
        rows.coalesce(4).write.parquet(f"{path}/in/{k}")
        ingest.run_once(ingest.running_weeks(ingest.arrivals(spark, f"{path}/in/*", own.schema)), f"{path}/out", f"{path}/state")
    return spark.read.schema(ingest.RUNNING).parquet(f"{path}/out")


@query(
    "stream_running_weeks",
    """SELECT code, date, week, first_value(open) OVER w AS open, max(high) OVER w AS high, min(low) OVER w AS low, close, sum(volume) OVER w AS volume
       FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM daily) WINDOW w AS (PARTITION BY code, week ORDER BY date)""",
    daily=src.DAILY,
)
def stream_running_weeks(spark, d):
    return arrived(spark, d).where("kind = 'accepted'").drop("kind")


@query(
    "stream_left_out",
    """SELECT code, count(*) AS n FROM (
         SELECT code FROM daily WHERE date >= DATE '1995-12-11' AND date < DATE '1996-01-10' AND code NOT LIKE '300%' UNION ALL SELECT code FROM daily WHERE code LIKE '688%' AND date < DATE '1995-06-01') GROUP BY code""",
    daily=src.DAILY,
)
def stream_left_out(spark, d):
    """What came late or again, by code: told, not dropped silently."""
    return arrived(spark, d).where("kind <> 'accepted'").groupBy("code").agg(F.count("*").alias("n"))


# arms

BASE = {"strategy": {"fast": 5, "slow": 20}, "backtest": {"history": {"from": "1995-01-01", "to": "2003-01-01"}, "cost": 0.0}, "stocks": []}
ARMS = {"a": {}, "b": {"strategy": {"fast": 3, "slow": 10}, "backtest": {"cost": 0.001, "history": {"from": "1996-01-01", "to": None}}}, "broken": {"strategy": {"fast": 3}}}


def arm_trades(rows, configuration):
    """The statistics of a moving-average cross by code, less the cost of each trade."""
    backtest, strategy = configuration["backtest"], configuration["strategy"]
    own = rows.where((F.col("date") >= backtest["history"]["from"]) & (F.col("date") < backtest["history"]["to"]))
    done = trades.trades(crossed(own, strategy["fast"], strategy["slow"])).withColumn("ret", F.col("ret") - backtest["cost"])
    return trades.statistics(done).select("code", F.col("trades").cast("double").alias("trades"), "win_rate", "mean_pct")


def arm_sql(fast: int, slow: int, since: str, cost: float) -> str:
    mean = lambda n: f"CASE WHEN count(close) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    return f"""SELECT code, count(exit)::DOUBLE AS trades, avg(CASE WHEN q / nullif(p, 0) - 1 - {cost} > 0 THEN 1.0 ELSE 0.0 END) FILTER (exit IS NOT NULL) AS win_rate, avg(q / nullif(p, 0) - 1 - {cost}) FILTER (exit IS NOT NULL) * 100 AS mean_pct FROM (
      SELECT code, arg_max_null(n, date) AS exit, arg_min(open, date) AS p, arg_max(coalesce(no, close), date) AS q FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY code ORDER BY date) AS island FROM (
          SELECT *, lead(date) OVER v AS n, lead(open) OVER v AS no, row_number() OVER v AS nth, coalesce(lag(f > s) OVER v, false) AS position FROM (
            SELECT *, {mean(fast)} AS f, {mean(slow)} AS s FROM bars WHERE date >= DATE '{since}' AND date < DATE '2003-01-01' WINDOW w AS (PARTITION BY code ORDER BY date)) WINDOW v AS (PARTITION BY code ORDER BY date)) WHERE position) GROUP BY code, island) GROUP BY code"""


def run_arms(spark, d):
    return arms.run(src.bars(spark, d), {name: arms.effective(BASE, arm) for name, arm in ARMS.items()}, arm_trades)


@query(
    "arms_diff",
    " UNION ALL ".join(f"SELECT code, '{m}' AS metric, round(x.{m}, 6) AS a, round(y.{m}, 6) AS b, round(y.{m} - x.{m}, 6) AS diff FROM arm_a x FULL JOIN arm_b y USING (code)" for m in ("trades", "win_rate", "mean_pct")),
    arm_a=arm_sql(5, 20, "1995-01-01", 0.0), arm_b=arm_sql(3, 10, "1996-01-01", 0.001),
)
def arms_diff(spark, d):
    """Two arms over the same bars, and a third that fails and is left out."""
    found, _ = run_arms(spark, d)
    return arms.differences(found, "code", ["trades", "win_rate", "mean_pct"], "a", "b").select("code", "metric", *r6("a", "b", "diff"))


# preprocessing with its switches

SCORED = """SELECT *, CASE WHEN c IS NOT NULL THEN CASE WHEN stddev_pop(c) OVER w < 1e-12 THEN 0 ELSE (c - avg(c) OVER w) / stddev_pop(c) OVER w END END AS z FROM (
  SELECT p.code, p.date, ind_or_unknown AS ind, CASE WHEN p.r IS NOT NULL THEN greatest(least(p.r, quantile_cont(p.r, 0.95) OVER v), quantile_cont(p.r, 0.05) OVER v) END AS c, s FROM (
    SELECT code, date, ind_or_unknown, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r, CASE WHEN volume > 0 THEN ln(volume) END AS s FROM panel) p WINDOW v AS (PARTITION BY date)) WINDOW w AS (PARTITION BY date)"""


@query(
    "cs_switches",
    """SELECT code, date, round(coalesce(yc - b * xc, z), 6) + 0 AS plain, round(coalesce(z - fit, z), 6) + 0 AS fundamental, round(z - avg(z) OVER (PARTITION BY date, ind), 6) + 0 AS contains_mcap FROM (
         SELECT *, sum(yc * xc) OVER w / nullif(sum(xc * xc) OVER w, 0) AS b, CASE WHEN count(y) OVER w >= 10 AND var_pop(x) OVER w > 1e-12 THEN avg(y) OVER w + covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0) * (x - avg(x) OVER w) END AS fit FROM (
           SELECT *, y - avg(y) OVER (PARTITION BY date, ind) AS yc, x - avg(x) OVER (PARTITION BY date, ind) AS xc FROM (
             SELECT *, CASE WHEN s IS NOT NULL THEN z END AS y, CASE WHEN z IS NOT NULL THEN s END AS x FROM scored)) WINDOW w AS (PARTITION BY date))""",
    scored=SCORED,
)
def cs_switches(spark, d):
    """One factor as each of three kinds: free of industry and size, of size alone, of industry alone."""
    size, switches = series.log(column("volume")), {"winsorise": (0.05, 0.95), "least_codes": 5}
    n = src.table(spark, d, "supplier").count()
    kinds = {"plain": (), "fundamental": ("fundamental",), "contains_mcap": ("contains_mcap",)}
    outputs = {name: cross.preprocess(ret, tags, n, size=size, **switches) for name, tags in kinds.items()}
    return evaluate(src.panel(spark, d), outputs, rounded=False).select("code", "date", *((F.round(c, 6) + 0).alias(c) for c in outputs))


# choices that can be filled


@query("open_or_before", "SELECT code, date, coalesce(CASE WHEN volume >= 20 THEN open END, lag(close) OVER (PARTITION BY code ORDER BY date)) AS open FROM bars")
def open_or_before(spark, d):
    """Opens of thin bars count as missing here."""
    own = src.bars(spark, d)
    return universe.open_or_before(own.withColumn("open", F.when(F.col("volume") >= 20, F.col("open")))).select("code", "date", "open")


@query(
    "top_k_fillable",
    """SELECT code, date, score, place FROM (SELECT code, date, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM (
         SELECT *, row_number() OVER (PARTITION BY date, coalesce(ind, 'Unknown') ORDER BY score DESC, code) AS within, max(CASE WHEN ind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS mapped
         FROM scores WHERE score IS NOT NULL AND (code, date) IN (SELECT (code, date) FROM (SELECT code, date, lead(open) OVER (PARTITION BY code ORDER BY date) AS o FROM panel) WHERE o > 0)) WHERE within <= 2 OR mapped = 0) WHERE place <= 10""",
    scores=SCORES,
)
def top_k_fillable(spark, d):
    """The ten best of each day that have an open on the next one."""
    return universe.capped_top(scores(spark, d), 10, 2, "ind", only=universe.fillable(src.panel(spark, d))).select("code", "date", "score", "place")
