"""Queries of the bar, universe and analysis operators, with their SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .factors import library
from .operators import analysis, universe
from .sources import adapters as src

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = src.with_tables(sql, **more)
        return run

    return add


SHARES = "SELECT code, (row_number() OVER (ORDER BY code) % 7 + 1) * 1000.0 AS shares FROM industries"
LIMIT_SQL = "CASE WHEN substr(code, 1, 3) IN ('300', '301', '688') THEN 0.198 WHEN substr(code, 1, 2) IN ('82', '83', '87', '43') THEN 0.298 ELSE 0.098 END"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("bars_weekly", "SELECT code, date, open, high, low, close, volume FROM bars")
def bars_weekly(spark: SparkSession, d: str) -> DataFrame:
    return src.bars(spark, d)


@query("panel_grid", "SELECT code, date, close, is_bar, solo FROM panel")
def panel_grid(spark, d):
    return src.panel(spark, d).select("code", "date", "close", "is_bar", "solo")


@query("bars_recent", "SELECT code, date, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 30")
def bars_recent(spark, d):
    return universe.recent(src.bars(spark, d), 30).select("code", "date", "close")


@query(
    "bars_normalised",
    """SELECT code, date, open, close, volume FROM (
         SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY nth) AS k FROM (
           SELECT code, date, open, close, volume, 1 AS nth FROM bars UNION ALL SELECT code, date, close, open, 0.0, 2 FROM bars WHERE volume > 60)) WHERE k = 1""",
)
def bars_normalised(spark, d):
    own = src.bars(spark, d)
    again = own.where("volume > 60").select("code", "date", F.col("close").alias("open"), "high", "low", F.col("open").alias("close"), F.lit(0.0).alias("volume"), F.lit(2).alias("nth"))
    return universe.normalise(own.withColumn("nth", F.lit(1)).unionByName(again), "nth").select("code", "date", "open", "close", "volume")


@query(
    "bars_without_placeholder",
    """SELECT code, count(*) AS bars, max(date) AS last FROM (
         SELECT *, lead(date) OVER (PARTITION BY code ORDER BY date) IS NULL AND volume < 1 AND open = high AND high = low AND low = close AS gone FROM (
           SELECT code, date, open, high, low, close, volume FROM bars UNION ALL
           SELECT code, DATE '2003-01-06', 5.0, 5.0, 5.0, 5.0, 0.0 FROM industries WHERE code LIKE '300%')) WHERE NOT coalesce(gone, false) GROUP BY code""",
)
def bars_without_placeholder(spark, d):
    fake = src.industries(spark, d).where("code like '300%'").select("code", F.lit("2003-01-06").cast("date").alias("date"), *(F.lit(5.0).alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"))
    return universe.without_placeholder(src.bars(spark, d).unionByName(fake)).groupBy("code").agg(F.count("*").alias("bars"), F.max("date").alias("last"))


@query(
    "bars_merged",
    """SELECT code, date, close FROM (
         SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY late) AS k FROM (
           SELECT code, date, close, 0 AS late FROM bars WHERE date < DATE '2000-01-03' UNION ALL
           SELECT code, date, close * 2, 1 FROM bars WHERE date >= DATE '1999-06-07')) WHERE k = 1""",
)
def bars_merged(spark, d):
    own = src.bars(spark, d).select("code", "date", "close")
    fresh = own.where("date >= '1999-06-07'").withColumn("close", F.col("close") * 2)
    return universe.merge(own.where("date < '2000-01-03'"), fresh)


@query("universe_listed", "SELECT DISTINCT code, name FROM industries WHERE (code LIKE '600%' OR code LIKE '000%' OR code LIKE '300%') AND upper(name) NOT LIKE '%ST%'")
def universe_listed(spark, d):
    own = src.industries(spark, d).select("code", "name")
    return universe.listed(own.union(own), ["600", "000", "300"])


@query(
    "ohlcv_validation",
    """SELECT code, CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_volume, CAST(sum(CASE WHEN move > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS large_moves,
              coalesce(max(gap), 0) AS longest_gap, coalesce(max(gap), 0) > 14 AS gappy
       FROM (SELECT code, volume, abs(close / nullif(lag(close) OVER w, 0) - 1) AS move, date - lag(date) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) GROUP BY code""",
)
def ohlcv_validation(spark, d):
    return universe.validate(src.bars(spark, d))


@query(
    "tradability_mask",
    f"""SELECT code, date, coalesce(move < lim, false) AND coalesce(volume > 0, false) AND coalesce(date >= ipo_date + 87, true) AS tradable
       FROM (SELECT code, date, volume, {LIMIT_SQL} AS lim, abs(close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1) AS move FROM panel) LEFT JOIN listings USING (code)""",
)
def tradability_mask(spark, d):
    return universe.tradable(src.panel(spark, d), src.listings(src.bars(spark, d))).select("code", "date", "tradable")


@query(
    "listing_by_first_bar",
    """SELECT code, date, CASE WHEN f IS NULL THEN false WHEN f = 1 THEN true ELSE nth >= f + 60 END AS seasoned FROM (
         SELECT code, date, nth, min(CASE WHEN close IS NOT NULL THEN nth END) OVER (PARTITION BY code) AS f
         FROM (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS nth FROM panel))""",
)
def listing_by_first_bar(spark, d):
    return universe.listed_by_first_bar(src.panel(spark, d)).select("code", "date", "seasoned")


@query(
    "masked_fields",
    f"""SELECT code, date, CASE WHEN t THEN close END AS close, CASE WHEN t THEN volume END AS volume FROM (
         SELECT *, coalesce(abs(close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1) < {LIMIT_SQL}, false) AND coalesce(volume > 0, false) AS t FROM panel)""",
)
def masked_fields(spark, d):
    none = src.listings(src.bars(spark, d)).withColumn("ipo_date", F.lit(None).cast("date"))
    marked = universe.tradable(src.panel(spark, d), none)
    return marked.select("code", "date", *(F.when(F.col("tradable"), F.col(c)).alias(c) for c in ("close", "volume")))


@query(
    "eligibility",
    """SELECT code, date, nth >= 60 AND coalesce(amount >= 50000000, false) AND NOT coalesce(upper(name) LIKE '%ST%', false) AS eligible FROM (
         SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS nth,
                avg(close * volume * 100) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS amount FROM bars) LEFT JOIN industries USING (code)""",
)
def eligibility(spark, d):
    return universe.eligible(src.bars(spark, d), src.industries(spark, d), floor=5e7)


@query("average_amount", "SELECT code, round(avg(close * volume * 100), 2) AS amount, count(*) AS bars FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 20 GROUP BY code")
def average_amount(spark, d):
    return universe.average_amount(src.bars(spark, d)).withColumn("amount", F.round("amount", 2))


def shares(spark, d):
    return src.industries(spark, d).select("code", ((F.row_number().over(Window.orderBy("code")) % 7 + 1) * 1000.0).alias("shares"))


POOL = """SELECT code, name, coalesce(ind, '未知') AS industry, close * shares AS value, amount FROM industries
  LEFT JOIN (SELECT code, arg_max(close, date) AS close FROM bars GROUP BY code) USING (code) LEFT JOIN shares USING (code)
  LEFT JOIN (SELECT code, avg(close * volume * 100) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 20 GROUP BY code) USING (code)
  LEFT JOIN listings USING (code)
  WHERE close * shares IS NOT NULL AND upper(name) NOT LIKE '%ST%' AND name NOT LIKE '%退%' AND ipo_date <= DATE '2001-08-01' - 365 AND amount >= 1000000"""


def pool(spark, d):
    own = src.bars(spark, d)
    return universe.candidates(own, src.industries(spark, d), shares(spark, d), src.listings(own), "2001-08-01")


@query("candidate_pool", "SELECT code, name, industry, round(value, 2) AS value, round(amount, 2) AS amount FROM pool", shares=SHARES, pool=POOL)
def candidate_pool(spark, d):
    return pool(spark, d).withColumns({"value": F.round("value", 2), "amount": F.round("amount", 2)})


@query(
    "candidate_pool_stratified",
    """SELECT code, industry, CASE WHEN v <= 3 AND a <= 3 THEN 'mcap+liq' WHEN v <= 3 THEN 'mcap' ELSE 'liq' END AS source_tag FROM (
         SELECT *, row_number() OVER (PARTITION BY industry ORDER BY value DESC, code) AS v, row_number() OVER (PARTITION BY industry ORDER BY amount DESC, code) AS a FROM pool) WHERE v <= 3 OR a <= 3""",
    shares=SHARES,
    pool=POOL,
)
def candidate_pool_stratified(spark, d):
    return universe.stratified(pool(spark, d)).select("code", "industry", "source_tag")


SCORES = "SELECT code, date, ind, round(close / nullif(lag(close, 20) OVER (PARTITION BY code ORDER BY date), 0) - 1, 9) AS score FROM panel"


def scores(spark, d):
    own = src.panel(spark, d)
    return own.select("code", "date", "ind", F.round(F.try_divide(F.col("close"), F.lag("close", 20).over(universe.by_code())) - 1, 9).alias("score"))


@query(
    "top_k_capped",
    """SELECT code, date, score, place FROM (SELECT code, date, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM (
         SELECT *, row_number() OVER (PARTITION BY date, coalesce(ind, 'Unknown') ORDER BY score DESC, code) AS within, max(CASE WHEN ind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS mapped
         FROM scores WHERE score IS NOT NULL) WHERE within <= 2 OR mapped = 0) WHERE place <= 10""",
    scores=SCORES,
)
def top_k_capped(spark, d):
    return universe.capped_top(scores(spark, d), 10, 2, "ind").select("code", "date", "score", "place")


@query(
    "recommendation_pool",
    """SELECT place AS rank, code, name, coalesce(ind, '未知') AS industry, score AS final_score, in_pool AS is_in_pool_a FROM (
         SELECT *, row_number() OVER (ORDER BY score DESC, code) AS place FROM (
           SELECT *, row_number() OVER (PARTITION BY coalesce(ind, 'Unknown') ORDER BY score DESC, code) AS within FROM (
             SELECT s.code, s.ind, s.score, i.name, a.code IS NOT NULL AS in_pool FROM scores s JOIN industries i USING (code)
             JOIN (SELECT code, avg(close * volume * 100) AS amount, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars) WHERE nth <= 20 GROUP BY code) q USING (code)
             LEFT JOIN pool a USING (code)
             WHERE s.date = (SELECT max(date) FROM scores WHERE score IS NOT NULL) AND s.score IS NOT NULL AND n >= 20 AND q.amount >= 1000000 AND upper(i.name) NOT LIKE '%ST%')) WHERE within <= 2) WHERE place <= 20""",
    shares=SHARES,
    pool=POOL,
    scores=SCORES,
)
def recommendation_pool(spark, d):
    own = scores(spark, d).where("score is not null")
    last = own.join(F.broadcast(own.agg(F.max("date").alias("date"))), "date")
    liquid = universe.average_amount(src.bars(spark, d)).where("bars >= 20 and amount >= 1000000")
    names = src.industries(spark, d).select("code", "name").where(~universe.special(F.col("name")))
    member = pool(spark, d).select("code", F.lit(True).alias("is_in_pool_a"))
    funnel = last.join(liquid, "code").join(names, "code").join(member, "code", "left").withColumn("is_in_pool_a", F.coalesce("is_in_pool_a", F.lit(False)))
    best = universe.capped_top(funnel, 20, 2, "ind")
    return best.select(F.col("place").alias("rank"), "code", "name", F.coalesce("ind", F.lit("未知")).alias("industry"), F.col("score").alias("final_score"), "is_in_pool_a")


@query(
    "limit_rejection",
    """SELECT code, date, coalesce(b > 0 AND open >= b * (1 + lim) * 0.998, false) AS at_upper, coalesce(b > 0 AND open <= b * (1 - lim) * 1.002, false) AS at_lower FROM (
         SELECT code, date, open, lag(close) OVER (PARTITION BY code ORDER BY date) AS b,
                CASE WHEN substr(code, 1, 3) IN ('300', '301', '688') THEN 0.20 WHEN substr(code, 1, 2) IN ('82', '83', '87', '43') THEN 0.30 WHEN upper(name) LIKE '%ST%' THEN 0.05 ELSE 0.10 END AS lim
         FROM bars JOIN industries USING (code))""",
)
def limit_rejection(spark, d):
    own = src.bars(spark, d).withColumn("before", F.lag("close").over(universe.by_code())).join(src.industries(spark, d), "code")
    upper, lower = universe.hits_limit(F.col("open"), F.col("before"), universe.fill_limit(F.col("code"), universe.special(F.col("name"))))
    return own.select("code", "date", upper.alias("at_upper"), lower.alias("at_lower"))


@query(
    "weekly_resample",
    """SELECT code, week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
       FROM (SELECT *, CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week FROM daily) GROUP BY code, week""",
    daily=src.DAILY,
)
def weekly_resample(spark, d):
    return universe.weekly(src.bars(spark, d, "day"))


# labels and factor quality

FACTORS = ["momentum_20", "ma_distance_20", "close_pos_5", "hl_range_20", "alpha_101"]
RAW = library.factors_sql("SELECT * FROM panel", FACTORS)
LABELLED = f"""SELECT f.*, p.close, p.ind, p.ind_or_unknown, lead(p.close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(p.close, 0) - 1 AS fwd FROM ({RAW}) f JOIN panel p USING (code, date)"""
LONG = " UNION ALL ".join(f"SELECT code, date, fwd, close, '{f}' AS factor, round({f}, 9) AS value FROM labelled" for f in FACTORS)
PAIRED = "SELECT factor, date, CASE WHEN fwd IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN fwd END AS y FROM long"


def ranked_sql(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


CORR = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
IC = f"""SELECT factor, date, CASE WHEN count(x) >= 2 AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12 THEN {CORR} END AS ic
  FROM (SELECT factor, date, {ranked_sql("x", "factor, date")} AS x, {ranked_sql("y", "factor, date")} AS y FROM paired) GROUP BY factor, date"""
IC_TABLES = {"labelled": LABELLED, "long": LONG, "paired": PAIRED, "ic": IC}


def labelled(spark, d):
    """The factors with what their panel has: labels come along, as a join with them would have the panel on both sides."""
    more = ("close", "ind", "ind_or_unknown", "fwd")
    return library.factors(analysis.forward_return(src.panel(spark, d), 5), FACTORS, also=more).select("code", "date", *FACTORS, *more)


def ic_table(spark, d):
    return analysis.daily_ic(labelled(spark, d), FACTORS)


@query("forward_return_close", "SELECT code, date, round(lead(close, 5) OVER w / nullif(close, 0) - 1, 6) AS fwd FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)")
def forward_return_close(spark, d):
    return analysis.forward_return(src.panel(spark, d), 5).select("code", "date", *r6("fwd"))


@query(
    "forward_return_open_masked",
    f"""SELECT code, date, round(CASE WHEN lead(t, 1) OVER w AND lead(t, 6) OVER w THEN lead(open, 6) OVER w / nullif(lead(open, 1) OVER w, 0) - 1 END, 6) AS fwd FROM (
         SELECT *, coalesce(abs(close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1) < {LIMIT_SQL}, false) AND coalesce(volume > 0, false) AND coalesce(date >= ipo_date + 87, true) AS t
         FROM panel LEFT JOIN listings USING (code)) WINDOW w AS (PARTITION BY code ORDER BY date)""",
)
def forward_return_open_masked(spark, d):
    marked = universe.tradable(src.panel(spark, d), src.listings(src.bars(spark, d)))
    return analysis.forward_return(marked, 5, "open", "tradable").select("code", "date", *r6("fwd"))


@query("daily_ic", "SELECT factor, date, round(ic, 6) + 0 AS ic FROM ic", **IC_TABLES)
def daily_ic(spark, d):
    return ic_table(spark, d).select("factor", "date", (F.round("ic", 6) + 0).alias("ic"))


@query(
    "daily_ic_pearson",
    f"SELECT factor, date, round(CASE WHEN count(x) >= 2 AND stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12 THEN {CORR} END, 6) AS ic FROM paired GROUP BY factor, date",
    **IC_TABLES,
)
def daily_ic_pearson(spark, d):
    return analysis.daily_ic(labelled(spark, d), FACTORS, "pearson").select("factor", "date", *r6("ic"))


@query(
    "factor_summary",
    """SELECT factor, days, round(m, 6) AS mean_ic, round(s, 6) AS ic_std, round(a, 6) AS abs_ic_mean, round(CASE WHEN s > 1e-12 THEN m / s END, 6) AS ic_ir
       FROM (SELECT factor, count(ic) AS days, avg(ic) AS m, stddev_pop(ic) AS s, avg(abs(ic)) AS a FROM ic GROUP BY factor)""",
    **IC_TABLES,
)
def factor_summary(spark, d):
    return analysis.summary(ic_table(spark, d)).select("factor", "days", *r6("mean_ic", "ic_std", "abs_ic_mean", "ic_ir"))


@query(
    "factor_half_life",
    """SELECT factor, round(rho, 6) AS rho, round(CASE WHEN n >= 10 AND rho > 0 AND rho < 1 THEN least(ln(0.5) / ln(rho), 252.0) END, 6) AS half_life FROM (
         SELECT factor, count(*) AS n, sum(ic * b) / nullif(sum(b * b), 0) AS rho FROM (SELECT factor, ic, lag(ic) OVER (PARTITION BY factor ORDER BY date) AS b FROM ic WHERE ic IS NOT NULL) GROUP BY factor)""",
    **IC_TABLES,
)
def factor_half_life(spark, d):
    return analysis.half_life(ic_table(spark, d)).select("factor", *r6("rho", "half_life"))


@query(
    "factor_newey_west",
    """SELECT factor, round(sqrt(greatest((sum(d * d) + """
    + " + ".join(f"{2 * (1 - k / 6)!r} * coalesce(sum(d * l{k}), 0)" for k in range(1, 6))
    + """) / count(*), 0)), 6) AS nw_std FROM (SELECT *, """
    + ", ".join(f"lag(d, {k}) OVER (PARTITION BY factor ORDER BY date) AS l{k}" for k in range(1, 6))
    + """ FROM (SELECT factor, date, ic - avg(ic) OVER (PARTITION BY factor) AS d FROM ic WHERE ic IS NOT NULL)) GROUP BY factor""",
    **IC_TABLES,
)
def factor_newey_west(spark, d):
    return analysis.newey_west(ic_table(spark, d)).select("factor", *r6("nw_std"))


@query(
    "ic_correlation",
    f"SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE coalesce({CORR}, 0) END, 6) AS corr FROM (SELECT p.factor AS a, q.factor AS b, p.ic AS x, q.ic AS y FROM ic p JOIN ic q USING (date) WHERE p.ic IS NOT NULL AND q.ic IS NOT NULL) GROUP BY a, b",
    **IC_TABLES,
)
def ic_correlation(spark, d):
    return analysis.ic_correlation(ic_table(spark, d)).select("a", "b", *r6("corr"))


INDEX = "SELECT date, round(avg(close), 4) AS close FROM bars GROUP BY date"
REGIMES = """SELECT date, CASE WHEN was IS NOT NULL AND close IS NOT NULL THEN CASE WHEN close > sma AND sma > was THEN 'bull' WHEN close < sma AND sma < was THEN 'bear' ELSE 'sideways' END END AS regime
  FROM (SELECT *, lag(sma, 5) OVER (ORDER BY date) AS was FROM (
    SELECT date, close, CASE WHEN count(close) OVER w = 60 THEN avg(close) OVER w END AS sma FROM idx WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)))"""


def index_series(spark, d):
    return src.bars(spark, d).groupBy("date").agg(F.round(F.avg("close"), 4).alias("close"))


@query("market_regimes", "SELECT date, regime FROM regimes", idx=INDEX, regimes=REGIMES)
def market_regimes(spark, d):
    return analysis.regimes(index_series(spark, d))


@query(
    "regime_ic", "SELECT factor, regime, round(avg(ic), 6) AS mean_ic, count(*) AS days FROM ic JOIN regimes USING (date) WHERE ic IS NOT NULL AND regime IS NOT NULL GROUP BY factor, regime HAVING count(*) >= 5",
    idx=INDEX, regimes=REGIMES, **IC_TABLES,
)
def regime_ic(spark, d):
    return analysis.regime_ic(ic_table(spark, d), analysis.regimes(index_series(spark, d))).select("factor", "regime", *r6("mean_ic"), "days")


@query(
    "degenerate_days",
    """SELECT factor, avg(CASE WHEN u / n <= 0.01 OR n / nullif(h, 0) < 0.05 THEN 1.0 ELSE 0.0 END) AS degenerate FROM (
         SELECT factor, date, count(value)::DOUBLE AS n, count(DISTINCT value)::DOUBLE AS u, count(close)::DOUBLE AS h FROM long GROUP BY factor, date) WHERE n > 0 GROUP BY factor""",
    **IC_TABLES,
)
def degenerate_days(spark, d):
    return analysis.degenerate_days(labelled(spark, d), FACTORS)


@query(
    "standardised",
    """SELECT factor, code, date, round((value - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END, 6) AS z FROM long JOIN (SELECT factor, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY factor) USING (factor)""",
    **IC_TABLES,
)
def standardised(spark, d):
    return analysis.standardise(labelled(spark, d), FACTORS)[0].select("factor", "code", "date", *r6("z"))


POOLED = f"SELECT factor, {CORR} AS ic FROM (SELECT factor, {ranked_sql('value', 'factor')} AS x, {ranked_sql('fwd', 'factor')} AS y FROM long WHERE fwd IS NOT NULL AND value IS NOT NULL) GROUP BY factor"


@query(
    "ic_weights", "SELECT factor, round(CASE WHEN sum(abs(w)) OVER () > 1e-12 THEN w / sum(abs(w)) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM (SELECT factor, CASE WHEN abs(ic) >= 0.002 THEN ic ELSE 0 END AS w FROM pooled)",
    **IC_TABLES, pooled=POOLED,
)
def ic_weights(spark, d):
    return analysis.ic_weights(analysis.pooled_ic(labelled(spark, d), FACTORS), 0.002).select("factor", *r6("weight"))


@query(
    "chunk_ir",
    f"""SELECT factor, round(avg(ic), 6) AS mean_ic, round(stddev_pop(ic), 6) AS std_ic, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ir FROM (
         SELECT factor, {CORR} AS ic FROM (SELECT factor, chunk, {ranked_sql("value", "factor, chunk")} AS x, {ranked_sql("fwd", "factor, chunk")} AS y FROM (
           SELECT *, (row_number() OVER (PARTITION BY factor ORDER BY code, date) * 4 - 1) // count(*) OVER (PARTITION BY factor) AS chunk FROM long WHERE fwd IS NOT NULL AND value IS NOT NULL)) GROUP BY factor, chunk) GROUP BY factor""",
    **IC_TABLES,
)
def chunk_ir(spark, d):
    return analysis.chunk_ir(labelled(spark, d), FACTORS).select("factor", *r6("mean_ic", "std_ic", "ir"))
