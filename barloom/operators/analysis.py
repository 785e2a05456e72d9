"""Factor quality: labels, information coefficients, summaries, regimes and selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import ranking


def by_code():
    return Window.partitionBy("code").orderBy("date")


def forward_return(panel: DataFrame, h: int, basis: str = "close", mask: str | None = None) -> DataFrame:
    """panel with fwd: close to close, or open to open from the next row on; with a mask both ends must be tradable."""
    ahead = lambda c, k: F.lead(c, k).over(by_code())
    value = F.try_divide(ahead("close", h), F.col("close")) - 1 if basis == "close" else F.try_divide(ahead("open", h + 1), ahead("open", 1)) - 1
    if mask:
        start, end = (0, h) if basis == "close" else (1, h + 1)
        value = F.when((F.col(mask) if not start else ahead(mask, start)) & ahead(mask, end), value)
    return panel.withColumn("fwd", value)


def mean_rank(x: Column, among: list) -> Column:
    """1 and up, ties at their mean, over valid x."""
    at = Window.partitionBy(*among).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(at) + (F.count(x).over(at.rangeBetween(0, 0)) - 1) / 2)


def correlated(x: Column, y: Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def unpivot(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return rows.unpivot(keys, names, "factor", "value")


def daily_ic(rows: DataFrame, names: list[str], method: str = "spearman") -> DataFrame:
    """factor, date, ic, over the codes with a value and a forward return; NULL under two of them or without spread.

    rows: code, date, fwd and the factors. Factors are rows here, so one shuffle by (factor, date) serves them all.
    """
    pairs = unpivot(rows, names, ["code", "date", "fwd"]).withColumn("value", F.round("value", 9))
    pairs = pairs.withColumns({"x": F.when(F.col("fwd").isNotNull(), F.col("value")), "y": F.when(F.col("value").isNotNull(), F.col("fwd"))})
    if method == "spearman":
        pairs = pairs.withColumns({"x": mean_rank(F.col("x"), ["factor", "date"]), "y": mean_rank(F.col("y"), ["factor", "date"])})
    spread = (F.count("x") >= 2) & (F.stddev_pop("x") >= 1e-12) & (F.stddev_pop("y") >= 1e-12)
    return pairs.groupBy("factor", "date").agg(F.when(spread, correlated(F.col("x"), F.col("y"))).alias("ic"))


def summary(ic: DataFrame) -> DataFrame:
    """factor, days, mean_ic, ic_std, ic_ir, abs_ic_mean."""
    found = ic.groupBy("factor").agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("ic_std"), F.avg(F.abs("ic")).alias("abs_ic_mean"))
    return found.withColumn("ic_ir", F.when(F.col("ic_std") > 1e-12, F.col("mean_ic") / F.col("ic_std")))


def half_life(ic: DataFrame, most: float = 252.0, least: int = 10) -> DataFrame:
    """factor, half_life, from the persistence of the series; NULL where it is not between 0 and 1 or the series is short."""
    before = F.lag("ic").over(Window.partitionBy("factor").orderBy("date"))
    found = ic.where("ic is not null").withColumn("before", before).groupBy("factor")
    found = found.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("ic") * F.col("before")), F.sum(F.col("before") * F.col("before"))).alias("rho"))
    life = F.least(F.lit(math.log(0.5)) / F.ln("rho"), F.lit(most))
    return found.select("factor", "rho", F.when((F.col("n") >= least) & (F.col("rho") > 0) & (F.col("rho") < 1), life).alias("half_life"))


def newey_west(ic: DataFrame, lag: int = 5) -> DataFrame:
    """factor, nw_std: the spread of the series with Bartlett-weighted autocovariances."""
    clean = ic.where("ic is not null").withColumn("d", F.col("ic") - F.avg("ic").over(Window.partitionBy("factor")))
    along = Window.partitionBy("factor").orderBy("date")
    clean = clean.withColumns({f"l{k}": F.col("d") * F.lag("d", k).over(along) for k in range(1, lag + 1)})
    total = F.sum(F.col("d") * F.col("d"))
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"l{k}"), F.lit(0.0))
    return clean.groupBy("factor").agg(F.sqrt(F.greatest(total / F.count("*"), F.lit(0.0))).alias("nw_std"))


def ic_correlation(ic: DataFrame) -> DataFrame:
    """a, b, corr for every pair of factors, over the days that both have; 0 where there is none, 1 with itself.

    The series are a row a factor and day, so the join on the day makes as many rows as there are pairs of factors.
    """
    own = ic.where("ic is not null")
    pairs = own.select(F.col("factor").alias("a"), "date", F.col("ic").alias("x")).join(own.select(F.col("factor").alias("b"), "date", F.col("ic").alias("y")), "date")
    return pairs.groupBy("a", "b").agg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(correlated(F.col("x"), F.col("y")), F.lit(0.0))).alias("corr"))


def regimes(index: DataFrame, n: int = 60, slope: int = 5) -> DataFrame:
    """date, regime of an index series (date, close): bull above a rising mean, bear below a falling one, else sideways."""
    along = Window.orderBy("date")
    last = along.rowsBetween(-(n - 1), 0)
    marked = index.withColumn("sma", F.when(F.count("close").over(last) == n, F.avg("close").over(last))).withColumn("was", F.lag("sma", slope).over(along))
    bull = (F.col("close") > F.col("sma")) & (F.col("sma") > F.col("was"))
    bear = (F.col("close") < F.col("sma")) & (F.col("sma") < F.col("was"))
    return marked.select("date", F.when(F.col("was").isNotNull() & F.col("close").isNotNull(), F.when(bull, "bull").when(bear, "bear").otherwise("sideways")).alias("regime"))


def regime_ic(ic: DataFrame, regimes: DataFrame, least: int = 5) -> DataFrame:
    found = ic.join(regimes, "date").where("ic is not null and regime is not null")
    return found.groupBy("factor", "regime").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("days")).where(F.col("days") >= least)


def degenerate_days(rows: DataFrame, names: list[str]) -> DataFrame:
    """factor, degenerate: the share of usable days on which nearly all values are one, or nearly none is there."""
    values = unpivot(rows, names, ["code", "date", "close"])
    days = values.groupBy("factor", "date").agg(F.count("value").alias("n"), F.countDistinct("value").alias("distinct"), F.count("close").alias("held")).where("n > 0")
    bad = (F.col("distinct") / F.col("n") <= 0.01) | (F.try_divide(F.col("n"), F.col("held")) < 0.05)
    return days.groupBy("factor").agg(F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("degenerate"))


def pick(metrics: DataFrame, correlations: DataFrame, n: int, most: float = 0.7, score: str = "abs_ic_mean", least_ir: float = 0.0, degenerate: DataFrame | None = None, most_degenerate: float = 0.5) -> list[str]:
    """Names of the n best factors (by the size of score) of which none correlates by most or more with one before it.

    Factors with an ir of a size below least_ir, or with too large a share of degenerate days, are passed over. metrics and
    correlations are one row a factor and a pair of factors; the factor library bounds both.
    """
    own = metrics.where(F.col(score).isNotNull() & (F.coalesce(F.abs("ic_ir"), F.lit(0.0)) >= least_ir))
    if degenerate is not None:
        own = own.join(degenerate.select("factor", "degenerate"), "factor", "left").where(F.coalesce("degenerate", F.lit(0.0)) <= most_degenerate)
    order = [r["factor"] for r in own.orderBy(F.abs(score).desc(), "factor").select("factor").collect()]
    near = {(r["a"], r["b"]) for r in correlations.where(F.abs("corr") >= most).select("a", "b").collect()}
    out: list[str] = []
    for name in order:
        if len(out) < n and not any((name, held) in near for held in out):
            out.append(name)
    return out


def standardise(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with the factors as scores over the whole set, and the (factor, mean, std) table behind them."""
    stats = unpivot(rows, names, ["code", "date"]).groupBy("factor").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    stats = stats.withColumn("std", F.when(F.col("std") < 1e-12, 1.0).otherwise(F.col("std")))
    scored = unpivot(rows, names, ["code", "date"]).join(F.broadcast(stats), "factor").select("factor", "code", "date", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z"))
    return scored, stats


def pooled_ic(rows: DataFrame, names: list[str], method: str = "spearman") -> DataFrame:
    """factor, ic over all rows at once, by mean ranks (or by values); no task holds a factor."""
    pairs = unpivot(rows.where("fwd is not null"), names, ["code", "date", "fwd"]).where("value is not null")
    pairs = pairs.select("factor", F.round("value", 9).alias("value"), "fwd")
    if method == "spearman":
        pairs = written(pairs)
        pairs = ranking.mean_ranks(ranking.mean_ranks(pairs, "value", "x", ["factor"]), "fwd", "y", ["factor"])
    else:
        pairs = pairs.select("factor", F.col("value").alias("x"), F.col("fwd").alias("y"))
    return pairs.groupBy("factor").agg(correlated(F.col("x"), F.col("y")).alias("ic"))


def ic_weights(ic: DataFrame, least: float = 0.0) -> DataFrame:
    """factor, weight: the coefficients that are large enough, scaled to a sum of sizes of one; equal ones if none is."""
    kept = ic.withColumn("own", F.when(F.abs("ic") >= least, F.col("ic")).otherwise(0.0))
    everything = Window.partitionBy()
    total, n = F.sum(F.abs("own")).over(everything), F.count("*").over(everything)
    return kept.select("factor", F.when(total > 1e-12, F.col("own") / total).otherwise(1 / n).alias("weight"))


def chunk_ir(rows: DataFrame, names: list[str], chunks: int = 4, method: str = "spearman") -> DataFrame:
    """factor, ir: mean over spread of the coefficients of equal chunks of the rows in order of code and date.

    A row's number is the count of rows of the codes before its own (from a table of a row a factor and code) and its
    number within the code, so that no window holds a whole factor.
    """
    pairs = unpivot(rows.where("fwd is not null"), names, ["code", "date", "fwd"]).where("value is not null").withColumn("value", F.round("value", 9))
    counts, over = pairs.groupBy("factor", "code").agg(F.count("*").alias("own")), Window.partitionBy("factor")
    before = F.coalesce(F.sum("own").over(over.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("factor", "code", before.alias("before"), F.sum("own").over(over).alias("n"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("factor", "code").orderBy("date"))
    placed = pairs.join(counts, ["factor", "code"]).withColumn("chunk", F.floor((nth * chunks - 1) / F.col("n")))
    rank = (lambda c: mean_rank(F.col(c), ["factor", "chunk"])) if method == "spearman" else F.col
    ranked = placed.select("factor", "chunk", rank("value").alias("x"), rank("fwd").alias("y"))
    per = ranked.groupBy("factor", "chunk").agg(F.coalesce(correlated(F.col("x"), F.col("y")), F.lit(0.0)).alias("ic"))
    return per.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"), F.when(F.stddev_pop("ic") >= 1e-12, F.avg("ic") / F.stddev_pop("ic")).alias("ir"))
