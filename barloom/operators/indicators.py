"""Indicators of one instrument, rule triggers and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expression import Expression, column, evaluate
from . import series as s

close, high, low, open_, volume = (column(c) for c in ("close", "high", "low", "open", "volume"))


def kdj(n: int = 9, m1: int = 3, m2: int = 3) -> dict[str, Expression]:
    """K, D and J; a missing or flat range counts as 50, the first n - 1 rows have none."""
    bottom = s.ts_min(low, n)
    raw = s.filled((close - bottom) / (s.ts_max(high, n) - bottom) * 100, 50.0)
    k = s.ewm(raw, 1 / m1)
    d = s.ewm(k, 1 / m2)
    seen = s.present(s.delay(s.filled(close, 0.0), n - 1))
    return {"k": s.only(seen, k), "d": s.only(seen, d), "j": s.only(seen, 3 * k - 2 * d)}


def rsi(n: int) -> Expression:
    """50 without any loss; the first n rows have none."""
    change = close - s.delay(close, 1)
    up, down = s.ewm(s.at_least(change, 0.0), 1 / n), s.ewm(s.at_least(-change, 0.0), 1 / n)
    return s.only(s.present(s.delay(close, n)), s.filled(100 - 100 / (1 + up / down), 50.0))


def indicators() -> dict[str, Expression]:
    """Moving averages, MACD, KDJ, RSI, bands, volume ratio and breakout marks."""
    dif = s.ema(close, 12) - s.ema(close, 26)
    dea = s.ema(dif, 9)
    mid, sd = s.mean(close, 20), s.rolling("stddev_pop", close, 20)
    out = {f"ma{n}": s.mean(close, n) for n in (5, 10, 20, 60)}
    out |= {"dif": dif, "dea": dea, "hist": 2 * (dif - dea)} | kdj() | {f"rsi{n}": rsi(n) for n in (6, 12)}
    out |= {"upper": mid + 2 * sd, "mid": mid, "lower": mid - 2 * sd, "volume_ratio": volume / s.delay(s.mean(volume, 5), 1)}
    return out | {"new_high": s.flag(close >= s.ts_max(close, 20)), "new_low": s.flag(close <= s.ts_min(close, 20))}


#: Types of triggers: direction and weight, as fixed.
TRIGGERS = {
    "ma_golden_cross": (1, 2), "ma_dead_cross": (-1, 2), "ma_bull_alignment": (1, 1), "ma_bear_alignment": (-1, 1), "macd_golden_above": (1, 3), "macd_golden_below": (1, 2), "macd_dead": (-1, 3),
    "hist_expanding_up": (1, 1), "hist_expanding_down": (-1, 1), "kdj_golden_oversold": (1, 2), "kdj_dead_overbought": (-1, 2), "rsi_oversold": (1, 1), "rsi_overbought": (-1, 1),
    "boll_lower_reentry": (1, 2), "boll_upper_reentry": (-1, 2), "volume_up": (1, 1), "volume_down": (-1, 1),
}


#: What a trigger reads of the bar before, as p_ columns; and the histogram of two and three bars before.
BEFORE = ("ma5", "ma20", "dif", "dea", "hist", "k", "d", "close", "lower", "upper", "rsi6")


def before() -> dict[str, Expression]:
    """The same as expressions, for rows that come from an evaluation anyway."""
    own = indicators() | {"close": close}
    return {f"p_{c}": s.delay(own[c], 1) for c in BEFORE} | {f"p{k}_hist": s.delay(own["hist"], k) for k in (2, 3)}


def triggers(rows: DataFrame) -> DataFrame:
    """rows (open, close and the indicators) with triggers, an array of (type, direction, weight), all bars at once."""
    along = Window.partitionBy("code").orderBy("date")
    was = lambda c, k=1: F.lag(c, k).over(along)
    before = {f"p_{c}": was(c) for c in BEFORE} | {"p2_hist": was("hist", 2), "p3_hist": was("hist", 3)}
    return rows.withColumns(before).withColumn("triggers", fired()).drop(*before)


def fired() -> Column:
    """The triggers of a bar that has its indicators and those of the bars before."""
    c = F.col
    crossed = lambda a, b: (c(f"p_{a}") <= c(f"p_{b}")) & (c(a) > c(b))
    fell = lambda a, b: (c(f"p_{a}") >= c(f"p_{b}")) & (c(a) < c(b))
    lower_in, upper_in = (c("p_close") < c("p_lower")) & (c("close") >= c("lower")), (c("p_close") > c("p_upper")) & (c("close") <= c("upper"))
    when: dict[str, Column] = {
        "ma_golden_cross": crossed("ma5", "ma20"), "ma_dead_cross": fell("ma5", "ma20"),
        "ma_bull_alignment": (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (c("ma20") > c("ma60")), "ma_bear_alignment": (c("ma5") < c("ma10")) & (c("ma10") < c("ma20")) & (c("ma20") < c("ma60")),
        "macd_golden_above": crossed("dif", "dea") & (c("dif") > 0), "macd_golden_below": crossed("dif", "dea") & (c("dif") <= 0), "macd_dead": fell("dif", "dea"),
        "hist_expanding_up": (c("hist") > 0) & (c("hist") > c("p_hist")) & (c("p_hist") > c("p2_hist")) & c("p3_hist").isNotNull(),
        "hist_expanding_down": (c("hist") < 0) & (c("hist") < c("p_hist")) & (c("p_hist") < c("p2_hist")) & c("p3_hist").isNotNull(),
        "kdj_golden_oversold": crossed("k", "d") & (c("j") < 20), "kdj_dead_overbought": fell("k", "d") & (c("j") > 80), "rsi_oversold": c("rsi6") < 20, "rsi_overbought": c("rsi6") > 80,
        "boll_lower_reentry": lower_in, "boll_upper_reentry": ~F.coalesce(lower_in, F.lit(False)) & upper_in,
        "volume_up": (c("volume_ratio") > 1.5) & (c("close") > c("open")), "volume_down": (c("volume_ratio") > 1.5) & (c("close") < c("open")),
    }
    made = [F.when(test, F.struct(F.lit(name).alias("type"), F.lit(TRIGGERS[name][0]).alias("direction"), F.lit(TRIGGERS[name][1]).alias("weight"))) for name, test in when.items()]
    return F.array_compact(F.array(*made))


def score(triggers: str = "triggers") -> Column:
    """Directions by weights, between -10 and 10."""
    total = F.aggregate(F.col(triggers), F.lit(0), lambda a, t: a + t["direction"] * t["weight"])
    return F.greatest(F.least(total, F.lit(10)), F.lit(-10))


def combined(daily: Column, weekly: Column, share: float = 0.7, bonus: float = 2.0, daily_least: float = 3.0, weekly_least: float = 1.0) -> Column:
    """Both scores by their shares, and a bonus where both go the same way and far enough."""
    agree = F.when((daily >= daily_least) & (weekly >= weekly_least), bonus).when((daily <= -daily_least) & (weekly <= -weekly_least), -bonus).otherwise(0.0)
    return F.greatest(F.least(share * daily + (1 - share) * weekly + agree, F.lit(10.0)), F.lit(-10.0))


def verdict(value: Column) -> Column:
    return F.when(value >= 6, "strong_buy").when(value >= 2, "buy").when(value <= -6, "strong_sell").when(value <= -2, "sell").otherwise("neutral")


def quantile_verdict(value: Column, best: Column, good: Column, poor: Column, worst: Column) -> Column:
    return F.when(value.isNull(), "neutral").when(value >= best, "strong_buy").when(value <= worst, "strong_sell").when(value >= good, "buy").when(value <= poor, "sell").otherwise("neutral")


def hit_rates(rows: DataFrame, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """type, horizon, n, mean forward return in percent and the share that went the trigger's way."""
    along = Window.partitionBy("code").orderBy("date")
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead("close", h).over(along), F.col("close")) - 1).alias("fwd")) for h in horizons))
    each = rows.withColumn("ahead", ahead).select(F.explode("triggers").alias("t"), "ahead").select("t", F.inline("ahead")).where("fwd is not null")
    won = F.avg(F.when(F.col("t.direction") * F.col("fwd") > 0, 1.0).otherwise(0.0))
    return each.groupBy(F.col("t.type").alias("type"), "horizon").agg(F.count("*").alias("n"), (F.avg("fwd") * 100).alias("mean_pct"), won.alias("win_rate"))


VERDICTS = ("strong_buy", "buy", "neutral", "sell", "strong_sell")


def verdict_buckets(rows: DataFrame, horizon: int = 5) -> DataFrame:
    """A row for each verdict, whether it occurs or not: n and mean forward return in percent."""
    along = Window.partitionBy("code").orderBy("date")
    each = rows.withColumn("fwd", F.try_divide(F.lead("close", horizon).over(along), F.col("close")) - 1).where("fwd is not null")
    found = each.groupBy("verdict").agg(F.count("*").alias("n"), (F.avg("fwd") * 100).alias("mean_pct"))
    labels = rows.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return labels.join(found, "verdict", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_indicators(bars: DataFrame) -> DataFrame:
    """bars joined with every indicator, unrounded."""
    return evaluate(bars, indicators(), rounded=False, also=tuple(c for c in bars.columns if c not in ("code", "date")))


def verdict_statistics(rows: DataFrame, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """A row for each verdict and horizon: n of the verdict, sample with a forward return, its mean in percent, the share that went its way.

    A sell wins by a fall, all others by a rise; what does not occur counts as 0.
    """
    along = Window.partitionBy("code").orderBy("date")
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead("close", h).over(along), F.col("close")) - 1).alias("fwd")) for h in horizons))
    each = rows.withColumn("ahead", ahead).select("verdict", F.inline("ahead"))
    way = F.when(F.col("verdict").isin("sell", "strong_sell"), F.col("fwd") < 0).otherwise(F.col("fwd") > 0)
    found = each.groupBy("verdict", "horizon").agg(
        F.count("*").alias("n"), F.count("fwd").alias("sample"), F.coalesce(F.avg("fwd") * 100, F.lit(0.0)).alias("mean_pct"), F.coalesce(F.avg(F.when(F.col("fwd").isNotNull(), way.cast("double"))), F.lit(0.0)).alias("win_rate")
    )
    labels = rows.sparkSession.createDataFrame([(v, h) for v in VERDICTS for h in horizons], "verdict string, horizon int")
    return labels.join(found, ["verdict", "horizon"], "left").fillna(0, ["n", "sample", "mean_pct", "win_rate"])
