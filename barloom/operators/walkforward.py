"""Daily and weekly verdicts as of each day: the week that is still running counts as a bar of its own.

The indicators of the finished weeks are computed once. A day's weekly indicators are one step from those of the week
before it: running sums, ranges and recursions each take the bar of the week so far. So a day costs one row of a join by
code and week, not a pass over all weeks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expression import evaluate
from ..sources.shared import written
from . import indicators, universe
from . import series as s

#: So many days, and weeks (the running one too), there must be.
LEAST_DAYS, LEAST_WEEKS = 30, 30
MEANS = (5, 10, 20, 60)


def running_weeks(daily: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """code, date, week, the bar of the week so far, and the columns of daily named in also."""
    so_far = Window.partitionBy("code", "week").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    own = daily.withColumn("week", F.next_day(F.date_sub("date", 1), "FR"))
    return own.select(
        "code", "date", "week", F.first("open", True).over(so_far).alias("open"), F.max("high").over(so_far).alias("high"), F.min("low").over(so_far).alias("low"), F.last("close", True).over(so_far).alias("close"), F.sum("volume").over(so_far).alias("volume"), *also
    )


def week_states(daily: DataFrame) -> DataFrame:
    """code, week, nth (its number) and all that a step needs from the weeks before it, as p_ columns."""
    close, high, low, volume = indicators.close, indicators.high, indicators.low, indicators.volume
    change = close - s.delay(close, 1)
    own = indicators.indicators()
    carried = {c: own[c] for c in ("ma5", "ma20", "dif", "dea", "hist", "k", "d", "lower", "upper", "rsi6")} | {"close": close}
    carried |= {f"sum{n}": s.rolling("sum", close, n - 1) for n in MEANS}
    carried |= {"ema12": s.ema(close, 12), "ema26": s.ema(close, 26), "up": s.ewm(s.at_least(change, 0.0), 1 / 6), "down": s.ewm(s.at_least(-change, 0.0), 1 / 6)}
    carried |= {"mean19": s.rolling("avg", close, 19), "sd19": s.rolling("stddev_pop", close, 19), "low8": s.ts_min(low, 8), "high8": s.ts_max(high, 8), "volume5": s.rolling("avg", volume, 5)}
    before = {f"p_{c}": s.delay(x, 1) for c, x in carried.items()} | {f"p{k}_hist": s.delay(own["hist"], k) for k in (2, 3)}
    weeks = evaluate(universe.weekly(daily).withColumnRenamed("week", "date"), before | {"nth": s.nth()}, rounded=False)
    return weeks.withColumnRenamed("date", "week")


def stepped(before: str, x: Column, alpha: float) -> Column:
    """One step of a recursion from the value before; the first value where there is none."""
    return F.coalesce((1 - alpha) * F.col(before) + alpha * x, x)


def step(rows: DataFrame) -> DataFrame:
    """rows (the bar of the week so far and the p_ columns) with the indicators that the triggers read."""
    c = F.col
    sd = F.sqrt((19 * c("p_sd19") * c("p_sd19") + (c("close") - c("p_mean19")) * (c("close") - c("p_mean19")) * (19 / 20)) / 20)
    bottom, top = F.least("low", "p_low8"), F.greatest("high", "p_high8")
    change = c("close") - c("p_close")
    up, down = stepped("p_up", F.greatest(change, F.lit(0.0)), 1 / 6), stepped("p_down", F.greatest(-change, F.lit(0.0)), 1 / 6)
    rows = rows.withColumns({f"ma{n}": (c(f"p_sum{n}") + c("close")) / n for n in MEANS})
    rows = rows.withColumns({
        "dif": stepped("p_ema12", c("close"), 2 / 13) - stepped("p_ema26", c("close"), 2 / 27), "k": stepped("p_k", F.coalesce(F.try_divide(c("close") - bottom, top - bottom) * 100, F.lit(50.0)), 1 / 3),
        "rsi6": F.coalesce(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, down)), F.lit(50.0)), "upper": c("ma20") + 2 * sd, "lower": c("ma20") - 2 * sd, "volume_ratio": F.try_divide("volume", "p_volume5"),
    })
    rows = rows.withColumns({"dea": stepped("p_dea", c("dif"), 2 / 10), "d": stepped("p_d", c("k"), 1 / 3)})
    return rows.withColumns({"hist": 2 * (c("dif") - c("dea")), "j": 3 * c("k") - 2 * c("d")})


def weekly_scores(daily: DataFrame, weeks: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """code, date, weekly_score: as of each day, 0 while there are too few weeks; and the columns of daily named in also.

    weeks: the bars whose weeks count, daily itself unless given. Both sides of the join are sorted and merged: Spark takes
    the states of the weeks, a row a code and week, for small and would send them all to the driver.
    """
    states = week_states(daily if weeks is None else weeks).hint("merge")
    rows = step(running_weeks(daily, also).join(states, ["code", "week"], "left")).withColumn("triggers", indicators.fired())
    return rows.select("code", "date", F.when(F.col("nth") >= LEAST_WEEKS, indicators.score()).otherwise(0).alias("weekly_score"), *also)


def verdicts(daily: DataFrame) -> DataFrame:
    """code, date, open, close, verdict, daily_score, weekly_score, final_score, from a code's LEAST_DAYS-th bar on.

    A day's own score goes along with its bar, so days are not joined with days.
    """
    daily = written(daily)
    bars = ("open", "high", "low", "close", "volume")
    own = evaluate(daily, indicators.indicators() | indicators.before() | {"day": s.nth()}, rounded=False, also=bars).withColumn("triggers", indicators.fired())
    scored = own.select("code", "date", *bars, "day", indicators.score().alias("daily_score"))
    scored = scored.withColumns({"day_open": F.col("open"), "day_close": F.col("close")})
    both = weekly_scores(scored, daily, ("day", "day_open", "day_close", "daily_score")).where(F.col("day") >= LEAST_DAYS)
    final = indicators.combined(F.col("daily_score"), F.col("weekly_score"))
    return both.withColumn("final_score", final).select("code", "date", F.col("day_open").alias("open"), F.col("day_close").alias("close"), indicators.verdict(F.col("final_score")).alias("verdict"), "daily_score", "weekly_score", "final_score")
