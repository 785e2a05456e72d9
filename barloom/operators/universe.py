"""Listings, ingest, tradability, eligibility and candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Board limits by code prefix; what is not listed has the last.
LIMITS = ((("300", "301", "688"), 0.198), (("82", "83", "87", "43"), 0.298))
LIMIT = 0.098


def by_code():
    return Window.partitionBy("code").orderBy("date")


def latest():
    return Window.partitionBy("code").orderBy(F.col("date").desc())


def normalise(rows: DataFrame, order: str) -> DataFrame:
    """Six fields of a bar, one row a code and date, the first by order; rows without a date go."""
    first = Window.partitionBy("code", "date").orderBy(order)
    plain = rows.select("code", F.to_date("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")), order)
    return plain.where("date is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", order)


def without_placeholder(bars: DataFrame) -> DataFrame:
    """bars less a last bar that no trade made: next to no volume and one price."""
    last = F.lead("date").over(by_code()).isNull()
    flat = (F.col("volume") < 1) & (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return bars.withColumn("empty_end", last & flat).where("not coalesce(empty_end, false)").drop("empty_end")


def merge(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both, the cached row where both have a code and date."""
    both = cached.withColumn("late", F.lit(0)).unionByName(fresh.withColumn("late", F.lit(1)))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("code", "date").orderBy("late"))).where("nth = 1").drop("nth", "late")


def recent(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each code."""
    return bars.withColumn("back", F.row_number().over(latest())).where(F.col("back") <= n).drop("back")


def special(name: Column) -> Column:
    return F.upper(name).contains("ST")


def listed(universe: DataFrame, prefixes: list[str], special_too: bool = False) -> DataFrame:
    """Codes of the given exchanges, each once."""
    own = universe.where(F.rlike("code", F.lit("^(" + "|".join(prefixes) + ")")))
    return (own if special_too else own.where(~special(F.col("name")))).dropDuplicates(["code"])


def validate(bars: DataFrame) -> DataFrame:
    """A row a code: bars without volume, moves of over a fifth, the longest gap in days and whether it is over 14."""
    moved = bars.withColumns({"move": F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_code())) - 1), "gap": F.date_diff("date", F.lag("date").over(by_code()))})
    found = moved.groupBy("code").agg(
        F.sum(F.when(F.col("volume") == 0, 1).otherwise(0)).alias("zero_volume"), F.sum(F.when(F.col("move") > 0.2, 1).otherwise(0)).alias("large_moves"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap")
    )
    return found.withColumn("gappy", F.col("longest_gap") > 14)


def limit_of(code: Column) -> Column:
    out = F.lit(LIMIT)
    for prefixes, limit in reversed(LIMITS):
        out = F.when(F.substring(code, 1, len(prefixes[0])).isin(*prefixes), limit).otherwise(out)
    return out


def tradable(panel: DataFrame, listings: DataFrame, least_days: int = 60) -> DataFrame:
    """panel with tradable: a move below the board's limit, volume, and long enough since the listing (unknown: yes)."""
    move = F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_code())) - 1)
    seasoned = F.coalesce(F.col("date") >= F.date_add("ipo_date", int(1.45 * least_days)), F.lit(True))
    marked = panel.withColumn("move", move).join(listings, "code", "left")
    flag = F.coalesce(F.col("move") < limit_of(F.col("code")), F.lit(False)) & F.coalesce(F.col("volume") > 0, F.lit(False)) & seasoned
    return marked.withColumn("tradable", flag).drop("move", "ipo_date")


def listed_by_first_bar(panel: DataFrame, least_days: int = 60) -> DataFrame:
    """panel with seasoned, where no listing dates are known: so many rows since the first close, or there from the start."""
    nth = F.row_number().over(by_code())
    first = F.min(F.when(F.col("close").isNotNull(), F.col("nth"))).over(Window.partitionBy("code"))
    flag = F.when(F.col("first").isNull(), False).when(F.col("first") == 1, True).otherwise(F.col("nth") >= F.col("first") + least_days)
    return panel.withColumn("nth", nth).withColumn("first", first).withColumn("seasoned", flag).drop("nth", "first")


def eligible(bars: DataFrame, names: DataFrame, least_bars: int = 60, floor: float = 1e6) -> DataFrame:
    """code, date, eligible, over the bars that there are: no special name, enough bars, enough turnover over the last 20."""
    last20 = Window.partitionBy("code").orderBy("date").rowsBetween(-19, 0)
    amount = F.avg(F.col("close") * F.col("volume") * 100).over(last20)
    marked = bars.select("code", "date", F.row_number().over(by_code()).alias("nth"), amount.alias("amount")).join(names.select("code", "name"), "code", "left")
    liquid = F.lit(True) if floor == 0 else F.coalesce(F.col("amount") >= floor, F.lit(False))
    return marked.select("code", "date", ((F.col("nth") >= least_bars) & liquid & ~F.coalesce(special(F.col("name")), F.lit(False))).alias("eligible"))


def average_amount(bars: DataFrame, n: int = 20) -> DataFrame:
    """code, amount: mean turnover of the last n bars, and bars, how many these are."""
    return recent(bars, n).groupBy("code").agg(F.avg(F.col("close") * F.col("volume") * 100).alias("amount"), F.count("*").alias("bars"))


def latest_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("code").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))


def candidates(bars: DataFrame, names: DataFrame, shares: DataFrame, listings: DataFrame, today: str, least_days: int = 365, floor: float = 1e6) -> DataFrame:
    """code, name, industry, value, amount of the codes that pass: a value, no special or delisting name, listed long enough, liquid."""
    value = latest_close(bars).join(shares, "code", "left").select("code", (F.col("close") * F.col("shares")).alias("value"))
    found = names.join(value, "code", "left").join(average_amount(bars).drop("bars"), "code", "left").join(listings, "code", "left")
    found = found.where(F.col("value").isNotNull() & ~special(F.col("name")) & ~F.col("name").contains("退"))
    found = found.where((F.col("ipo_date") <= F.date_sub(F.lit(today).cast("date"), least_days)) & (F.col("amount") >= floor))
    return found.select("code", "name", F.coalesce("ind", F.lit("未知")).alias("industry"), "value", "amount")


def stratified(pool: DataFrame, n: int = 3) -> DataFrame:
    """The n largest by value and the n most liquid of each industry, tagged by what chose them."""
    place = lambda c: F.row_number().over(Window.partitionBy("industry").orderBy(F.col(c).desc(), "code"))
    ranked = pool.withColumns({"by_value": place("value") <= n, "by_amount": place("amount") <= n}).where("by_value or by_amount")
    return ranked.withColumn("source_tag", F.when(F.col("by_value") & F.col("by_amount"), "mcap+liq").when(F.col("by_value"), "mcap").otherwise("liq")).drop("by_value", "by_amount")


def open_or_before(bars: DataFrame) -> DataFrame:
    """bars with the close before where a bar has no open."""
    return bars.withColumn("open", F.coalesce("open", F.lag("close").over(by_code())))


def fillable(bars: DataFrame) -> DataFrame:
    """(code, date) of the days on whose signal a fill at the next bar's open is possible."""
    return bars.withColumn("_open", F.lead("open").over(by_code())).where("_open is not null and _open > 0").select("code", "date")


def capped_top(scores: DataFrame, k: int, cap: int, group: str = "industry", day: str = "date", only: DataFrame | None = None) -> DataFrame:
    """The k best of each day with at most cap of a group, score first and code among equals; only: (code, day) that may be taken.

    Taking greedily and passing over full groups is the same as the first cap of each group and then the first k. The cap
    does not hold on a day on which no code has a group.
    """
    order = [F.col("score").desc(), F.col("code")]
    valid = scores.where("score is not null")
    valid = valid if only is None else valid.join(only, ["code", day], "left_semi")
    mapped = F.max(F.col(group).isNotNull()).over(Window.partitionBy(day))
    within = F.row_number().over(Window.partitionBy(day, F.coalesce(group, F.lit("Unknown"))).orderBy(*order))
    kept = valid.withColumns({"within": within, "mapped": mapped}).where((F.col("within") <= cap) | ~F.col("mapped"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy(*order))).where(F.col("place") <= k).drop("within", "mapped")


def hits_limit(open_: Column, before: Column, limit: Column) -> tuple[Column, Column]:
    """Does the open stand at the upper, at the lower limit; never where the close before is not above 0."""
    known = before > 0
    return F.coalesce(known & (open_ >= before * (1 + limit) * 0.998), F.lit(False)), F.coalesce(known & (open_ <= before * (1 - limit) * 1.002), F.lit(False))


def fill_limit(code: Column, is_special: Column) -> Column:
    out = F.when(is_special, 0.05).otherwise(0.10)
    out = F.when(F.substring(code, 1, 2).isin("82", "83", "87", "43"), 0.30).otherwise(out)
    return F.when(F.substring(code, 1, 3).isin("300", "301", "688"), 0.20).otherwise(out)


def weekly(bars: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday; a week with a missing field goes."""
    week = F.next_day(F.date_sub("date", 1), "FR").alias("week")
    found = bars.groupBy("code", week).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return found.dropna(subset=["open", "high", "low", "close", "volume"])
