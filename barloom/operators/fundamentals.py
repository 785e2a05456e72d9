"""Point-in-time fundamentals: what was published by a day, carried on for a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the calendar (trading and publication days of all codes) over which a published value is carried.
CARRY = 250


def derived(facts: DataFrame) -> DataFrame:
    """facts (code, stat_date, pub_date and the reported fields as text) as numbers, with what several reports give together.

    profit4: the profits of four reports in order of publication; revenue_yoy: against the fourth report before;
    equity: profit over its return; roe_ttm: the return of four quarters, from figures of the year to date.
    """
    fields = [c for c in facts.columns if c not in ("code", "stat_date", "pub_date")]
    rows = facts.select("code", "stat_date", "pub_date", *(F.expr(f"try_cast({c} as double)").alias(c) for c in fields))
    by_report = Window.partitionBy("code").orderBy("pub_date", "stat_date")
    last4 = by_report.rowsBetween(-3, 0)
    was = F.lag("revenue", 4).over(by_report)
    rows = rows.withColumns({"profit4": F.when(F.count("net_profit").over(last4) == 4, F.sum("net_profit").over(last4)), "revenue_yoy": F.when(F.abs(was) > 1e-9, (F.col("revenue") - was) / F.abs(was))})
    rows = rows.withColumn("equity", F.when((F.col("roe") > 1e-9) & (F.col("net_profit") / F.col("roe") > 0), F.col("net_profit") / F.col("roe")))
    quarter = F.year("stat_date") * 4 + F.quarter("stat_date")
    along = Window.partitionBy("code").orderBy("q")
    single = F.when(F.quarter("stat_date") == 1, F.col("roe")).otherwise(F.col("roe") - F.max("roe").over(along.rangeBetween(-1, -1)))
    rows = rows.withColumn("q", quarter).withColumn("single", single)
    four = along.rangeBetween(-3, 0)
    return rows.withColumn("roe_ttm", F.when(F.count("single").over(four) == 4, F.sum("single").over(four))).drop("q", "single")


def as_of(panel: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """panel with the fields as known on each day: the last published value that is there, of one day's the latest period.

    Publications are rows among the bars of their code, before those of their day; each field's last value is carried
    along with the number of its day in the calendar of all trading and publication days, and dropped when that is
    CARRY days back. One exchange by code; only the calendar, a row a day, is broadcast.
    """
    latest = Window.partitionBy("code", "pub_date").orderBy("stat_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = facts.select("code", F.col("pub_date").alias("date"), *(F.last(f, ignorenulls=True).over(latest).alias(f) for f in fields)).dropDuplicates(["code", "date"])
    calendar = panel.select("date").distinct().union(facts.select("pub_date")).distinct().withColumn("_at", F.row_number().over(Window.orderBy("date")))
    own = [c for c in panel.columns if c not in fields]
    rows = panel.select(*own).withColumn("_bar", F.lit(True)).unionByName(one.withColumn("_bar", F.lit(False)), allowMissingColumns=True).join(F.broadcast(calendar), "date")
    carried = Window.partitionBy("code").orderBy("_at", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    last = {f: F.last(F.when(F.col(f).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(f).alias("value"))), ignorenulls=True).over(carried) for f in fields}
    known = rows.select(*own, "_bar", "_at", *(c.alias(f) for f, c in last.items())).where("_bar")
    return known.select(*own, *(F.when(F.col("_at") - F.col(f"{f}.at") <= CARRY, F.col(f"{f}.value")).alias(f) for f in fields))


def over(a: Column, b: Column) -> Column:
    """a by b where b is above 0."""
    return F.when(b > 0, a / b)


def factors(rows: DataFrame) -> DataFrame:
    """rows (a panel with the known fields) with the sixteen fundamental factors."""
    c = F.col
    cap = c("close") * c("total_share")
    pe_ttm = over(c("close"), c("eps_ttm"))
    return rows.select(
        "code", "date", c("roe"), over(c("roe"), c("asset_to_equity")).alias("roa"), c("gross_margin"), c("net_margin"), c("revenue_yoy"), over(cap, c("profit4")).alias("pe"), over(cap, c("equity")).alias("pb"),
        cap.alias("market_cap"), F.when(cap > 0, F.ln(cap)).alias("log_market_cap"), c("yoy_ni").alias("netprofit_yoy"), c("yoy_asset").alias("asset_yoy"), c("yoy_eps").alias("eps_yoy"), c("debt_to_asset"), c("cfo_to_np"),
        F.try_divide(c("eps_ttm"), c("close")).alias("ep"), F.try_divide(F.lit(1.0), pe_ttm * F.when(c("roe_ttm") > 0, c("roe_ttm"))).alias("bp"),
    )
