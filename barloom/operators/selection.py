"""Selections of factors, their differences, and small relational helpers of experiments and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after_warmup(bars: DataFrame, n: int) -> DataFrame:
    """bars without the first n of each code; a code with no more than n keeps all."""
    own = bars.withColumns({"nth": F.row_number().over(Window.partitionBy("code").orderBy("date")), "have": F.count("*").over(Window.partitionBy("code"))})
    return own.where((F.col("have") <= n) | (F.col("nth") > n)).drop("nth", "have")


def on_trading_days(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows whose date is in the calendar (date)."""
    return rows.join(calendar.select("date").distinct(), "date", "left_semi")


def date_of_text(text: Column) -> Column:
    """A date written as four, two and two digits; NULL for any other text and for days that there are not."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def recent_quarters(today: Column, n: int = 16) -> Column:
    """(year, quarter) of the last n quarters, the one of today first."""
    first = F.trunc(today, "quarter")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.year(F.add_months(first, -3 * k)).alias("year"), F.quarter(F.add_months(first, -3 * k)).alias("quarter")))


def spread(metrics: DataFrame, names: list[str]) -> DataFrame:
    """metric, low, median, high over the rows (an offset each) that have it."""
    own = metrics.unpivot([], names, "metric", "value").groupBy("metric")
    return own.agg(F.min("value").alias("low"), F.median("value").alias("median"), F.max("value").alias("high"))


def winners(first: DataFrame, second: DataFrame, variants: DataFrame, least_abs: float = 0.02, least_ir: float = 0.10, most_degenerate: float = 0.10) -> DataFrame:
    """base, variant, gain_abs and gain_ir (the lesser of both halves) and passes: better than the base on both.

    first, second: factor, abs_ic_mean, ic_ir, degenerate over either half. variants: base, variant.
    """

    def gains(half: DataFrame, k: int) -> DataFrame:
        named = lambda who: half.select(F.col("factor").alias(who), *(F.col(c).alias(f"{who}_{c}") for c in ("abs_ic_mean", "ic_ir", "degenerate")))
        both = variants.join(named("base"), "base").join(named("variant"), "variant")
        more = (F.col("variant_abs_ic_mean") - F.col("base_abs_ic_mean")).alias(f"abs{k}"), (F.abs("variant_ic_ir") - F.abs("base_ic_ir")).alias(f"ir{k}")
        return both.select("base", "variant", *more, F.coalesce("variant_degenerate", F.lit(0.0)).alias(f"degenerate{k}"))

    both = gains(first, 1).join(gains(second, 2), ["base", "variant"])
    lesser = lambda c: F.when(F.col(f"{c}1").isNotNull() & F.col(f"{c}2").isNotNull(), F.least(f"{c}1", f"{c}2"))
    found = both.select("base", "variant", lesser("abs").alias("gain_abs"), lesser("ir").alias("gain_ir"), F.greatest("degenerate1", "degenerate2").alias("degenerate"))
    passes = (F.col("degenerate") <= most_degenerate) & (F.col("gain_abs") >= least_abs) & (F.col("gain_ir") >= least_ir)
    return found.select("base", "variant", "gain_abs", "gain_ir", F.coalesce(passes, F.lit(False)).alias("passes"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """factor, change: added, dropped or kept, between two selections (factor)."""
    was, now = old.select("factor", F.lit(True).alias("was")).distinct(), new.select("factor", F.lit(True).alias("now")).distinct()
    return was.join(now, "factor", "full").select("factor", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "dropped").otherwise("kept").alias("change"))


def as_json(selection: DataFrame) -> DataFrame:
    """One row, value: the selection (place, factor) as a document with its factors in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "factor"))), lambda x: x["factor"])
    return selection.agg(F.to_json(F.struct(names.alias("factors"))).alias("value"))
