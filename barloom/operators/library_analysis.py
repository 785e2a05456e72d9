"""Analysis of a whole factor library, as rows of factors: winsorising, daily coefficients, degenerate days, summaries,
correlations of all factors as a product of matrices, and the merge of parts that were analysed apart.

All rows of a factor's day are one group of the same exchange: quantiles, distinct values, ranks and the coefficient.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import blocks
from . import analysis


def daily_ic(rows: DataFrame, winsorise: tuple[float, float] | None = (0.01, 0.99), most_equal: float = 0.01, least_covered: float = 0.05) -> DataFrame:
    """(factor, date, ic, usable, degenerate) of rows (factor, code, date, value, fwd, close).

    ic is the rank coefficient over the codes with a value and a label, NULL on degenerate days: nearly all values are one,
    or nearly no code with a close has a value. usable: does the factor have any value that day.
    """
    day = Window.partitionBy("factor", "date")
    own = rows.withColumn("value", F.round("value", 9))
    if winsorise:
        cuts = F.percentile("value", F.array(*map(F.lit, winsorise))).over(day)
        own = own.withColumn("cuts", cuts).withColumn("clipped", F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.col("cuts")[0]), F.col("cuts")[1])))
    else:
        own = own.withColumn("clipped", F.col("value"))
    own = own.withColumns({"x": F.when(F.col("fwd").isNotNull(), F.round("clipped", 9)), "y": F.when(F.col("value").isNotNull(), F.col("fwd"))})
    own = own.withColumns({"x": analysis.mean_rank(F.col("x"), ["factor", "date"]), "y": analysis.mean_rank(F.col("y"), ["factor", "date"])})
    spread = (F.count("x") >= 2) & (F.stddev_pop("x") >= 1e-12) & (F.stddev_pop("y") >= 1e-12)
    n = F.count("value")
    bad = (F.count_distinct("value") / n <= most_equal) | (F.try_divide(n.cast("double"), F.count("close")) < least_covered)
    found = own.groupBy("factor", "date").agg(F.when(spread, analysis.correlated(F.col("x"), F.col("y"))).alias("ic"), (n > 0).alias("usable"), ((n > 0) & F.coalesce(bad, F.lit(False))).alias("degenerate"))
    return found.withColumn("ic", F.when(~F.col("degenerate"), F.col("ic")))


def daily_ic_wide(rows: DataFrame, names: list[str], winsorise: tuple[float, float] | None = (0.01, 0.99), most_equal: float = 0.01, least_covered: float = 0.05, also_degenerate: bool = False) -> DataFrame:
    """The same of rows (code, date, fwd, close and a column for each factor): a day's codes travel once for all factors,
    and no row is made for a factor, code and day. also_degenerate: degenerate days have their coefficients, too."""
    own = rows.select("date", F.col("fwd").cast("double"), F.col("close").isNotNull().cast("double").alias("held"), *(F.round(n, 9).alias(n) for n in names))

    def of_day(day: pa.Table) -> dict:
        fwd, held = day.column("fwd").to_numpy(), np.nansum(day.column("held").to_numpy())
        found = [_ic_of_day(day.column(n).to_numpy(), fwd, held, winsorise, most_equal, least_covered, also_degenerate) for n in names]
        ic, usable, degenerate = zip(*found)
        return {"factor": names, "date": pa.array([day.column("date")[0].as_py()] * len(names), pa.date32()), "ic": pa.array(ic, pa.float64()), "usable": usable, "degenerate": degenerate}

    return blocks.by_date(own, of_day, "factor string, date date, ic double, usable boolean, degenerate boolean")


def _nine_places(x: float) -> float:
    return float(decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("1e-9"), decimal.ROUND_HALF_UP)) if abs(x) < 1e15 else float(x)


def _quantile(ordered: np.ndarray, q: float) -> float:
    at = (len(ordered) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]


def _ic_of_day(value: np.ndarray, fwd: np.ndarray, held: float, winsorise, most_equal: float, least_covered: float, also_degenerate: bool = False) -> tuple[float | None, bool, bool]:
    has = ~np.isnan(value)
    ordered = np.sort(value[has])
    n = len(ordered)
    if not n:
        return None, False, False
    distinct = 1 + int((ordered[1:] != ordered[:-1]).sum())
    bad = distinct / n <= most_equal or bool(held and n / held < least_covered)
    if bad and not also_degenerate:
        return None, True, True
    both = has & ~np.isnan(fwd)
    x, y = value[both], fwd[both]
    if winsorise:
        x = np.maximum(np.minimum(x, _nine_places(_quantile(ordered, winsorise[1]))), _nine_places(_quantile(ordered, winsorise[0])))
    if len(x) < 2:
        return None, True, bad
    x, y = blocks.mean_rank(x) * len(x), blocks.mean_rank(y) * len(y)
    sx, sy = x.std(), y.std()
    return (float(np.mean((x - x.mean()) * (y - y.mean())) / (sx * sy)) if sx >= 1e-12 and sy >= 1e-12 else None), True, bad


def summary(ic: DataFrame, lag: int = 5) -> DataFrame:
    """factor, days, mean_ic, ic_std, ic_ir, abs_ic_mean, half_life, nw_std, degenerate (share of the usable days)."""
    shares = ic.where("usable").groupBy("factor").agg(F.avg(F.col("degenerate").cast("double")).alias("degenerate"))
    lives = analysis.half_life(ic).select("factor", "half_life")
    return analysis.summary(ic).join(lives, "factor", "left").join(analysis.newey_west(ic, lag), "factor", "left").join(shares, "factor", "left")


def merged(parts: list[DataFrame]) -> DataFrame:
    """The daily coefficients of parts that were analysed apart; of a factor's day in several parts the first part's."""
    rows = None
    for k, part in enumerate(parts):
        own = part.withColumn("part", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    columns = [c for c in rows.columns if c not in ("factor", "date", "part")]
    return rows.groupBy("factor", "date").agg(F.min(F.struct("part", *columns)).alias("one")).select("factor", "date", *(F.col(f"one.{c}") for c in columns))


SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _sums(names: list[str]):
    """Of days (an array of coefficients in order of names each) the sums over the days that two factors share, a row a factor."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("ic").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)).astype(float)
            has = np.isfinite(values).astype(float)
            v = np.where(has > 0, values, 0.0)
            own = np.stack([has.T @ has, v.T @ has, has.T @ v, (v * v).T @ has, has.T @ (v * v), v.T @ v])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(list(s)) for s in total)], ["a", *SUMS])

    return sums


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """One factor's sums; a row for each task that had days."""
    return pa.table({"a": [key[0].as_py()], **{s: [np.sum([x.values.to_numpy() for x in rows.column(s).combine_chunks()], axis=0)] for s in SUMS}})


def ic_correlation(ic: DataFrame, names: list[str]) -> DataFrame:
    """a, b, corr for every pair of names, over the days that both have; 0 where there is none, 1 with itself.

    The (date x factor) matrix is multiplied with itself block by block of days; six sums a pair leave a task, whatever
    the number of days, and no row a day and pair is made.
    """
    values = F.map_from_entries(F.collect_list(F.struct("factor", "ic")))  # a row a factor, which the library bounds
    days = ic.where("ic is not null").groupBy("date").agg(values.alias("of")).select(F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.element_at("of", n), F.lit(float("nan")))).alias("ic"))
    schema = "a string, " + ", ".join(f"{s} array<double>" for s in SUMS)
    sums = days.mapInArrow(_sums(names), schema).groupBy("a").applyInArrow(_added, schema)
    each = sums.select("a", F.posexplode(F.arrays_zip(*SUMS)).alias("k", "s")).select("a", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("b"), "s.*")
    cov, vx, vy = (F.col(p) / F.col("n") - F.col(q) / F.col("n") * F.col(r) / F.col("n") for p, q, r in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    corr = F.when((F.col("n") > 0) & (vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy))
    return each.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(corr, F.lit(0.0))).alias("corr"))
