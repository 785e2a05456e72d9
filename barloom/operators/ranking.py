"""Exact ranks and quantiles of a whole table, or of groups of any size, without a task that holds a group.

Distinct values are counted, sorted by ranges over all tasks, and written with the number of their range. A range's
rows before a value are a window within the range; those of earlier ranges are sums over a table of one row a range.
Ties are one value, so they never lie across a boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def placed(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, before, total): how many rows of the group have each value, a smaller one, and a value at all."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange(*by, value).withColumn("range", F.spark_partition_id()))
    of = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranges = ranged.groupBy(*by, "range").agg(F.sum("n").alias("own"))
    earlier = F.coalesce(F.sum("own").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*by, "range", earlier.alias("earlier"), F.sum("own").over(of).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    own = ranged.select(*by, "range", value, "n", F.coalesce(within, F.lit(0)).alias("within"))
    return own.join(ranges, [*by, "range"]).select(*by, value, "n", (F.col("within") + F.col("earlier")).alias("before"), "total")


def mean_ranks(rows: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """rows with the rank of value in its group, 1 and up, ties at their mean; NULL for no value.

    The join on the value is one that AQE splits where very many rows have the same.
    """
    by = by or []
    ranks = placed(rows, value, by).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    return rows.join(ranks, [*by, value], "left")


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, share, value): the interpolated quantiles of each group; only rows around a wanted place go on."""
    by = by or []
    at = lambda q: q * (F.col("total") - 1)
    has = lambda place: (place >= F.col("before")) & (place < F.col("before") + F.col("n"))
    wanted = F.filter(F.array(*map(F.lit, shares)), lambda q: has(F.floor(at(q))) | has(F.ceil(at(q))))
    found = placed(rows, value, by).select("*", F.explode(wanted).alias("share"))
    place = at(F.col("share"))
    low, high = (F.max(F.when(has(x), F.col(value))) for x in (F.floor(place), F.ceil(place)))
    ends = found.withColumn("weight", place - F.floor(place)).groupBy(*by, "share").agg(low.alias("low"), high.alias("high"), F.max("weight").alias("weight"))
    return ends.select(*by, "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")).alias(value))
