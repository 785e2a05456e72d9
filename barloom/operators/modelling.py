"""Two-step scoring: choose factors by Lasso, weigh them, refit every month on what was known by then.

The sums of products that a fit needs are taken by code and month and added up (see gram); the fits run where the sums
are, and scores are one join of the rows with the month's coefficients.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import gram
from .lasso import fit, lasso  # noqa: F401  they are part of this module's interface


def walk_forward(rows: DataFrame, names: list[str], alpha: float = 0.0005, weigher: str = "ic") -> tuple[DataFrame, DataFrame]:
    """(scores, models): code, date, score by the model of the month; month, factor, mean, sd, weight, n of each fit.

    rows: code, date, known (the day on which the label had ended, with the embargo), fwd and the factors. A month's model
    knows the labels that had ended before the month. Missing factors count as their mean, unless all are.
    """
    p, month = len(names), F.trunc("date", "month")
    periods = rows.select(month.alias("month")).distinct().withColumn("period", (F.row_number().over(Window.orderBy("month")) - 1).cast("int"))  # a row a month
    x = F.array(*(F.col(n).cast("double") for n in names)).alias("x")
    dated = rows.select("code", "date", x, "fwd", month.alias("month"), F.trunc("known", "month").alias("known_month")).join(periods, "month")
    known = periods.select(F.col("month").alias("known_month"), (F.col("period") + 1).alias("known"))
    dated = written(dated.join(known, "known_month", "left").drop("known_month"))
    found = gram.models(gram.blocks(dated, p), dated.select("code", "period").distinct(), p, alpha=alpha, weigher=weigher)
    each = found.join(periods, "period").select("month", "n", F.posexplode(F.arrays_zip("mean", "sd", "weight")).alias("k", "m"))
    table = each.select("month", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("factor"), "m.mean", "m.sd", "m.weight", "n")
    return gram.scored(dated, found, p, False), table


def top_contributions(rows: DataFrame, table: DataFrame, names: list[str], n: int = 8) -> DataFrame:
    """code, date, factors: the n factors that moved the score most, as (factor, contribution by a hundred, rounded)."""
    values = rows.unpivot(["code", "date"], names, "factor", "value").withColumn("month", F.trunc("date", "month")).join(F.broadcast(table), ["month", "factor"])
    part = values.withColumn("c", F.round((F.col("value") - F.col("mean")) / F.col("sd") * F.col("weight") * 100)).where("c <> 0")
    placed = part.withColumn("nth", F.row_number().over(Window.partitionBy("code", "date").orderBy(F.abs("c").desc(), "factor"))).where(F.col("nth") <= n)
    return placed.groupBy("code", "date").agg(F.array_sort(F.collect_list(F.struct("nth", "factor", "c"))).alias("factors"))
