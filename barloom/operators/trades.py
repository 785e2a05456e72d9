"""Trades out of a position column, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trades(rows: DataFrame, position: str = "position", by: tuple[str, ...] = ("code",)) -> DataFrame:
    """(by, nth, entry, exit, bars, entry_price, exit_price, ret): each run of bars on which a position is held.

    rows: by, date, open, close, position (held on that bar, true or false; none is not held). Bought at the open of the
    first bar held, sold at the open of the first bar after the last; a run that still goes on has no exit and its
    return is to the last close.
    """
    along = Window.partitionBy(*by).orderBy("date")
    held = F.coalesce(F.col(position).cast("boolean"), F.lit(False))
    own = rows.withColumns({"_held": held, "_before": F.coalesce(F.lag(held).over(along), F.lit(False)), "_next": F.lead("date").over(along), "_next_open": F.lead("open").over(along)})
    own = own.withColumn("nth", F.sum((F.col("_held") & ~F.col("_before")).cast("int")).over(along)).where("_held")
    out = own.groupBy(*by, "nth").agg(
        F.min("date").alias("entry"), F.max_by("_next", "date").alias("exit"), F.count("*").alias("bars"), F.min_by("open", "date").alias("entry_price"), F.max_by(F.coalesce("_next_open", "close"), "date").alias("exit_price")
    )
    return out.withColumn("ret", F.try_divide("exit_price", "entry_price") - 1)


def statistics(trades: DataFrame, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """(by, trades, open_trades, win_rate, mean_pct, best_pct, worst_pct, mean_bars) over the trades that have ended."""
    done = F.col("exit").isNotNull()
    ret = F.when(done, F.col("ret"))
    return trades.groupBy(*by).agg(
        F.count(F.when(done, 1)).alias("trades"), F.count(F.when(~done, 1)).alias("open_trades"), F.avg((ret > 0).cast("double")).alias("win_rate"), (F.avg(ret) * 100).alias("mean_pct"),
        (F.max(ret) * 100).alias("best_pct"), (F.min(ret) * 100).alias("worst_pct"), F.avg(F.when(done, F.col("bars"))).alias("mean_bars"),
    )
