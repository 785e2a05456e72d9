"""Simulators: signals to fills to equity, one code (or one offset) a group, and the measures of an equity curve."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUY_COST, SELL_COST = 0.0008, 0.0018


def single(rows: DataFrame, hold: list[int], buy: float = BUY_COST, sell: float = SELL_COST, limit: str | None = None) -> DataFrame:
    """code, hold, date, equity, position, trades (so far): one long position at a time, for every holding period.

    rows: code, date, open, close, enter, leave, reset (of the day). What the day before signals is filled at the open:
    an exit when the position has been held long enough or leave is set, unless reset, which starts the period anew; an
    entry when there is none. An open at the upper limit blocks buying, one at the lower limit blocks selling.
    """
    periods = rows.sparkSession.createDataFrame([(int(h),) for h in hold], "hold int")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        opens, closes = own["open"].to_numpy(float), own["close"].to_numpy(float)
        enter, leave, reset = (own[c].to_numpy(bool) for c in ("enter", "leave", "reset"))
        bound = own[limit].to_numpy(float) if limit else np.full(len(own), np.inf)
        most, equity, held, last, trades = int(own["hold"].iloc[0]), 1.0, -1, 0.0, 0
        out = np.empty((len(own), 3))
        for t in range(len(own)):
            mark = last
            if t and opens[t] > 0 and np.isfinite(opens[t]):
                up, down = (opens[t] >= closes[t - 1] * (1 + bound[t]) * 0.998, opens[t] <= closes[t - 1] * (1 - bound[t]) * 1.002) if closes[t - 1] > 0 else (False, False)
                if held >= 0:
                    if reset[t - 1]:
                        held = 0
                    elif (held >= most or leave[t - 1]) and not down:
                        equity *= opens[t] / mark * (1 - sell)
                        held, trades = -1, trades + 1
                elif enter[t - 1] and not up:
                    equity *= 1 - buy
                    held, mark = 0, opens[t]
            if held >= 0:
                if np.isfinite(closes[t]):
                    equity *= closes[t] / mark
                    last = closes[t]
                else:
                    last = mark
                held += 1
            out[t] = equity, held >= 0, trades
        return pd.DataFrame({"code": own["code"].to_numpy(), "hold": most, "date": own["date"].to_numpy(), "equity": out[:, 0], "position": out[:, 1].astype("int32"), "trades": out[:, 2].astype("int32")})

    return rows.crossJoin(F.broadcast(periods)).groupBy("code", "hold").applyInPandas(run, "code string, hold int, date date, equity double, position int, trades int")


def lots(rows: DataFrame, hold: int = 5, capacity: int = 4, buy: float = BUY_COST, sell: float = SELL_COST) -> DataFrame:
    """code, date, equity, position, cash: independent lots of the row's size, each sold after hold bars or on leave.

    On every bar lots age, leave, are marked, and one may be opened if there is the cash and the room for it.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        cash, open_lots, out = 1.0, [], []  # a lot: value, mark, age
        opens, closes, sizes = (own[c].to_numpy(float) for c in ("open", "close", "size"))
        enter, leave = (own[c].to_numpy(bool) for c in ("enter", "leave"))
        for t in range(len(own)):
            if t and opens[t] > 0 and np.isfinite(opens[t]):
                stay = []
                for value, mark, age in open_lots:
                    if age >= hold or leave[t - 1]:
                        cash += value * opens[t] / mark * (1 - sell)
                    else:
                        stay.append((value, mark, age))
                open_lots = stay
                if enter[t - 1] and len(open_lots) < capacity and cash >= sizes[t] > 0:
                    cash -= sizes[t]
                    open_lots.append((sizes[t] * (1 - buy), opens[t], 0))
            if np.isfinite(closes[t]):
                open_lots = [(value * closes[t] / mark, closes[t], age + 1) for value, mark, age in open_lots]
            else:
                open_lots = [(value, mark, age + 1) for value, mark, age in open_lots]
            out.append((cash + sum(v for v, _, _ in open_lots), len(open_lots), cash))
        equity, position, left = zip(*out, strict=True)
        return pd.DataFrame({"code": own["code"].to_numpy(), "date": own["date"].to_numpy(), "equity": equity, "position": np.array(position, dtype="int32"), "cash": left})

    return rows.groupBy("code").applyInPandas(run, "code string, date date, equity double, position int, cash double")


def lot_size(bars: DataFrame, base: float = 0.25, reference: float = 0.2, low: float = 0.05, high: float = 0.5, per_year: float = 252.0) -> DataFrame:
    """bars with size: base by reference over the yearly spread of the 20 returns before, within bounds; base at first."""
    along = Window.partitionBy("code").orderBy("date")
    before = along.rowsBetween(-20, -1)
    own = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(along)) - 1)
    spread = F.when(F.count("ret").over(before) == 20, F.stddev_samp("ret").over(before)) * per_year**0.5
    size = F.when(spread.isNull(), base).when(spread < 1e-12, high).otherwise(base * reference / spread)
    return own.withColumn("size", F.greatest(F.least(size, F.lit(high)), F.lit(low))).drop("ret")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """code, date, equity: the close over the first open."""
    first = F.first("open", ignorenulls=True).over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.select("code", "date", F.try_divide(F.col("close"), first).alias("equity"))


def targets(scores: DataFrame, every: int, offset: str = "offset") -> DataFrame:
    """Which rows of scores (with offset and didx, the day's number) fall on a rebalancing day."""
    return scores.where((F.col("didx") >= F.col(offset)) & ((F.col("didx") - F.col(offset)) % every == 0))


def portfolio(quotes: DataFrame, chosen: DataFrame, buy: float = BUY_COST, sell: float = SELL_COST) -> DataFrame:
    """offset, date, equity, num_positions, cash_ratio: equal weights of the chosen codes from the next open on.

    quotes: offset, didx, date, code, open, close, of every code that an offset ever holds; chosen: offset, didx, code.
    A rebalancing sells every quoted position and buys every quoted target in equal parts; what is not quoted is held.
    A missing close is marked at the entry price. An offset's days depend on each other, so an offset is one group.
    """
    marked = quotes.join(chosen.select("offset", "didx", "code", F.lit(True).alias("target")), ["offset", "didx", "code"], "left").withColumn("target", F.coalesce("target", F.lit(False)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        cash, held, queued, out = 1.0, {}, None, []  # code: (shares, entry price)
        for (_, date), day in own.sort_values(["didx", "code"]).groupby(["didx", "date"], sort=True):
            opens = {c: p for c, p in zip(day["code"], day["open"], strict=True) if p and np.isfinite(p)}
            if queued is not None:
                for c in [c for c in held if c in opens]:
                    cash += held.pop(c)[0] * opens[c] * (1 - sell)
                wanted = [c for c in queued if c in opens]
                part = cash / len(wanted) if wanted else 0.0
                for c in wanted:
                    held[c] = (held.get(c, (0.0, 0.0))[0] + part * (1 - buy) / opens[c], opens[c])
                    cash -= part
                queued = None
            closes = {c: p for c, p in zip(day["code"], day["close"], strict=True) if p and np.isfinite(p)}
            value = sum(n * closes.get(c, entry) for c, (n, entry) in held.items())
            out.append((own["offset"].iloc[0], date, cash + value, len(held), cash / (cash + value)))
            if day["target"].any():
                queued = sorted(day["code"][day["target"]])
        return pd.DataFrame(out, columns=["offset", "date", "equity", "num_positions", "cash_ratio"])

    return marked.groupBy("offset").applyInPandas(run, "offset int, date date, equity double, num_positions int, cash_ratio double")


def envelope(curves: DataFrame) -> DataFrame:
    """date and the spread of the offsets' equity: least, quartiles, most, mean."""
    p = lambda q: F.percentile("equity", F.lit(q))
    return curves.groupBy("date").agg(F.min("equity").alias("low"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75"), F.max("equity").alias("high"), F.avg("equity").alias("mean"))


def metrics(curves: DataFrame, key: str, rate: float = 0.02, per_year: float = 252.0) -> DataFrame:
    """A row a key: total and yearly return, worst drawdown, Sharpe ratio of the bars' returns."""
    along = Window.partitionBy(key).orderBy("date")
    own = curves.where("equity is not null").withColumns({"peak": F.max("equity").over(along.rowsBetween(Window.unboundedPreceding, 0)), "ret": F.try_divide(F.col("equity"), F.lag("equity").over(along)) - 1})
    daily = (1 + rate) ** (1 / per_year) - 1
    found = own.groupBy(key).agg(
        F.count("*").alias("n"), (F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("total_return"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
        F.avg(F.col("ret") - daily).alias("m"), F.stddev_samp("ret").alias("s"),
    )
    yearly = F.when((F.col("n") > 1) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), per_year / F.col("n")) - 1).otherwise(0.0)
    sharpe = F.when((F.col("n") > 2) & (F.col("s") > 1e-12), F.col("m") / F.col("s") * per_year**0.5).otherwise(0.0)
    return found.select(key, "n", "total_return", yearly.alias("annual_return"), "max_drawdown", sharpe.alias("sharpe"))


def compare(a: DataFrame, b: DataFrame, key: str, names: dict[str, bool]) -> DataFrame:
    """metric, means and medians of both arms over common keys, the mean difference, and who wins how often.

    names: the metrics, and whether more is better.
    """
    side = lambda df, n: df.unpivot([key], list(names), "metric", n).withColumn(n, F.coalesce(n, F.lit(0.0)))
    both = side(a.select(key, *names), "a").join(side(b.select(key, *names), "b"), [key, "metric"])
    more = F.col("metric").isin([n for n, up in names.items() if up])
    d = F.when(more, F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("metric").agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.percentile("a", F.lit(0.5)).alias("median_a"), F.percentile("b", F.lit(0.5)).alias("median_b"), F.avg(F.col("b") - F.col("a")).alias("mean_diff"),
        count(d > 0).alias("b_wins"), count(d < 0).alias("a_wins"), F.count("*").alias("n"),
    )


def contributions(trades: DataFrame) -> DataFrame:
    """code, contribution (weight by return), trades, and the share of all contributions' size."""
    found = trades.groupBy("code").agg(F.sum(F.col("weight") * F.col("ret")).alias("contribution"), F.count("*").alias("trades"))
    return found.withColumn("share", F.try_divide(F.abs("contribution"), F.sum(F.abs("contribution")).over(Window.partitionBy())))


def equal_weight_baseline(panel: DataFrame) -> DataFrame:
    """date, equity: the mean over codes of the last known close by the first one."""
    along = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    own = panel.select("date", F.try_divide(F.last("close", ignorenulls=True).over(along), F.first("close", ignorenulls=True).over(along)).alias("x"))
    return own.groupBy("date").agg(F.avg("x").alias("equity"))


def bootstrap_sharpe(pairs: DataFrame, draws: int = 2000, seed: int = 42, per_year: float = 252.0) -> DataFrame:
    """draw, diff: the difference of two Sharpe ratios on circular blocks drawn from paired returns (date, a, b).

    The paired curve is a row a day and goes to every task; the draws are dealt out, each from a generator of its own.
    """
    days = pairs.dropna().orderBy("date").select("a", "b").toPandas().to_numpy()  # a row a trading day
    n = len(days)
    block = max(1, round(n**0.5))

    def sharpe(x: np.ndarray) -> np.ndarray:
        sd = x.std(axis=0, ddof=1)
        return np.where(sd > 1e-12, x.mean(axis=0) / np.maximum(sd, 1e-12) * per_year**0.5, 0.0)

    def run(batches):
        for batch in batches:
            out = []
            for draw in batch["id"]:
                starts = np.random.default_rng([seed, int(draw)]).integers(0, n, -(-n // block))
                rows = (starts[:, None] + np.arange(block)).ravel()[:n] % n
                a, b = sharpe(days[rows])
                out.append((draw, b - a))
            yield pd.DataFrame(out, columns=["draw", "diff"])

    spark = pairs.sparkSession
    return (spark.range(draws) if n > 2 else spark.range(0)).mapInPandas(run, "draw long, diff double")


def subperiods(pairs: DataFrame, parts: int = 3, per_year: float = 252.0) -> DataFrame:
    """part, n, diff: the difference of the two Sharpe ratios in equal parts of the days."""
    nth = F.row_number().over(Window.orderBy("date")) - 1
    own = pairs.dropna().withColumns({"nth": nth, "n": F.count("*").over(Window.partitionBy())}).withColumn("part", F.floor(F.col("nth") * parts / F.col("n")))
    sharpe = lambda c: F.when(F.stddev_samp(c) > 1e-12, F.avg(c) / F.stddev_samp(c) * per_year**0.5).otherwise(0.0)
    return own.groupBy("part").agg(F.count("*").alias("n"), (sharpe("b") - sharpe("a")).alias("diff"))
