"""Walk-forward fits from additive sums of products.

The sums that a fit needs (ones, factors, label, by one another) add up over rows. So they are taken once for each code
and period, a period being what passes between two refits; a fit is a sum over periods, less the host's own sums where
a code must not learn from itself, and the last so many periods are a shorter sum. Fits run where the sums are, one for
each period (and code), and only their coefficients are kept.

A row at bar t has its label from bar t + lag on, and may be learnt from if that and the embargo lie before the bar of
the refit: its period is the one after that of bar t + lag + embargo. Nulls: a row without a label is not learnt from, nor
is one with any missing factor (nulls="drop"), or without any factor where missing ones count as 0 (nulls="zero", for
factors that are scores across a day); in scoring a missing factor counts as its mean, and a row without any factor has
no score.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .lasso import fit

#: Sums of all periods that are broadcast at most, in numbers: 512 MB of them.
MOST_SUMS = 1 << 26


def periods(days: DataFrame, lag: int, embargo: int | None = None, every: int | None = None) -> DataFrame:
    """(date, period, known): the refit that a bar is scored by, and the first refit that may learn from it (NULL: none).

    every: bars between refits; without it a refit begins each month. The embargo is as long as the lag unless given.
    The calendar has one row a trading day.
    """
    along = Window.orderBy("date")
    number = F.floor((F.row_number().over(along) - 1) / every) if every else F.dense_rank().over(Window.orderBy(F.trunc("date", "month"))) - 1
    own = days.select("date").distinct().withColumn("period", number.cast("int"))
    return own.withColumn("known", (F.lead("period", lag + (lag if embargo is None else embargo)).over(along) + 1).cast("int"))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper triangle of the sums of products of (1, x, y)."""
    v = np.column_stack([np.ones(len(y)), x, y])
    return (v.T @ v)[np.triu_indices(v.shape[1])]


def square(packed: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p + 2, p + 2))
    out[np.triu_indices(p + 2)] = packed
    return out + np.triu(out, 1).T


BLOCKS = "code string, known int, sums array<double>"


def block_rows(p: int):
    """Rows in order of code and period as one row of sums for each code and period."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("x").flatten().to_numpy().reshape(-1, p), batch.column("fwd").to_numpy()
            codes, known = batch.column("code").to_pylist(), batch.column("known").to_pylist()
            begins = [k for k in range(len(codes)) if k == 0 or (codes[k], known[k]) != (codes[k - 1], known[k - 1])]
            for begin, end in zip(begins, [*begins[1:], len(codes)], strict=True):
                own = products(x[begin:end], y[begin:end])
                if key == (codes[begin], known[begin]):
                    sums = sums + own
                    continue
                if key is not None:
                    yield _row(key, sums)
                key, sums = (codes[begin], known[begin]), own
        if key is not None:
            yield _row(key, sums)

    return blocks


def period_rows(p: int):
    """Rows in any order as one row of sums for each period that a task sees; the calendar bounds what it holds."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            known = batch.column("known").to_numpy()
            x, y = batch.column("x").flatten().to_numpy().reshape(-1, p), batch.column("fwd").to_numpy()
            for k in np.unique(known).tolist():
                own = products(x[known == k], y[known == k])
                held[k] = held[k] + own if k in held else own
        for k in sorted(held):
            yield _row((None, k), held[k])

    return sums


def _row(key: tuple, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([sums])], ["code", "known", "sums"])


def blocks(rows: DataFrame, p: int, nulls: str = "drop", by_code: bool = True) -> DataFrame:
    """BLOCKS of rows (code, known, x array<double>, fwd), written: a code's rows are read in order, none are held.

    Sums of many factors are larger than the rows of a code and period that they are of. Where no fit asks for a code's
    own, by_code=False takes them by period alone, a row (its code NULL) for each period and task, and rows stay where they are.
    """
    none = lambda v: v.isNull() | F.isnan(v)
    if nulls == "zero":
        rows = rows.where(F.exists("x", lambda v: ~none(v))).withColumn("x", F.transform("x", lambda v: F.when(none(v), 0.0).otherwise(v)))
    whole = rows.where("known is not null and fwd is not null and not isnan(fwd)").where(~F.exists("x", none))
    if not by_code:
        return written(whole.select("known", "x", "fwd").mapInArrow(period_rows(p), BLOCKS))
    return written(whole.select("code", "known", "x", "fwd").repartition("code").sortWithinPartitions("code", "known").mapInArrow(block_rows(p), BLOCKS))


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each period, which come in order of periods."""
    known, sums = None, None
    for batch in batches:
        for k, own in zip(batch.column("known").to_pylist(), batch.column("sums"), strict=True):
            own = own.values.to_numpy()
            if k == known:
                sums = sums + own
                continue
            if known is not None:
                yield pa.RecordBatch.from_arrays([pa.array([known], pa.int32()), pa.array([sums])], ["known", "sums"])
            known, sums = k, own
    if known is not None:
        yield pa.RecordBatch.from_arrays([pa.array([known], pa.int32()), pa.array([sums])], ["known", "sums"])


def totals(blocks: DataFrame, salts: int = 16) -> DataFrame:
    """(known, sums) over all codes: first over shares of the codes, then over the shares."""
    add = lambda df, *keys: df.repartition(*keys).sortWithinPartitions(*keys).select("known", "sums").mapInArrow(_added, "known int, sums array<double>")
    shares = add(blocks.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(salts))), "known", "salt")
    return add(shares, "known")


class Windows:
    """The sums of the last `window` periods, or of all, as periods come by in order."""

    def __init__(self, window: int | None):
        self.window, self.held, self.sum = window, deque(), None

    def add(self, known: int, sums: np.ndarray):
        self.held.append((known, sums))
        if self.window is None:
            self.sum = sums if self.sum is None else self.sum + sums
            self.held.clear()

    def upto(self, period: int) -> np.ndarray | None:
        if self.window is None:
            return self.sum
        while self.held and self.held[0][0] <= period - self.window:
            self.held.popleft()
        return sum(s for _, s in self.held) if self.held else None


MODELS = "code string, period int, mean array<double>, sd array<double>, weight array<double>, n long"


def _models(rows: Iterable[tuple]) -> pa.RecordBatch:
    codes, own, models = zip(*rows, strict=True)
    lists = [pa.array([m[c] for m in models], pa.list_(pa.float64())) for c in ("mean", "sd", "weight")]
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(own, pa.int32()), *lists, pa.array([m["n"] for m in models], pa.int64())], [c.split()[0] for c in MODELS.split(", ")])


def _fits(p: int, alpha: float, weigher: str):
    def fits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, period, fit(square(sums.values.to_numpy(), p), p, alpha, weigher)) for period, sums in zip(batch.column("period").to_pylist(), batch.column("sums"), strict=True)]
            found = [f for f in found if f[2]]
            if found:
                yield _models(found)

    return fits


def _host_fits(shared, p: int, alpha: float, weigher: str, window: int | None):
    """A code's rows in order: (code, known, sums, period). Sums of a period come before the period that is scored by it."""

    def fits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, own = None, Windows(window)
        for batch in batches:
            found = []
            for c, at, sums in zip(batch.column("code").to_pylist(), batch.column("known").to_pylist(), batch.column("sums"), strict=True):
                if c != code:
                    code, own = c, Windows(window)
                if sums.as_py() is not None:
                    own.add(at, sums.values.to_numpy())
                    continue
                total, host = shared.value.get(at), own.upto(at)
                model = fit(square(total if host is None else total - host, p), p, alpha, weigher) if total is not None else None
                if model:
                    found.append((code, at, model))
            if found:
                yield _models(found)

    return fits


def models(own: DataFrame, asked: DataFrame, p: int, window: int | None = None, exclude_host: bool = False, alpha: float = 0.0005, weigher: str = "ic") -> DataFrame:
    """MODELS, written: a fit for each period of asked (code, period), or for each of its rows where the host is excluded.

    What a period's fit sums up is a row a period; these rows are bounded by the calendar and the number of factors.
    """
    spark = own.sparkSession
    every = [r["period"] for r in asked.select("period").distinct().orderBy("period").collect()]  # a number a period
    n_sums = len(every) * (p + 2) * (p + 3) // 2
    if n_sums > MOST_SUMS:
        raise ValueError(f"{n_sums} sums of all periods are more than {MOST_SUMS}: take fewer factors or longer periods")
    sums = {r["known"]: np.array(r["sums"]) for r in totals(own).toLocalIterator()}
    running, of = Windows(window), {}
    left = sorted(sums)
    for period in every:
        while left and left[0] <= period:
            running.add(left[0], sums[left.pop(0)])
        found = running.upto(period)
        if found is not None:
            of[period] = found
    if exclude_host:
        shared = spark.sparkContext.broadcast(of)
        rows = own.select("code", "known", "sums").union(asked.select("code", F.col("period"), F.lit(None).cast("array<double>")))
        rows = rows.repartition("code").sortWithinPartitions("code", "known", F.col("sums").isNull())
        return written(rows.mapInArrow(_host_fits(shared, p, alpha, weigher, window), MODELS))
    if not of:
        return spark.createDataFrame([], MODELS)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in of.items()], "period int, sums array<double>").repartition(len(of), "period")
    return written(rows.mapInArrow(_fits(p, alpha, weigher), MODELS))


def scored(rows: DataFrame, found: DataFrame, p: int, by_code: bool) -> DataFrame:
    """(code, date, score) of rows (code, date, period, x) by the models of their period."""
    own = found if by_code else found.drop("code")
    joined = rows.join(own, ["code", "period"] if by_code else "period")
    part = F.transform(F.arrays_zip("x", "mean", "sd", "weight"), lambda f: F.coalesce((f["x"] - f["mean"]) / f["sd"], F.lit(0.0)) * f["weight"])
    score = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    return joined.select("code", "date", F.when(F.exists("x", lambda v: v.isNotNull()), score).alias("score"))


def walk_forward(
    rows: DataFrame, p: int, lag: int = 5, embargo: int | None = None, every: int | None = None, window: int | None = None, exclude_host: bool = False, alpha: float = 0.0005, weigher: str = "ic", nulls: str = "drop", days: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scores, models) of rows (code, date, x array of p factors, fwd): see the head of the module.

    days: the dates of rows, if these come from stored tables; rows are then made for the fit and again for the scores.
    """
    calendar = written(periods(rows if days is None else days, lag, embargo, every))
    dated = rows.join(F.broadcast(calendar), "date")  # a row a trading day
    if days is None:
        dated = written(dated)
    own = blocks(dated, p, nulls, by_code=exclude_host)
    asked = dated.select("code", "period").distinct() if exclude_host else calendar.select(F.lit(None).cast("string").alias("code"), "period").distinct()
    found = models(own, asked, p, window, exclude_host, alpha, weigher)
    return scored(dated, found, p, exclude_host), found
