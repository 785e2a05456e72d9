"""Choosing factors and weighing them as estimators and models of pyspark.ml, with parameters, saved and read again.

A selector's model knows the chosen factors; a weigher's model adds a score, and tells each factor's part of it.
TwoStep fits one after the other, on all factors where the selector leaves none; Monthly does so for every month on
what was known by then, keeps a table of a row a month and factor, and scores each row, or only each code's last one,
by the newest model of its month or before.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import numpy as np

from . import analysis, boosting, gram
from .lasso import lasso


class HasFactors(Params):
    names = Param(Params._dummy(), "names", "columns of the factors", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "column of the forward return", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(label="fwd")

    def factors(self) -> list[str]:
        return self.getOrDefault("names")

    def whole(self, rows: DataFrame) -> DataFrame:
        return rows.dropna(subset=[*self.factors(), self.getOrDefault("label")])


def moments(rows: DataFrame, names: list[str], label: str) -> np.ndarray | None:
    """The matrix of sums of products of (1, factors, label), added up in each task first; None without rows."""
    own = rows.select(F.lit("all").alias("code"), F.lit(0).alias("known"), F.array(*(F.col(n).cast("double") for n in names)).alias("x"), F.col(label).cast("double").alias("fwd"))
    sums = own.mapInArrow(gram.block_rows(len(names)), gram.BLOCKS).withColumn("code", F.spark_partition_id().cast("string"))
    found = gram.totals(sums).first()
    return None if found is None else gram.square(np.array(found["sums"]), len(names))


# selectors


class SelectorModel(Model, HasFactors, DefaultParamsWritable, DefaultParamsReadable):
    chosen = Param(Params._dummy(), "chosen", "the factors that were chosen", TypeConverters.toListString)
    coefficients = Param(Params._dummy(), "coefficients", "of every factor", TypeConverters.toListFloat)

    def selected(self) -> list[str]:
        return self.getOrDefault("chosen")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*(n for n in self.factors() if n not in self.selected()))


class Selector(Estimator, HasFactors, DefaultParamsWritable, DefaultParamsReadable):
    """_coefficients gives a number for each factor, _chosen which of them stay."""

    def _fit(self, dataset: DataFrame) -> SelectorModel:
        found = self._coefficients(self.whole(dataset))
        model = SelectorModel()
        return model._set(names=self.factors(), label=self.getOrDefault("label"), chosen=self._chosen(found), coefficients=[float(found[n]) for n in self.factors()])

    def _coefficients(self, rows: DataFrame) -> dict[str, float]:
        raise NotImplementedError

    def _chosen(self, found: dict[str, float]) -> list[str]:
        return [n for n in self.factors() if abs(found[n]) > 1e-8]


class LassoSelector(Selector):
    alpha = Param(Params._dummy(), "alpha", "penalty on the size of coefficients", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, names=None, label=None, alpha=None):
        super().__init__()
        self._setDefault(alpha=0.0005)
        self._set(**self._input_kwargs)

    def _coefficients(self, rows: DataFrame) -> dict[str, float]:
        names = self.factors()
        sums = moments(rows, names, self.getOrDefault("label"))
        if sums is None:
            return dict.fromkeys(names, 0.0)
        mean, sd, cov, cross = standardised(sums, len(names))
        return dict(zip(names, lasso(cov / np.outer(sd, sd), cross / sd, self.getOrDefault("alpha")).tolist(), strict=True))


class BoostedSelector(Selector):
    top = Param(Params._dummy(), "top", "factors that are chosen at most", TypeConverters.toInt)
    ratio = Param(Params._dummy(), "ratio", "least gain as a share of the largest", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, names=None, label=None, top=None, ratio=None, iterations=None):
        super().__init__()
        self._setDefault(top=20, ratio=0.01, iterations=20)
        self._set(**self._input_kwargs)

    def _coefficients(self, rows: DataFrame) -> dict[str, float]:
        return boosting.importances(boosting.grow(rows, self.factors(), self.getOrDefault("label"), self.getOrDefault("iterations")))

    def _chosen(self, found: dict[str, float]) -> list[str]:
        best = max(found.values(), default=0.0)
        ranked = sorted((n for n in found if found[n] > 0 and found[n] >= best * self.getOrDefault("ratio")), key=lambda n: (-found[n], n))
        return ranked[: self.getOrDefault("top")]


def standardised(sums: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, spreads, covariances of the factors, covariances with the label) of a matrix of sums."""
    n = sums[0, 0]
    mean, y = sums[0, 1 : p + 1] / n, sums[0, p + 1] / n
    cov = sums[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    return mean, np.where(sd < 1e-12, 1.0, sd), cov, sums[1 : p + 1, p + 1] / n - mean * y


# weighers


class WeigherModel(Model, HasFactors, DefaultParamsWritable, DefaultParamsReadable):
    """A score as a weighed sum of standardised factors; a missing factor counts as its mean, a row without any has none."""

    mean = Param(Params._dummy(), "mean", "of each factor", TypeConverters.toListFloat)
    spread = Param(Params._dummy(), "spread", "of each factor", TypeConverters.toListFloat)
    weight = Param(Params._dummy(), "weight", "of each factor", TypeConverters.toListFloat)

    def weights(self) -> dict[str, float]:
        return dict(zip(self.factors(), self.getOrDefault("weight"), strict=True))

    def parts(self) -> dict:
        own = zip(self.factors(), *(self.getOrDefault(c) for c in ("mean", "spread", "weight")), strict=True)
        return {n: F.coalesce((F.col(n) - m) / s, F.lit(0.0)) * w for n, m, s, w in own}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = self.parts()
        if not parts:
            return dataset.withColumn("score", F.lit(0.0))
        return dataset.withColumn("score", F.when(F.coalesce(*map(F.col, parts)).isNotNull(), reduce(lambda a, b: a + b, parts.values())))

    def contributions(self, dataset: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, factor, part): the parts of each row's score."""
        return dataset.select(*keys, *(v.alias(k) for k, v in self.parts().items())).unpivot(keys, self.factors(), "factor", "part")


class Weigher(Estimator, HasFactors, DefaultParamsWritable, DefaultParamsReadable):
    """_raw gives a number for each factor; the weights are these by the sum of their sizes, equal ones if all are nothing."""

    def _fit(self, dataset: DataFrame) -> WeigherModel:
        rows, names = self.whole(dataset), self.factors()
        sums = moments(rows, names, self.getOrDefault("label"))
        model = WeigherModel()._set(names=names, label=self.getOrDefault("label"))
        if sums is None:
            return model._set(mean=[0.0] * len(names), spread=[1.0] * len(names), weight=[1.0 / len(names)] * len(names))
        mean, sd, _, cross = standardised(sums, len(names))
        raw = self._raw(rows, sums, cross / sd)
        size = sum(abs(v) for v in raw.values())
        weight = [raw[n] / size if size > 1e-12 else 1.0 / len(names) for n in names]
        return model._set(mean=mean.tolist(), spread=sd.tolist(), weight=[float(w) for w in weight])

    def _raw(self, rows: DataFrame, sums: np.ndarray, cross: np.ndarray) -> dict[str, float]:
        raise NotImplementedError


class EqualWeigher(Weigher):
    @keyword_only
    def __init__(self, *, names=None, label=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _raw(self, rows, sums, cross):
        return dict.fromkeys(self.factors(), 1.0)


class ICWeigher(Weigher):
    """By the coefficient over all rows; rows need code and date for ranks."""

    rank = Param(Params._dummy(), "rank", "of ranks, or of values", TypeConverters.toBoolean)
    least = Param(Params._dummy(), "least", "smaller coefficients count as nothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, names=None, label=None, rank=None, least=None):
        super().__init__()
        self._setDefault(rank=True, least=0.0)
        self._set(**self._input_kwargs)

    def _raw(self, rows, sums, cross):
        if self.getOrDefault("rank"):
            own = rows.withColumn("fwd", F.col(self.getOrDefault("label")))
            found = {r["factor"]: r["ic"] or 0.0 for r in analysis.pooled_ic(own, self.factors()).collect()}  # a row a factor
        else:
            p = len(self.factors())
            sy = np.sqrt(max(sums[p + 1, p + 1] / sums[0, 0] - (sums[0, p + 1] / sums[0, 0]) ** 2, 0))
            found = dict(zip(self.factors(), (cross / sy if sy > 1e-12 else 0 * cross).tolist(), strict=True))
        return {n: found.get(n, 0.0) if abs(found.get(n, 0.0)) >= self.getOrDefault("least") else 0.0 for n in self.factors()}


class IRWeigher(Weigher):
    """By mean over spread of the coefficients of equal chunks of the rows, one chunk for five rows at most."""

    chunks = Param(Params._dummy(), "chunks", "number of chunks", TypeConverters.toInt)
    rank = Param(Params._dummy(), "rank", "of ranks, or of values", TypeConverters.toBoolean)
    least = Param(Params._dummy(), "least", "smaller ratios count as nothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, names=None, label=None, chunks=None, rank=None, least=None):
        super().__init__()
        self._setDefault(chunks=6, rank=True, least=0.0)
        self._set(**self._input_kwargs)

    def _raw(self, rows, sums, cross):
        own = rows.withColumn("fwd", F.col(self.getOrDefault("label")))
        chunks, method = min(self.getOrDefault("chunks"), max(1, int(sums[0, 0]) // 5)), "spearman" if self.getOrDefault("rank") else "pearson"
        if chunks < 2:
            found = {r["factor"]: r["ic"] or 0.0 for r in analysis.pooled_ic(own, self.factors(), method).collect()}
        else:
            rows_of = analysis.chunk_ir(own, self.factors(), chunks, method).collect()  # a row a factor
            found = {r["factor"]: (r["ir"] if r["ir"] is not None else r["mean_ic"]) or 0.0 for r in rows_of}
        return {n: found.get(n, 0.0) if abs(found.get(n, 0.0)) >= self.getOrDefault("least") else 0.0 for n in self.factors()}


# both steps


class TwoStepModel(Model, HasFactors, MLWritable, MLReadable):
    def __init__(self, selector: SelectorModel | None = None, weigher: WeigherModel | None = None):
        super().__init__()
        self.selector, self.weigher = selector, weigher

    @property
    def fell_back(self) -> bool:
        return not self.selector.selected()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.weigher.transform(dataset)

    def contributions(self, dataset: DataFrame, keys: list[str]) -> DataFrame:
        return self.weigher.contributions(dataset, keys)

    def write(self) -> MLWriter:
        return _PartsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PartsReader(cls)


class _PartsWriter(MLWriter):
    def __init__(self, model: TwoStepModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.selector.save(f"{path}/selector")
        self.model.weigher.save(f"{path}/weigher")


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TwoStepModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(SelectorModel.load(f"{path}/selector"), WeigherModel.load(f"{path}/weigher"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TwoStep(Estimator, HasFactors):
    """A selector and a weigher; the weigher sees the chosen factors, or all if none was chosen."""

    def __init__(self, selector: Selector, weigher: Weigher):
        super().__init__()
        self.selector, self.weigher = selector, weigher
        self._set(names=selector.factors(), label=selector.getOrDefault("label"))

    def _fit(self, dataset: DataFrame) -> TwoStepModel:
        selected = self.selector.fit(dataset)
        own = self.weigher.copy()._set(names=selected.selected() or self.factors(), label=self.getOrDefault("label"))
        model = TwoStepModel(selected, own.fit(dataset))
        return model._set(names=self.factors(), label=self.getOrDefault("label"))


# month by month


class MonthlyModel(Model, HasFactors, MLWritable, MLReadable):
    """table: (month, factor, mean, sd, weight, n), a row a month and factor."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _wide(self) -> DataFrame:
        names = self.factors()
        own = self.table.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct("factor", F.struct("mean", "sd", "weight")))).alias("of"))  # a row a factor
        following = F.lead("month").over(Window.orderBy("month"))  # a row a month
        return own.select("month", following.alias("until"), F.transform(F.array(*map(F.lit, names)), lambda n: F.element_at("of", n)).alias("m"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with score and model_month, the month of the newest model at each row's month; no row is lost."""
        names = self.factors()
        month = F.trunc("date", "month")
        # the months of a table are few: each month of the rows finds its model first, and rows join on the month alone
        months = dataset.select(month.alias("_month")).distinct()
        known = self._wide()
        of_month = months.join(F.broadcast(known), (F.col("_month") >= F.col("month")) & (F.col("until").isNull() | (F.col("_month") < F.col("until")))).select("_month", F.col("month").alias("model_month"), "m")
        joined = dataset.withColumn("_month", month).join(F.broadcast(of_month), "_month", "left")
        parts = [F.coalesce((F.col(n) - F.col("m")[k]["mean"]) / F.col("m")[k]["sd"], F.lit(0.0)) * F.col("m")[k]["weight"] for k, n in enumerate(names)]
        score = F.when(F.coalesce(*map(F.col, names)).isNotNull(), reduce(lambda a, b: a + b, parts))
        return joined.withColumn("score", score).drop("_month", "m")

    def latest(self, dataset: DataFrame) -> DataFrame:
        """The last row of each code with its score."""
        last = dataset.groupBy("code").agg(F.max("date").alias("date"))
        return self.transform(dataset.join(last, ["code", "date"]))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, model: MonthlyModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> MonthlyModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/table"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class Monthly(Estimator, HasFactors, DefaultParamsWritable, DefaultParamsReadable):
    """Lasso and weights anew each month, from rows whose labels had ended, by sums of products that are added up once."""

    lag = Param(Params._dummy(), "lag", "bars until a label has ended", TypeConverters.toInt)
    embargo = Param(Params._dummy(), "embargo", "further bars, the lag unless given", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "penalty of the choice", TypeConverters.toFloat)
    weigher = Param(Params._dummy(), "weigher", "ic or equal", TypeConverters.toString)
    nulls = Param(Params._dummy(), "nulls", "drop or zero", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, names=None, label=None, lag=None, embargo=None, alpha=None, weigher=None, nulls=None):
        super().__init__()
        self._setDefault(lag=5, alpha=0.0005, weigher="ic", nulls="drop")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MonthlyModel:
        names = self.factors()
        own = dataset.select("code", "date", F.array(*(F.col(n).cast("double") for n in names)).alias("x"), F.col(self.getOrDefault("label")).alias("fwd"))
        dated = own.join(gram.periods(own, self.getOrDefault("lag"), self.getOrDefault("embargo") if self.isSet("embargo") else None), "date")
        months = dated.groupBy("period").agg(F.min(F.trunc("date", "month")).alias("month"))
        found = gram.models(gram.blocks(dated, len(names), self.getOrDefault("nulls")), dated.select("code", "period").distinct(), len(names), alpha=self.getOrDefault("alpha"), weigher=self.getOrDefault("weigher"))
        rows = found.join(months, "period").select("month", "n", F.posexplode(F.arrays_zip("mean", "sd", "weight")).alias("k", "m"))
        table = rows.select("month", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("factor"), "m.mean", "m.sd", "m.weight", "n")
        return MonthlyModel(table)._set(names=names, label=self.getOrDefault("label"))
