from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting, modelling, pipeline
from barloom.sources import shared

DAY = dt.date(2020, 1, 1)
NAMES = ["a", "b", "c"]
SCHEMA = "code string, date date, a double, b double, c double, fwd double"


def made(n: int = 1200, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -0.5) + 0.4 * x[:, 1] + 0.05 * rng.normal(size=n)
    return pd.DataFrame({"code": [f"c{k % 8}" for k in range(n)], "date": [DAY + dt.timedelta(days=k // 8) for k in range(n)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "fwd": y})


def frame(spark, own: pd.DataFrame):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in own.itertuples(index=False)], SCHEMA)


def walked(trees: boosting.Trees, row: dict) -> tuple[float, dict]:
    """The score and the parts by walking each tree by hand."""
    score, parts = 0.0, {}
    for tree in trees.trees:
        node = tree[0]
        while node.factor is not None:
            v = row[node.factor]
            to = tree[node.left if v is not None and v <= node.threshold else node.right]
            parts[node.factor] = parts.get(node.factor, 0.0) + to.value - node.value
            node = to
        score += node.value
    return score, parts


def test_contributions_and_base_are_the_score(spark):
    own = made()
    own.loc[::50, "b"] = None
    rows = frame(spark, own)
    trees = boosting.grow(rows, NAMES, iterations=6, depth=3)
    assert len(trees.trees) == 6 and boosting.Trees.of_table(trees.table(spark), NAMES) == trees
    keys = ["code", "date"]
    scores = {(r.code, r.date): r.score for r in rows.select(*keys, boosting.score(trees).alias("score")).collect()}
    parts: dict = {}
    for r in boosting.contributions(rows, trees, keys).collect():
        parts.setdefault((r.code, r.date), {})[r.factor] = r.part
    for r in own.itertuples(index=False):
        score, want = walked(trees, {n: None if np.isnan(getattr(r, n)) else getattr(r, n) for n in NAMES})
        assert scores[r.code, r.date] == pytest.approx(score)
        assert parts[r.code, r.date] == pytest.approx(want)
        assert trees.base + sum(want.values()) == pytest.approx(score)
    whole = own.dropna()
    residual = np.array([scores[r.code, r.date] for r in whole.itertuples()]) - whole["fwd"].to_numpy()
    assert residual.var() < 0.3 * whole["fwd"].var()


def test_a_stump_by_hand(spark):
    own = made(400)
    tree = boosting.grow(frame(spark, own), NAMES, iterations=1, depth=1).trees[0]
    root = tree[0]
    left = own[root.factor] <= root.threshold
    assert root.factor == "a" and root.value == pytest.approx(own["fwd"].mean())
    assert tree[root.left].value == pytest.approx(own["fwd"][left].mean()) and tree[root.right].value == pytest.approx(own["fwd"][~left].mean())
    sse = lambda y: float(((y - y.mean()) ** 2).sum())
    assert root.gain == pytest.approx(sse(own["fwd"]) - sse(own["fwd"][left]) - sse(own["fwd"][~left]))


def test_gain_picks_and_weights(spark):
    rows = frame(spark, made())
    trees = boosting.grow(rows, NAMES, iterations=5)
    shares = boosting.importances(trees)
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["b"] > shares["c"]
    assert [n for n, _ in boosting.picked(trees, 1)] == ["a"] and [n for n, _ in boosting.picked(trees, 20, 0.05)] == ["a", "b"]
    weights = {r.factor: r.weight for r in boosting.weights(rows, trees, ["code", "date"]).collect()}
    assert weights["a"] > weights["b"] > weights["c"]
    assert boosting.top_contributions(rows, trees, ["code", "date"], 2).groupBy("code", "date").count().agg(F.max("count")).first()[0] == 2
    none = boosting.grow(rows.withColumn("fwd", F.lit(1.0)), NAMES)
    assert none.trees == [] and boosting.picked(none) == [] and boosting.contributions(rows, none, ["code", "date"]).count() == 0
    assert {r.weight for r in boosting.weights(rows, none, ["code", "date"]).collect()} == {0.0}


def test_two_steps_by_hand_and_saved(spark):
    own = made()
    own["b"] *= 100
    rows = frame(spark, own).repartition(5)
    step = pipeline.TwoStep(pipeline.LassoSelector(names=NAMES, alpha=0.1), pipeline.ICWeigher(names=NAMES))
    model = step.fit(rows)
    z = (own[NAMES] - own[NAMES].mean()) / own[NAMES].std(ddof=0)
    y = own["fwd"] - own["fwd"].mean()
    w = modelling.lasso((z.T @ z / len(z)).to_numpy(), (z.T @ y / len(z)).to_numpy(), 0.1)
    chosen = [n for n, v in zip(NAMES, w, strict=True) if abs(v) > 1e-8]
    assert model.selector.selected() == chosen == ["a", "b"] and not model.fell_back
    np.testing.assert_allclose(model.selector.getOrDefault("coefficients"), w, atol=1e-8)
    ic = z[chosen].rank().corrwith(own["fwd"].rank())
    want = (z[chosen] * (ic / ic.abs().sum())).sum(axis=1)
    got = model.transform(rows).orderBy("date", "code").toPandas()["score"]
    np.testing.assert_allclose(got, want[own.sort_values(["date", "code"]).index], rtol=1e-7, atol=1e-9)
    path = shared.folder(spark, "model")
    model.save(path)
    again = pipeline.TwoStepModel.load(path)
    assert again.weigher.weights() == model.weigher.weights() and again.selector.selected() == chosen
    np.testing.assert_allclose(again.transform(rows).orderBy("date", "code").toPandas()["score"], got)
    parts = again.contributions(rows, ["code", "date"]).groupBy("code", "date").agg(F.sum("part").alias("s")).orderBy("date", "code").toPandas()["s"]
    np.testing.assert_allclose(parts, got, atol=1e-9)
    for kind in (pipeline.LassoSelector(names=NAMES, alpha=0.2), pipeline.BoostedSelector(names=NAMES, top=2), pipeline.IRWeigher(names=NAMES, chunks=3), pipeline.Monthly(names=NAMES, lag=3)):
        path = shared.folder(spark, "estimator")
        kind.save(path)
        assert {p.name: v for p, v in type(kind).load(path).extractParamMap().items()} == {p.name: v for p, v in kind.extractParamMap().items()}


def test_an_empty_choice_takes_all_factors_and_equal_weights(spark):
    rows = frame(spark, made(200))
    model = pipeline.TwoStep(pipeline.LassoSelector(names=NAMES, alpha=1e6), pipeline.EqualWeigher(names=NAMES)).fit(rows)
    assert model.fell_back and model.weigher.weights() == pytest.approx(dict.fromkeys(NAMES, 1 / 3))
    nothing = pipeline.TwoStep(pipeline.LassoSelector(names=NAMES), pipeline.ICWeigher(names=NAMES)).fit(rows.limit(0))
    assert nothing.weigher.weights() == pytest.approx(dict.fromkeys(NAMES, 1 / 3))
    assert pipeline.BoostedSelector(names=NAMES, top=1, iterations=3).fit(rows).selected() == ["a"]


@pytest.mark.parametrize(("n", "chunks"), [(1200, 4), (12, 6), (7, 6)])
def test_ratio_weights_by_hand(spark, n, chunks):
    own = made(n)
    got = pipeline.IRWeigher(names=NAMES, chunks=chunks, rank=False).fit(frame(spark, own)).weights()
    own = own.sort_values(["code", "date"])
    k = min(chunks, max(1, n // 5))
    bounds = np.linspace(0, n, k + 1, dtype=int)
    raw = {}
    for f in NAMES:
        ics = [np.corrcoef(own[f][lo:hi], own["fwd"][lo:hi])[0, 1] for lo, hi in zip(bounds, bounds[1:], strict=False)]
        raw[f] = np.mean(ics) / np.std(ics) if k > 1 else np.corrcoef(own[f], own["fwd"])[0, 1]
    total = sum(map(abs, raw.values()))
    assert got == pytest.approx({f: v / total for f, v in raw.items()})


def test_monthly_models_and_the_latest_day(spark):
    own = made(8 * 200)
    rows = frame(spark, own)
    model = pipeline.Monthly(names=NAMES, lag=2).fit(rows)
    path = shared.folder(spark, "monthly")
    model.save(path)
    again = pipeline.MonthlyModel.load(path)
    latest = again.latest(rows).collect()
    assert len(latest) == 8 and {r.date for r in latest} == {DAY + dt.timedelta(days=199)} and {r.model_month for r in latest} == {dt.date(2020, 7, 1)}
    every = {(r.code, r.date): r for r in again.transform(rows).collect()}
    assert len(every) == len(own) and all(every[r.code, r.date].score == r.score for r in latest)
    assert every["c0", DAY].model_month is None and every["c0", DAY].score is None
    # a month without a model of its own takes the one before
    later = rows.withColumn("date", F.date_add("date", 400))
    assert {r.model_month for r in again.latest(later).collect()} == {dt.date(2020, 7, 1)}
    m = {r.factor: r for r in again.table.where("month = '2020-07-01'").collect()}
    row = own.iloc[-1]
    assert every[row["code"], row["date"]].score == pytest.approx(sum((row[n] - m[n].mean) / m[n].sd * m[n].weight for n in NAMES))


def test_parts_of_largest_size_with_the_score(spark):
    """Each row's trees walked by hand; told where the row lies, so that no side of a join grows with the rows."""
    own = made()
    own.loc[::50, "b"] = None
    rows = frame(spark, own)
    trees = boosting.grow(rows, NAMES, iterations=6, depth=3)
    found = boosting.explained(rows, trees, ["code", "date"], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "Exchange" not in boosting.top_contributions(rows, trees, ["code", "date"])._jdf.queryExecution().executedPlan().toString()
    parts: dict = {}
    for r in found.orderBy("code", "date", "nth").collect():
        parts.setdefault((r.code, r.date), []).append((r.nth, r.factor, r.part, r.score))
    for r in own.itertuples(index=False):
        score, want = walked(trees, {n: None if np.isnan(getattr(r, n)) else getattr(r, n) for n in NAMES})
        best = sorted(want.items(), key=lambda x: (-abs(x[1]), x[0]))[:2]
        assert [(k, f) for k, f, _, _ in parts[r.code, r.date]] == [(k + 1, f) for k, (f, _) in enumerate(best)]
        assert [p for _, _, p, _ in parts[r.code, r.date]] == pytest.approx([v for _, v in best])
        assert [s for *_, s in parts[r.code, r.date]] == pytest.approx([score] * len(best))
