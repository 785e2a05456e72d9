from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import analysis, gram, library_analysis, modelling

DAY = dt.date(2020, 1, 1)


def made(n_days: int = 150, n_codes: int = 6, p: int = 4, seed: int = 2) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_days):
        for c in range(n_codes):
            x = rng.normal(size=p)
            y = float(x @ np.array([0.5, -0.3, 0.0, 0.1])[:p] * (1 if t < 70 else -1) + 0.3 * rng.normal())
            x = [None if rng.random() < 0.03 else float(v) for v in x]
            rows.append((f"c{c}", DAY + dt.timedelta(days=t), x, None if rng.random() < 0.05 else y))
    return pd.DataFrame(rows, columns=["code", "date", "x", "fwd"])


SCHEMA = "code string, date date, x array<double>, fwd double"


def by_hand(own: pd.DataFrame, period_of: dict, start: int, lag: int, embargo: int, first: int | None, host: str | None, p: int):
    """A fit from raw rows: those whose label and embargo end before bar start, from bar first on, without the host."""
    t = (pd.to_datetime(own["date"]) - pd.Timestamp(DAY)).dt.days
    keep = (t + lag + embargo < start) & own["fwd"].notna() & own["x"].map(lambda x: None not in x)
    if first is not None:
        keep &= t.map(lambda k: period_of.get(k + lag + embargo, 10**9) + 1 >= first)
    if host:
        keep &= own["code"] != host
    rows = own[keep]
    x, y = np.array(rows["x"].tolist(), dtype=float).reshape(-1, p), rows["fwd"].to_numpy(float)
    v = np.column_stack([np.ones(len(y)), x, y])
    return modelling.fit(v.T @ v, p, 0.0005, "ic")


@pytest.mark.parametrize(("every", "window", "host"), [(None, None, False), (15, None, False), (15, 3, False), (15, 3, True), (None, None, True)])
def test_refits_are_those_of_raw_rows(spark, every, window, host):
    own, p, lag, embargo = made(), 4, 3, 4
    rows = spark.createDataFrame([tuple(r) for r in own.itertuples(index=False)], SCHEMA).repartition(5)
    scores, models = gram.walk_forward(rows, p, lag, embargo, every, window, host)
    found = {(r.code, r.period): r for r in models.collect()}
    month = lambda k: (DAY + dt.timedelta(days=k)).month - 1
    period_of = {k: (k // every if every else month(k)) for k in range(150)}
    starts = {q: min(k for k in period_of if period_of[k] == q) for q in set(period_of.values())}
    checked = 0
    for q in sorted(starts):
        for code in (["c0", "c3"] if host else [None]):
            want = by_hand(own, period_of, starts[q], lag, embargo, None if window is None else q - window + 1, code, p)
            got = found.get((code, q))
            assert (want is None) == (got is None), (q, code)
            if want:
                checked += 1
                assert got.n == want["n"]
                for c in ("mean", "sd", "weight"):
                    np.testing.assert_allclose(getattr(got, c), want[c], rtol=1e-8, atol=1e-10)
    assert checked >= 3
    of = {(r.code, r.date): r.score for r in scores.collect()}
    for r in own.sample(80, random_state=1).itertuples():
        t = (r.date - DAY).days
        model = found.get((r.code if host else None, period_of[t]))
        if model is None:
            assert (r.code, r.date) not in of
        else:
            parts = [(0.0 if v is None else (v - m) / s) * w for v, m, s, w in zip(r.x, model.mean, model.sd, model.weight, strict=True)]
            assert of[r.code, r.date] == (pytest.approx(sum(parts)) if any(v is not None for v in r.x) else None)


def test_missing_factors_as_zero_and_too_many_sums(spark, monkeypatch):
    own = made(60)
    rows = spark.createDataFrame([tuple(r) for r in own.itertuples(index=False)], SCHEMA)
    _, models = gram.walk_forward(rows, 4, 3, nulls="zero")
    _, fewer = gram.walk_forward(rows, 4, 3)
    assert models.agg(F.max("n")).first()[0] > fewer.agg(F.max("n")).first()[0]
    assert gram.walk_forward(rows.limit(0), 4, 3)[0].count() == 0
    monkeypatch.setattr(gram, "MOST_SUMS", 10)
    with pytest.raises(ValueError, match="fewer factors"):
        gram.walk_forward(rows, 4, 3)


def test_more_than_a_hundred_factors(spark):
    rng = np.random.default_rng(4)
    p, x = 120, rng.normal(size=(4000, 120))
    y = x[:, 5] - 0.5 * x[:, 77] + rng.normal(size=4000)
    rows = spark.createDataFrame([(f"c{k % 40}", DAY + dt.timedelta(days=k // 40), x[k].tolist(), float(y[k])) for k in range(4000)], SCHEMA)
    _, models = gram.walk_forward(rows, p, 2, alpha=0.05)
    last = models.orderBy(F.desc("period")).first()
    assert {int(j) for j in np.argsort(-np.abs(last.weight))[:2]} == {5, 77}


def test_library_analysis_is_that_of_pandas(spark):
    rng = np.random.default_rng(9)
    rows = []
    for f in ("a", "b", "c", "flat", "sparse"):
        for t in range(30):
            for k in range(25):
                v = {"flat": 1.0, "sparse": float(rng.normal()) if k == 0 else None}.get(f, float(np.round(rng.normal(), 1)) if rng.random() > 0.1 else None)
                rows.append((f, f"c{k}", DAY + dt.timedelta(days=t), v))
    own = pd.DataFrame(rows, columns=["factor", "code", "date", "value"])
    fwd = {(k, t): float(rng.normal()) for k in own["code"].unique() for t in own["date"].unique()}
    own["fwd"] = [fwd[k, t] for k, t in zip(own["code"], own["date"], strict=True)]
    df = spark.createDataFrame([(*(None if isinstance(x, float) and np.isnan(x) else x for x in r), 1.0) for r in own.itertuples(index=False)], "factor string, code string, date date, value double, fwd double, close double")
    ic = library_analysis.daily_ic(df)
    got = {(r.factor, r.date): r for r in ic.collect()}
    for (f, t), g in own.groupby(["factor", "date"]):
        v = g["value"].astype(float)
        r = got[f, t]
        assert r.degenerate == (f == "sparse")  # one of 25 is not less than a hundredth
        if f in "abc":
            x = v.clip(v.quantile(0.01), v.quantile(0.99))
            want = x.rank().corr(g["fwd"].where(v.notna()).rank())
            assert r.ic == pytest.approx(want)
        else:
            assert r.ic is None
    halves = [library_analysis.daily_ic(df.where(F.col("factor").isin(names))) for names in (["a", "b"], ["b", "c", "flat", "sparse"])]
    both = library_analysis.merged(halves)
    assert sorted((r.factor, r.date, r.ic) for r in both.collect() if r.ic) == sorted((r.factor, r.date, r.ic) for r in got.values() if r.ic)
    names = ["a", "b", "c", "flat", "missing"]
    fast = {(r.a, r.b): r.corr for r in library_analysis.ic_correlation(ic.repartition(4), names).collect()}
    slow = {(r.a, r.b): r["corr"] for r in analysis.ic_correlation(ic).collect()}
    assert len(fast) == 25 and all(fast[k] == pytest.approx(slow.get(k, 1.0 if k[0] == k[1] else 0.0)) for k in fast)


def test_sums_by_period_are_few_and_the_same(spark):
    """A row a code and period was larger than the rows it summed up: with p factors (p + 2)(p + 3) / 2 numbers."""
    rng = np.random.default_rng(5)
    own = [(f"c{k % 40}", k % 3, rng.normal(size=4).tolist(), float(rng.normal())) for k in range(600)]
    rows = spark.createDataFrame(own, "code string, known int, x array<double>, fwd double").repartition(4)
    by_code, by_period = gram.blocks(rows, 4), gram.blocks(rows, 4, by_code=False)
    assert by_code.count() == len({r[:2] for r in own}) and by_period.count() <= 4 * 3
    want, got = ({r.known: r.sums for r in gram.totals(b).collect()} for b in (by_code, by_period))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_fit_without_hosts_writes_sums_by_period_alone(spark, monkeypatch):
    rng, asked = np.random.default_rng(6), []
    rows = spark.createDataFrame([(f"c{c}", dt.date(2020, 1, 1) + dt.timedelta(days=t), rng.normal(size=2).tolist(), float(rng.normal())) for c in range(6) for t in range(90)], "code string, date date, x array<double>, fwd double")
    own = gram.blocks
    monkeypatch.setattr(gram, "blocks", lambda *a, **more: asked.append(own(*a, **more)) or asked[-1])
    plain, _ = gram.walk_forward(rows, 2, 3)
    assert asked[0].where("code is not null").count() == 0 and asked[0].count() > 0
    days, _ = gram.walk_forward(rows, 2, 3, days=rows.select("date"))
    scores = [{(r.code, r.date): r.score for r in s.collect()} for s in (plain, days)]
    assert len(scores[0]) > 100 and scores[0].keys() == scores[1].keys() and all(scores[1][k] == pytest.approx(v) for k, v in scores[0].items())
