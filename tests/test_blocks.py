"""Windows over blocks against Spark's own windows, to the bit, and the results in which rounding once decided."""

from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.factors import library, table
from barloom.operators import cross, indicators, library_analysis, series
from barloom.plans import blocks
from barloom.plans.expression import Expression, column, evaluate, lift, places, tidy
from barloom.sources import adapters

DAY = dt.date(2020, 1, 6)
x, y = column("x"), column("y")
ALONG = {
    "lag": series.delay(x, 3), "lead": series.lead(x, 2), "sum": series.ts_sum(x, 7), "mean": series.mean(x, 4), "pop": series.ts_std(x, 6), "samp": series.rolling("stddev_samp", x, 5, 2), "min": series.ts_min(x, 5),
    "max": series.ts_max(x, 5), "since": series.ts_argmax(x, 6), "since_least": series.ts_argmin(x, 6), "rank": series.ts_rank(x, 5), "product": series.ts_product(x, 4), "cov": series.covariance(x, y, 5),
    "decay": series.decay_linear(x, 6), "slope": series.regression_slope(x, 5), "skew": series.rolling_skew(x, 8), "kurt": series.rolling_kurt(x, 8), "nested": series.ts_rank(series.ts_sum(x, 3), 4),
}
ACROSS = {"rank": cross.rank(x), "scale": cross.scale(x), "demean": cross.demean(x), "solo": cross.industry_neutral(x), "back": series.ts_sum(cross.rank(series.ts_sum(x, 3)), 3)}


def rows(seed: int = 3, codes: int = 40, days: int = 30) -> pd.DataFrame:
    """Codes of very different length with gaps, ties and flat stretches, in no order."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(codes):
        n = 400 if c == 0 else int(rng.integers(1, days))
        v = np.where(rng.random((n, 2)) < 0.15, None, np.round(rng.normal(size=(n, 2)) * 10.0 ** rng.integers(-2, 4), 1))
        out += [(f"c{c:03d}", DAY + dt.timedelta(days=k), v[k, 0], v[k, 1], f"i{c % 5}") for k in range(n)]
    return pd.DataFrame(out, columns=["code", "date", "x", "y", "solo"]).sample(frac=1, random_state=seed)


def left_to_spark(node: Expression) -> Expression:
    return Expression(node.kind, node.text, tuple(left_to_spark(a) for a in node.args), None, node.by)


@pytest.mark.parametrize("outputs", [ALONG, ACROSS], ids=["along", "across"])
def test_blocks_agree_with_windows(spark, outputs):
    own = spark.createDataFrame(rows().astype(object).where(rows().notna(), None), "code string, date date, x double, y double, solo string")
    mine = evaluate(own, outputs, rounded=False).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    want = evaluate(own, {k: left_to_spark(v) for k, v in outputs.items()}, rounded=False).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    assert len(mine) == len(want) == len(rows())
    for name in outputs:
        exact = outputs is ALONG and name not in ("skew", "kurt")
        np.testing.assert_allclose(mine[name].to_numpy(float), want[name].to_numpy(float), rtol=0 if exact else 1e-12, atol=0 if exact else 1e-12, err_msg=name)


def test_batches_of_factors_have_no_sliding_frames(spark):
    """A frame slid over a row at a time took most of the time, and a sort for each rank most of the memory."""
    panel = spark.createDataFrame([], "code string, date date, open double, high double, low double, close double, volume double, is_bar boolean, ind string, solo string, ind_or_unknown string")
    for family, k in (("alpha101_variants", 2), ("alpha101", 5), ("gtja191", 4)):
        text = io.StringIO()
        with redirect_stdout(text):
            library.factors(panel, library.batches(family)[k]).explain()
        assert "Window" not in text.getvalue() and "MapInArrow" in text.getvalue()


def by_day(spark, values: list[tuple]) -> pd.DataFrame:
    return spark.createDataFrame([("a", DAY + dt.timedelta(days=k), *v) for k, v in enumerate(values)], "code string, date date, x double, y double")


def test_two_pairs_that_vary_have_a_correlation(spark):
    """Sums with a spread near the least one: rounding put the coefficient above 1, and it was dropped."""
    rng = np.random.default_rng(0)
    base = 30000 + rng.random(300)
    own = by_day(spark, [(float(b + k % 2 * 3e-7), float(b / 3 + k % 2 * 4e-7)) for b, pair in zip(base, range(300)) for k in (0, 1)])
    found = evaluate(own, {"r": series.correlation(x, y, 2)}, rounded=False).orderBy("date").toPandas()["r"].to_numpy(float)[1::2]
    assert len(found) == 300 and np.isfinite(found).all() and (np.abs(found) <= 1).all()


def test_one_value_has_no_spread(spark):
    own = by_day(spark, [(None, 0.0)] * 3 + [(1.3, 0.0)] + [(None, 0.0)] * 12 + [(2.0, 0.0)])
    found = evaluate(own, {"s": series.ewm_half_std(x, 10)}, rounded=False).orderBy("date").toPandas()["s"]
    assert found[:16].isna().all() and found[16] > 0


def test_powers_are_the_c_library_s(spark):
    import math

    rng = np.random.default_rng(1)
    values = [(float(u), float(v)) for u, v in zip(0.1 + 0.9 * rng.random(4000), rng.normal(size=4000) * 80)]
    found = evaluate(by_day(spark, values), {"p": series.signed_power(x, y, exact=True)}, rounded=False).orderBy("date").toPandas()["p"]
    assert found.tolist() == [math.pow(u, v) for u, v in values]
    assert lift(1).there is None


def test_daily_coefficients_by_columns_and_by_rows(spark):
    """A row for each factor, code and day took the library past its time; columns give the same coefficients."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        for c in range(60):
            v = [None if rng.random() < 0.2 else float(np.round(rng.normal(), 2)), 1.0, float(rng.normal()) if c < 2 else None, None if k == 3 else float(rng.normal())]
            rows.append((f"c{c}", DAY + dt.timedelta(days=k), None if rng.random() < 0.1 else float(rng.normal()), None if c == 7 else 1.0, *v))
    names = ["a", "flat", "rare", "gone"]
    wide = spark.createDataFrame(rows, "code string, date date, fwd double, close double, a double, flat double, rare double, gone double")
    order = lambda df: df.toPandas().sort_values(["factor", "date"]).reset_index(drop=True)
    mine = order(library_analysis.daily_ic_wide(wide, names))
    want = order(library_analysis.daily_ic(wide.unpivot(["code", "date", "fwd", "close"], names, "factor", "value")))
    np.testing.assert_allclose(mine["ic"].to_numpy(float), want["ic"].to_numpy(float), rtol=1e-12, atol=1e-14)
    assert mine[["factor", "date", "usable", "degenerate"]].equals(want[["factor", "date", "usable", "degenerate"]])


def test_scores_as_vectors_by_columns_and_by_rows(spark, sf_dir):
    """Two batches, brought together by a row a batch and by a row a factor."""
    names, panel = library.batches("gtja191")[0][:3] + library.batches("gtja191")[1][:2], adapters.panel(spark, sf_dir).where("date < '1996-01-01'")
    day = Window.partitionBy("factor", "date")
    spread = F.stddev_pop("value").over(day)
    rows = table.factor_rows(panel, names, 3).where("value is not null")
    rows = rows.withColumn("value", F.when(spread > 1e-12, (F.col("value") - F.avg("value").over(day)) / spread))
    order = lambda df: df.toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    mine, want = order(table.score_vectors(panel, names, 3)), order(table.as_vectors(rows, names))
    assert len(mine) == len(want) > 100 and mine[["code", "date"]].equals(want[["code", "date"]])
    np.testing.assert_allclose(np.array(mine["x"].tolist(), float), np.array(want["x"].tolist(), float), rtol=1e-9, atol=1e-12)


def test_indicators_need_no_join(spark):
    """The bars were read and exchanged twice, once to be joined to their own indicators."""
    own = spark.createDataFrame([], "code string, date date, open double, high double, low double, close double, volume double")
    text = io.StringIO()
    with redirect_stdout(text):
        indicators.with_indicators(own).explain()
    assert "Join" not in text.getvalue() and indicators.with_indicators(own).columns[:7] == own.columns


def test_values_are_rounded_as_sql_rounds_them(spark):
    """Spark rounds a value's decimal digits: 1.0000000005 and what lies just below it parted, which are one value in SQL."""
    import duckdb

    rng = np.random.default_rng(2)
    halves = (rng.integers(-(10**7), 10**7, 3000) + 0.5) / 1e9
    v = np.concatenate([halves, np.nextafter(halves, 0), np.nextafter(halves, 9), rng.normal(size=3000) * 10.0 ** rng.integers(-12, 17, 3000), [0.0, -0.0, 0.5, 0.49999999999999994, 2.0**52 + 1, 1e300]])
    own = pd.DataFrame({"k": range(len(v)), "v": v})
    sql = duckdb.sql(f"SELECT round(v, 9) AS p, {tidy('v')} AS t FROM own ORDER BY k").df()
    assert blocks.places(v, 9).tolist() == sql["p"].tolist()
    assert blocks.tidy(v).tolist() == sql["t"].tolist() and not np.signbit(blocks.tidy(np.array([-0.0, -1e-12]))).any()
    found = spark.createDataFrame(own).selectExpr("k", f"{places('v', 9)['spark']} AS p").orderBy("k").toPandas()["p"]
    assert found.tolist() == sql["p"].tolist()
    ranked = by_day(spark, []).union(spark.createDataFrame([(f"c{k}", DAY, float(w), None) for k, w in enumerate(v[:9000])], "code string, date date, x double, y double"))
    mine = evaluate(ranked, {"r": cross.rank(x)}, rounded=False).toPandas().set_index("code")["r"]
    want = pd.Series(sql["p"][:9000].rank(method="average").to_numpy() / 9000, [f"c{k}" for k in range(9000)])
    np.testing.assert_allclose(mine[want.index].to_numpy(), want.to_numpy(), rtol=1e-15)


def test_tidied_columns_keep_null_and_nan(spark):
    own = spark.createDataFrame([("a", DAY, None, float("nan")), ("b", DAY, 1.00000049, -1e-12)], "code string, date date, x double, y double")
    found = {r["code"]: r for r in evaluate(own, {"p": column("x"), "q": column("y")}, also=("x",)).collect()}
    assert found["a"]["p"] is None and np.isnan(found["a"]["q"]) and found["b"]["p"] == 1.0 and found["b"]["q"] == 0 and found["b"]["x"] == 1.00000049


def test_doubles_go_to_workers_as_one_column(spark):
    """Spark asked the size of every column for every row that it sent to a worker, which took most of a batch's time."""
    panel = spark.createDataFrame([], "code string, date date, open double, high double, low double, close double, volume double, is_bar boolean, ind string, solo string, ind_or_unknown string")
    df = library.factors(panel, library.batches("alpha101")[5])
    plan = df._jdf.queryExecution().optimizedPlan()
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("extended")
    assert "CASE WHEN (abs" not in plan.toString().split("MapInArrow")[0] and text.getvalue().count("_doubles") >= plan.toString().count("MapInArrow") > 2


def test_bars_are_sorted_after_their_exchange_alone(spark, sf_dir):
    """Each split of the shipments was sorted whole before the exchange, in memory that grew with the split."""
    plan = adapters.bars(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.rsplit("Exchange", 1)
    assert plan.count("Exchange") == 1 and "Aggregate" in above and "Sort" not in below and "Aggregate" not in below


def test_tree_rows_make_one_panel(spark, sf_dir, monkeypatch):
    """The bars were made twice, once for the labels and once for the factors."""
    from barloom import library_queries

    made, own = [], adapters.panel
    monkeypatch.setattr(library_queries.shared, "written", lambda df: df)
    monkeypatch.setattr(library_queries.src, "panel", lambda *a: made.append(1) or own(*a))
    assert "fwd" in library_queries.tree_rows(spark, sf_dir).columns and len(made) == 1


def test_tree_rows_join_no_panels(spark, sf_dir, monkeypatch):
    """The rows are joined as often as the panel is: labels come along, so no join has a panel on either side."""
    from barloom import library_queries
    from barloom.sources import adapters, shared

    monkeypatch.setattr(shared, "written", lambda df: df)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(library_queries.tree_rows(spark, sf_dir)) == joins(adapters.panel(spark, sf_dir))


def test_coefficients_of_degenerate_days_too(spark):
    """As the plain coefficients and degenerate days are, but from a day's rows at once; and labels come with the panel."""
    from barloom.operators import analysis, library_analysis

    rng, rows = np.random.default_rng(8), []
    for t in range(6):
        for c in range(40):
            f, g = float(rng.normal()), float(rng.integers(0, 4))
            rows.append((f"c{c}", dt.date(2020, 1, 1) + dt.timedelta(days=t), None if t == 2 and c > 1 else f, None if t == 3 else 1.0 if t == 4 else g, None if c == 7 else float(rng.normal()), 1.0))
    own = spark.createDataFrame(rows, "code string, date date, f double, g double, fwd double, close double")
    found = library_analysis.daily_ic_wide(own, ["f", "g"], None, 0.03, 0.06, also_degenerate=True).collect()
    want = {(r.factor, r.date): r.ic for r in analysis.daily_ic(own, ["f", "g"]).collect()}
    assert {(r.factor, r.date) for r in found} == want.keys() and any(r.degenerate and r.ic is not None for r in found)
    assert {(r.factor, r.date): r.ic for r in found} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_labelled_rows_join_no_panels(spark, sf_dir, monkeypatch):
    from barloom import market_queries
    from barloom.sources import adapters, shared

    monkeypatch.setattr(shared, "written", lambda df: df)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(market_queries.labelled(spark, sf_dir)) == joins(adapters.panel(spark, sf_dir))
