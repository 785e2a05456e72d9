from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import analysis, fundamentals, modelling, simulate, universe
from barloom.queries import ORACLES, QUERIES

DAY = dt.date(2020, 1, 1)
CHECKED = [
    "bars_weekly", "panel_grid", "tradability_mask", "eligibility", "candidate_pool_stratified", "top_k_capped", "recommendation_pool", "weekly_resample", "factors_technical", "factors_ewma", "factors_correlation", "factors_breadth",
    "factors_alpha101_03", "factors_gtja191_05", "factors_alpha101_variants_04", "daily_ic", "factor_newey_west", "ic_correlation", "regime_ic", "chunk_ir", "cs_industry_and_size", "facts_as_of", "factors_fundamental", "triggers",
    "curve_metrics", "rebalance_log", "stream_weekly_volume", "verdict_statistics", "bars_after_warmup", "metric_spread", "variant_winners", "selection_json", "selection_diff", "ir_weights",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, sf_dir, duck, name):
    a, b = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    keys = [c for c in a.columns if a[c].dtype.kind != "f"] or list(a.columns)
    a, b = (x.sort_values(keys, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (a, b))
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-5, atol=2e-6, err_msg=c)
        else:
            assert [str(v)[:10] if isinstance(v, (dt.date, pd.Timestamp)) else str(v) for v in a[c]] == [str(v)[:10] if isinstance(v, (dt.date, pd.Timestamp)) else str(v) for v in b[c]], c


def test_every_query_has_a_plan(spark, sf_dir):
    for name in ("ts_mean", "cs_rank", "factors_gtja191_01", "simulate_single"):
        assert QUERIES[name](spark, sf_dir).columns


def bars(spark, rows, more=""):
    return spark.createDataFrame([(c, DAY + dt.timedelta(days=t), *r) for c, t, *r in rows], f"code string, date date, open double, close double, enter boolean, leave boolean, reset boolean{more}")


def test_single_position_by_hand(spark):
    rows = [("a", 0, 10.0, 10.0, True, False, False), ("a", 1, 11.0, 12.0, False, False, False), ("a", 2, 12.0, 13.0, False, True, False), ("a", 3, 14.0, 15.0, False, False, False)]
    found = simulate.single(bars(spark, rows), [5], buy=0.01, sell=0.02).orderBy("date").toPandas()
    bought = 0.99 * 12 / 11
    want = [1.0, bought, bought * 13 / 12, bought * 14 / 12 * 0.98]
    assert found["equity"].tolist() == pytest.approx(want) and found["position"].tolist() == [0, 1, 1, 0] and found["trades"].tolist() == [0, 0, 0, 1]


def test_limits_block_fills(spark):
    rows = [("a", 0, 10.0, 10.0, True, False, False, 0.1), ("a", 1, 11.0, 11.0, True, False, False, 0.1), ("a", 2, 11.0, 11.0, False, True, False, 0.1), ("a", 3, 9.9, 9.9, False, True, False, 0.1), ("a", 4, 9.0, 9.5, False, False, False, 0.1)]
    found = simulate.single(bars(spark, rows, ", lim double"), [9], 0.0, 0.0, limit="lim").orderBy("date").toPandas()
    assert found["position"].tolist() == [0, 0, 1, 1, 0], "no buy at the upper limit, no sale at the lower one"


def test_flat_prices_keep_equity_but_costs(spark):
    quotes = spark.createDataFrame([(0, t, DAY + dt.timedelta(days=t), c, 10.0, 10.0) for t in range(6) for c in "abc"], "offset int, didx int, date date, code string, open double, close double")
    chosen = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 3, "c")], "offset int, didx int, code string")
    found = simulate.portfolio(quotes, chosen, 0.01, 0.02).orderBy("date").toPandas()
    assert found["equity"].tolist() == pytest.approx([1.0, 1.0, 0.99, 0.99, 0.99 * 0.98 * 0.99, 0.99 * 0.98 * 0.99])
    assert found["num_positions"].tolist() == [0, 0, 2, 2, 1, 1]


def test_lots_keep_cash(spark):
    rows = [("a", t, 10.0, 10.0, t < 4, False, False, 0.3) for t in range(8)]
    found = simulate.lots(bars(spark, rows, ", size double"), hold=3, capacity=2, buy=0.0, sell=0.0).orderBy("date").toPandas()
    assert found["equity"].tolist() == pytest.approx([1.0] * 8) and found["position"].max() == 2
    assert found["cash"].tolist()[:3] == pytest.approx([1.0, 0.7, 0.4])


def test_greedy_cap_is_two_row_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{k:03d}", DAY, f"i{rng.integers(0, 6)}" if rng.random() > 0.2 else None, float(rng.integers(0, 30))) for k in range(120)]
    taken, held = [], {}
    for code, _, ind, score in sorted(rows, key=lambda r: (-r[3], r[0])):
        group = ind or "Unknown"
        if len(taken) < 15 and held.get(group, 0) < 3:
            taken.append(code)
            held[group] = held.get(group, 0) + 1
    found = universe.capped_top(spark.createDataFrame(rows, "code string, date date, industry string, score double"), 15, 3)
    assert [r.code for r in found.orderBy("place").collect()] == taken


def test_nothing_is_known_before_it_is_published(spark):
    panel = spark.createDataFrame([("a", DAY + dt.timedelta(days=t), 1.0) for t in range(400)], "code string, date date, close double")
    facts = spark.createDataFrame([("a", DAY, DAY + dt.timedelta(days=10), 1.0), ("a", DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=10), 2.0), ("a", DAY, DAY + dt.timedelta(days=20), None)], "code string, stat_date date, pub_date date, roe double")
    found = {(r.date - DAY).days: r.roe for r in fundamentals.as_of(panel, facts, ["roe"]).collect()}
    assert all(found[t] is None for t in range(10)) and found[10] == found[260] == 2.0 and found[261] is None


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    y = x @ np.array([1.0, -0.5, 0, 0, 0.05, 0]) + rng.normal(size=500)
    gram, cross, alpha = x.T @ x / 500, x.T @ y / 500, 0.1
    w = modelling.lasso(gram, cross, alpha)
    slack = cross - gram @ w
    assert np.abs(slack[w == 0]).max() <= alpha + 1e-8 and slack[w != 0] == pytest.approx(alpha * np.sign(w[w != 0]))
    assert (w != 0)[:2].all() and w[5] == 0


def test_walk_forward_knows_only_the_past(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(200):
        for c in range(5):
            x = float(rng.normal())
            rows.append((f"c{c}", DAY + dt.timedelta(days=t), DAY + dt.timedelta(days=t + 10), x, float(rng.normal()), x * (1 if t < 100 else -1) + 0.1 * float(rng.normal())))
    df = spark.createDataFrame(rows, "code string, date date, known date, f double, g double, fwd double")
    scores, models = modelling.walk_forward(df, ["f", "g"])
    table = models.where("factor = 'f'").orderBy("month").toPandas()
    assert table["month"].min() > DAY and (table["weight"].iloc[:3] > 0.8).all()
    seen = [sum(1 for r in rows if r[2].replace(day=1) < m) for m in table["month"]]
    assert table["n"].tolist() == seen
    assert scores.count() == sum(1 for r in rows if r[1].replace(day=1) in set(table["month"]))


def test_summary_numbers(spark):
    ic = [0.1, 0.3, -0.2, None, 0.4, 0.1, 0.0, 0.2, 0.1, 0.3, 0.2, -0.1]
    df = spark.createDataFrame([("f", DAY + dt.timedelta(days=t), x) for t, x in enumerate(ic)], "factor string, date date, ic double")
    own = np.array([x for x in ic if x is not None])
    r = analysis.summary(df).first()
    assert r.days == 11 and r.ic_ir == pytest.approx(own.mean() / own.std())
    rho = (own[1:] * own[:-1]).sum() / (own[:-1] ** 2).sum()
    assert analysis.half_life(df).first().half_life == pytest.approx(math.log(0.5) / math.log(rho))
    d, n = own - own.mean(), len(own)
    nw = (d * d).sum() + 2 * sum((1 - k / 6) * (d[k:] * d[:-k]).sum() for k in range(1, 6))
    assert analysis.newey_west(df).first().nw_std == pytest.approx(math.sqrt(max(nw, 0) / n))


def test_combined_scores_need_both_far_enough(spark):
    from barloom.operators import indicators

    rows = [(3, 1), (2, 1), (3, 0), (-3, -1), (-2, -5), (10, 10), (-10, -10), (0, 0)]
    found = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double").select("a", "b", indicators.combined(F.col("a"), F.col("b")).alias("c")).collect()

    def hand(a, b):
        bonus = 2 if a >= 3 and b >= 1 else -2 if a <= -3 and b <= -1 else 0
        return max(-10, min(10, 0.7 * a + 0.3 * b + bonus))

    assert all(abs(r.c - hand(r.a, r.b)) < 1e-12 for r in found)


def test_facts_are_carried_for_a_bounded_number_of_days(spark):
    """Against a walk along the calendar: nulls, two reports of a day, a report on a day without bars, and a stale one."""
    day = lambda k: DAY + dt.timedelta(days=k)
    panel = [(c, day(k), 1.0) for c in ("a", "b") for k in range(0, 600, 2) if not (c == "b" and k < 40)]
    facts = [("a", day(10), day(21), 1.0, None), ("a", day(5), day(21), 9.0, 2.0), ("a", day(30), day(50), None, 3.0), ("b", day(3), day(30), 5.0, None), ("c", day(3), day(30), 7.0, 7.0)]
    found = fundamentals.as_of(spark.createDataFrame(panel, "code string, date date, x double"), spark.createDataFrame(facts, "code string, stat_date date, pub_date date, p double, q double"), ["p", "q"]).collect()
    calendar = sorted({d for _, d, _ in panel} | {f[2] for f in facts})

    def hand(code, date, k):
        last = None
        for own in sorted((f[2], f[1], f[k]) for f in facts if f[0] == code and f[2] <= date and f[k] is not None):
            last = own
        return last[2] if last and calendar.index(date) - calendar.index(last[0]) <= fundamentals.CARRY else None

    assert len(found) == len(panel)
    assert all((r.p, r.q, r.x) == (hand(r.code, r.date, 3), hand(r.code, r.date, 4), 1.0) for r in found)
    assert any(r.p is None for r in found if r.code == "a" and r.date > day(400))
