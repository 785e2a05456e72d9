from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import analysis, indicators, selection, universe, walkforward

DAY = dt.date(2020, 1, 1)


def daily_bars(spark, n=230):
    """Two codes, one of them with days and whole weeks without a bar."""
    rng, rows = np.random.default_rng(7), []
    for code in ("a", "b"):
        price = 100.0
        for t in range(n):
            day = DAY + dt.timedelta(days=t + t // 5 * 2)
            if code == "b" and (t % 7 == 3 or 60 <= t < 75):
                continue
            open_, price = price, price * (1 + 0.02 * float(rng.normal()) + 0.01 * math.sin(t / 9))
            rows.append((code, day, open_, max(open_, price) * 1.01, min(open_, price) * 0.99, price, float(rng.integers(1, 90))))
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double")


def test_running_weeks_against_a_series_for_each_day(spark):
    """The weekly score of each day by the plain operators over all weeks up to that day, the last one cut off there."""
    daily = daily_bars(spark).cache()
    days = daily.select(F.col("code").alias("who"), F.col("date").alias("day")).where("pmod(datediff(day, date'2020-01-01'), 3) = 0")
    series = daily.join(days, (F.col("code") == F.col("who")) & (F.col("date") <= F.col("day"))).withColumn("code", F.concat_ws("|", "who", "day"))
    weeks = universe.weekly(series).withColumnRenamed("week", "date").cache()
    scored = indicators.triggers(indicators.with_indicators(weeks)).select("code", "date", indicators.score().alias("score"))
    hand = {r.code: r.score if r.n >= walkforward.LEAST_WEEKS else 0 for r in scored.groupBy("code").agg(F.max_by("score", "date").alias("score"), F.count("*").alias("n")).collect()}
    found = {f"{r.code}|{r.date}": r.weekly_score for r in walkforward.weekly_scores(daily).collect()}
    assert len(found) == daily.count() and len(hand) > 100
    assert {k: found[k] for k in hand} == hand and len({v for v in hand.values()}) > 4


def test_verdicts_join_both_scores(spark):
    daily = daily_bars(spark)
    found = walkforward.verdicts(daily).collect()
    assert len(found) == daily.count() - 2 * (walkforward.LEAST_DAYS - 1)
    for r in found:
        bonus = 2 if r.daily_score >= 3 and r.weekly_score >= 1 else -2 if r.daily_score <= -3 and r.weekly_score <= -1 else 0
        final = max(-10, min(10, 0.7 * r.daily_score + 0.3 * r.weekly_score + bonus))
        assert r.final_score == pytest.approx(final)
        assert r.verdict == ("strong_buy" if final >= 6 else "buy" if final >= 2 else "strong_sell" if final <= -6 else "sell" if final <= -2 else "neutral")


def test_few_days_have_no_verdicts(spark):
    daily = daily_bars(spark)
    assert walkforward.verdicts(daily.where("date < '2020-01-20'")).count() == 0
    assert walkforward.verdicts(daily.where("false")).count() == 0


def test_chunks_have_even_bounds(spark):
    rng = np.random.default_rng(1)
    own = [(f"c{t // 7}", DAY + dt.timedelta(days=t), float(rng.normal()), float(rng.normal())) for t in range(31)]
    df = spark.createDataFrame(own, "code string, date date, f double, fwd double")
    own.sort()
    edges, x, y = np.linspace(0, 31, 5, dtype=int), np.array([r[2] for r in own]), np.array([r[3] for r in own])
    ics = np.array([np.corrcoef(x[a:b].argsort().argsort(), y[a:b].argsort().argsort())[0, 1] for a, b in zip(edges, edges[1:], strict=False)])
    r = analysis.chunk_ir(df, ["f"], 4).first()
    assert r.mean_ic == pytest.approx(ics.mean()) and r.ir == pytest.approx(ics.mean() / ics.std())


def test_gates_of_a_selection(spark):
    metrics = spark.createDataFrame([("a", 0.5, 0.9), ("b", 0.4, -0.8), ("c", 0.3, 0.01), ("d", 0.2, 0.5), ("e", 0.1, None)], "factor string, abs_ic_mean double, ic_ir double")
    corr = spark.createDataFrame([("a", "b", -0.7), ("b", "a", -0.7), ("a", "d", 0.1), ("d", "a", 0.1)], "a string, b string, corr double")
    bad = spark.createDataFrame([("a", 0.5), ("d", 0.6)], "factor string, degenerate double")
    assert analysis.pick(metrics, corr, 5) == ["a", "c", "d", "e"]
    assert analysis.pick(metrics, corr, 5, 0.71, least_ir=0.05) == ["a", "b", "d"]
    assert analysis.pick(metrics, corr, 5, least_ir=0.05, degenerate=bad) == ["a"]


def test_winners_are_better_on_both_halves(spark):
    half = lambda rows: spark.createDataFrame(rows, "factor string, abs_ic_mean double, ic_ir double, degenerate double")
    first = half([("f", 0.05, -0.3, 0.0), ("good", 0.08, 0.5, 0.1), ("once", 0.09, 0.6, 0.0), ("thin", 0.09, 0.6, 0.2), ("none", None, None, 0.0)])
    second = half([("f", 0.05, 0.3, 0.0), ("good", 0.08, -0.5, 0.0), ("once", 0.06, 0.6, 0.0), ("thin", 0.09, 0.6, 0.0), ("none", 0.2, 0.9, 0.0)])
    pairs = spark.createDataFrame([("f", v) for v in ("good", "once", "thin", "none", "absent")], "base string, variant string")
    assert {r.variant: r.passes for r in selection.winners(first, second, pairs).collect()} == {"good": True, "once": False, "thin": False, "none": False}


def test_small_helpers(spark):
    texts = spark.createDataFrame([("2020-02-29",), ("2021-02-29",), ("2020-2-9",), ("",), (None,), ("2020-01-01 ",)], "t string")
    assert [r[0] for r in texts.select(selection.date_of_text(F.col("t"))).collect()] == [dt.date(2020, 2, 29), None, None, None, None, None]
    quarters = spark.createDataFrame([(dt.date(2021, 5, 31),)], "d date").select(F.inline(selection.recent_quarters(F.col("d"), 4))).collect()
    assert [tuple(r) for r in quarters] == [(2021, 2), (2021, 1), (2020, 4), (2020, 3)]
    few = spark.createDataFrame([("a", DAY + dt.timedelta(days=t)) for t in range(5)] + [("b", DAY)], "code string, date date")
    assert sorted((r.code, r.date.day) for r in selection.after_warmup(few, 3).collect()) == [("a", 4), ("a", 5), ("b", 1)]


def test_verdicts_send_no_days_or_weeks_to_the_driver(spark):
    """Spark took a row a code and week, and a row a code and day, for small sides and broadcast them."""
    daily = daily_bars(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = walkforward.verdicts(daily)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and plan.count("Join") == 1
