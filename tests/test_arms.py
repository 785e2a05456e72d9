from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import arms, cross
from barloom.plans.expression import column, evaluate
from barloom.sources import shared
from barloom.streaming import ingest

DAY = dt.date(2020, 1, 6)  # a Monday


def test_configurations_merge_field_by_field():
    base = {"strategy": {"kind": "x", "p": {"a": 1, "b": 2}}, "backtest": {"cost": {"buy": 1, "sell": 2}, "days": [1, 2, 3]}, "name": "base"}
    assert arms.merged(base, {"backtest": {"cost": {"sell": 5}, "days": [9]}}) == {**base, "backtest": {"cost": {"buy": 1, "sell": 5}, "days": [9]}}
    found = arms.effective(base, {"strategy": {"kind": "y"}, "backtest": {"cost": {"buy": None, "sell": 7}, "days": None}, "name": "arm", "other": None})
    assert found == {"strategy": {"kind": "y"}, "backtest": {"cost": {"buy": 1, "sell": 7}, "days": [1, 2, 3]}, "name": "arm"}
    assert base["backtest"]["cost"]["sell"] == 2, "the base stays as it is"
    assert arms.content_hash({"a": 1, "b": {"c": 2, "d": 3}}) == arms.content_hash({"b": {"d": 3, "c": 2}, "a": 1}) != arms.content_hash({"a": 1})
    assert arms.effective({}, {}) == {}


def test_a_failing_arm_takes_no_other_with_it(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("code"), F.col("id").cast("double").alias("x"))
    calls = []

    def build(shared_rows, configuration):
        calls.append(configuration)
        if configuration["how"] == "late":
            return shared_rows.withColumn("y", F.raise_error(F.lit("no such thing")).cast("double"))
        return shared_rows.select("code", (F.col("x") * configuration["how"]).alias("y"))

    found, states = arms.run(rows, {"a": {"how": 1}, "late": {"how": "late"}, "early": {}, "b": {"how": 3}, "again": {"how": 1}}, build)
    told = {r.arm: (r.failed, bool(r.error)) for r in states.collect()}
    assert told == {"a": (False, False), "late": (True, True), "early": (True, True), "b": (False, False), "again": (False, False)}
    assert len(calls) == 4, "arms of one content are run once"
    diff = {r.code: (r.a, r.b, r["diff"]) for r in arms.differences(found, "code", ["y"], "a", "b").collect()}
    assert diff["2"] == (2.0, 6.0, 4.0) and len(diff) == 10
    nothing, states = arms.run(rows, {"early": {}}, build)
    assert nothing is None and states.first().failed


def test_codes_of_a_configuration(spark):
    listed, pool = (spark.createDataFrame([(c,) for c in own], "code string") for own in ("abca", "cde"))
    of = lambda configuration, pool=pool: {r.code for r in arms.codes_of(configuration, listed, pool).collect()}
    assert of({}) == {"a", "b", "c"} and of({"use_pool": True}) == {"c", "d", "e"} and of({"use_pool": True}, None) == {"a", "b", "c"}
    assert of({"stocks": ["a", "d"]}) == {"a"} and of({"use_pool": True, "stocks": ["a", "d"]}) == {"d"} and of({"stocks": []}) == {"a", "b", "c"}


def test_preprocess_switches(spark):
    rows = [(f"c{k:02d}", DAY, float(k * k), float(10 + k), "x" if k < 6 else "y" if k < 12 else "unknown") for k in range(14)] + [("none", DAY, None, 1.0, "x")]
    panel = spark.createDataFrame(rows, "code string, date date, f double, size double, ind_or_unknown string").withColumn("solo", F.coalesce("ind_or_unknown", "code"))
    f, size = column("f"), column("size")
    made = {
        "off": cross.preprocess(f, n_codes=14), "bare": cross.preprocess(f, winsorise=None, score=False, industry=False), "plain": cross.preprocess(f, size=size), "both": cross.industry_and_size(cross.zscore(cross.winsorize(f)), size),
        "fundamental": cross.preprocess(f, ("value", "fundamental"), size=size), "of_size": cross.regressed(cross.zscore(cross.winsorize(f)), size), "mcap": cross.preprocess(f, ("contains_mcap",), size=size),
        "of_industry": cross.industry_centred(cross.zscore(cross.winsorize(f))), "unmapped": cross.preprocess(f, size=size, mapped=False), "neither": cross.preprocess(f, ("fundamental", "contains_mcap"), size=size), "z": cross.zscore(cross.winsorize(f)),
        "map": cross.industry_or_day(f), "own_map": cross.industry_neutral(f), "no_map": cross.industry_or_day(f, False), "day": cross.demean(f),
    }
    out = evaluate(panel, {**made, "f0": f}, rounded=False).toPandas()
    for a, b in (("off", "f0"), ("bare", "f0"), ("plain", "both"), ("fundamental", "of_size"), ("unmapped", "of_size"), ("mcap", "of_industry"), ("neither", "z"), ("map", "own_map"), ("no_map", "day")):
        assert out[a].equals(out[b]), (a, b)
    assert not out["plain"].equals(out["fundamental"]) and not out["map"].equals(out["no_map"])
    assert out.loc[out["code"] == "none"].drop(columns=["code", "date"]).isna().all(axis=None)


def bars(spark, rows):
    return spark.createDataFrame([(c, DAY + dt.timedelta(days=t), *(float(x) for x in r)) for c, t, *r in rows], "code string, date date, open double, high double, low double, close double, volume double")


def test_running_weeks_go_on_after_a_restart(spark):
    path = shared.folder(spark, "stream")
    arrivals = [
        [("a", 0, 10, 12, 9, 11, 100), ("a", 1, 11, 15, 10, 14, 50), ("b", 4, 5, 6, 4, 5, 7)],
        [("a", 1, 11, 15, 10, 14, 50), ("a", 2, 14, 14, 8, 9, 30), ("a", 0, 1, 1, 1, 1, 1)],
        [("a", 7, 20, 21, 19, 20, 5), ("b", 3, 9, 9, 9, 9, 9), ("a", 8, 20, 30, 18, 25, 6)],
    ]
    for k, rows in enumerate(arrivals):
        own = bars(spark, rows)
        own.write.parquet(f"{path}/in/{k}")
        ingest.run_once(ingest.running_weeks(ingest.arrivals(spark, f"{path}/in/*", own.schema)), f"{path}/out", f"{path}/state")
    found = {(r.code, (r.date - DAY).days, r.kind): tuple(r)[3:8] for r in spark.read.schema(ingest.RUNNING).parquet(f"{path}/out").collect()}
    assert found == {
        ("a", 0, "accepted"): (10, 12, 9, 11, 100), ("a", 1, "accepted"): (10, 15, 9, 14, 150), ("b", 4, "accepted"): (5, 6, 4, 5, 7), ("a", 1, "repeated"): (None,) * 5, ("a", 0, "late"): (None,) * 5,
        ("a", 2, "accepted"): (10, 15, 8, 9, 180), ("a", 7, "accepted"): (20, 21, 19, 20, 5), ("b", 3, "late"): (None,) * 5, ("a", 8, "accepted"): (20, 30, 18, 25, 11),
    }


def test_repeats_within_the_watermark_are_dropped_and_late_rows_counted(spark):
    path, dropped = shared.folder(spark, "stream"), []
    schema = "code string, date date, ts timestamp, v long"
    at = lambda day: dt.datetime(2020, 1, 1) + dt.timedelta(days=day)
    arrivals = [[("a", 0, 1), ("a", 0, 2), ("b", 1, 3)], [("a", 0, 4), ("b", 2, 5), ("a", 60, 6)], [("a", 61, 7), ("b", 3, 8)], [("b", 62, 9)]]
    for k, rows in enumerate(arrivals):
        own = spark.createDataFrame([(c, at(t).date(), at(t), v) for c, t, v in rows], schema)
        own.coalesce(1).write.parquet(f"{path}/in/{k}")
        stream = ingest.deduplicated(ingest.arrivals(spark, f"{path}/in/*", own.schema), "14 days")
        dropped.append(ingest.run_once(stream, f"{path}/out", f"{path}/state"))
    kept = sorted(r.v for r in spark.read.schema(schema).parquet(f"{path}/out").collect())
    assert kept in ([1, 3, 5, 6, 7, 9], [2, 3, 5, 6, 7, 9]) and sum(dropped) == 1 == dropped[2]


def test_volumes_of_two_arrivals(spark):
    path = shared.folder(spark, "stream")
    at = lambda day: dt.datetime(2020, 1, 6) + dt.timedelta(days=day)
    dropped = []
    for k, rows in enumerate([[("a", 0, 1.0), ("a", 30, 2.0)], [("a", 31, 4.0), ("a", 1, 8.0), ("a", 20, 16.0)]]):
        own = spark.createDataFrame([(c, at(t), v) for c, t, v in rows], "code string, ts timestamp, volume double")
        own.coalesce(1).write.parquet(f"{path}/in/{k}")
        dropped.append(ingest.run_once(ingest.weekly_volume(ingest.arrivals(spark, f"{path}/in/*", own.schema)), f"{path}/out", f"{path}/state", "update"))
    found = {(r.w.start - at(0)).days: r.volume for r in ingest.latest(spark, f"{path}/out", ["code", "w"]).collect()}
    assert dropped == [0, 1] and found[0] == 1.0 and found[28] == 6.0 and found[14] == 16.0


@pytest.mark.parametrize("rows", [[], [("a", 0, 1, 1, 1, 1, 1)]])
def test_one_or_no_bar(spark, rows):
    path = shared.folder(spark, "stream")
    own = bars(spark, rows)
    own.write.parquet(f"{path}/in/0")
    ingest.run_once(ingest.running_weeks(ingest.arrivals(spark, f"{path}/in/*", own.schema)), f"{path}/out", f"{path}/state")
    assert spark.read.schema(ingest.RUNNING).parquet(f"{path}/out").count() == len(rows)
