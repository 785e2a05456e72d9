from __future__ import annotations

import datetime as dt
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import ranking, trades
from barloom.queries import ORACLES, QUERIES
from barloom.sources import adapters, shared, store

DAY = dt.date(2020, 1, 1)
CHECKED = ["bars_from_store", "bars_of_codes", "bars_merged_store", "fetch_states", "quarters_to_load", "iso_weeks", "global_ranks", "global_quantiles", "trade_list", "trade_statistics", "arms_diff", "factors_by_hand", "ts_argmax", "cs_industry_strength", "open_or_before", "top_k_fillable", "weigher_scores", "cs_switches", "stream_running_weeks", "stream_left_out", "factor_pick", "ic_weights", "quantile_verdicts"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) and len(a)
    keys = sorted(a.columns, key=lambda c: (a[c].dtype.kind == "f", c))
    a, b = (x.sort_values(keys, key=lambda s: s if s.dtype.kind == "f" else s.astype(str).str[:10]).reset_index(drop=True) for x in (a, b))
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-6, atol=2e-6, err_msg=c)
        else:
            assert [str(v)[:10] for v in a[c].astype(object).where(a[c].notna(), None)] == [str(v)[:10] for v in b[c].astype(object).where(b[c].notna(), None)], c


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())


def test_no_exchange_under_a_window_over_the_store(spark, sf_dir):
    plan = QUERIES["bars_from_store"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    name = "barloom_pruning"
    store.save_bars(adapters.bars(spark, sf_dir), name, 32)
    code = spark.table(name).first()["code"]
    found = store.table_bars(spark, name, [code])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # it only hides the count from the plan
    assert "SelectedBucketsCount: 1 out of 32" in store.table_bars(spark, name, [code])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert found.count() == adapters.bars(spark, sf_dir).where(F.col("code") == code).count()


def test_ranks_and_quantiles_are_those_of_pandas(spark):
    rng = np.random.default_rng(1)
    own = pd.DataFrame({"g": rng.choice(list("ab"), 3000, p=[0.9, 0.1]), "x": np.where(rng.random(3000) < 0.4, 5.0, rng.integers(-200, 200, 3000)), "k": range(3000)})
    own.loc[::17, "x"] = None
    rows = spark.createDataFrame([(g, None if pd.isna(x) else float(x), k) for g, x, k in own.itertuples(index=False)], "g string, x double, k long").repartition(7)
    ranks = ranking.mean_ranks(rows, "x", "rank", ["g"]).orderBy("k").toPandas()["rank"]
    np.testing.assert_allclose(ranks.to_numpy(float), own.groupby("g")["x"].rank().to_numpy(float))
    whole = ranking.mean_ranks(rows, "x", "rank").orderBy("k").toPandas()["rank"]
    np.testing.assert_allclose(whole.to_numpy(float), own["x"].rank().to_numpy(float))
    shares = [0.0, 0.013, 0.5, 0.9, 1.0]
    found = {(r.g, r.share): r.x for r in ranking.quantiles(rows, "x", shares, ["g"]).collect()}
    assert found == {(g, q): pytest.approx(own[own.g == g]["x"].quantile(q)) for g in "ab" for q in shares}
    assert ranking.quantiles(rows.where("x is null"), "x", [0.5]).count() == 0
    text = ranking.mean_ranks(rows, "x", "rank", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text and "windowspecdefinition(g#" not in text.split("range")[0], "rows are only in a window with their range"


def test_a_merge_that_breaks_off_is_not_read(spark):
    path, schema = shared.folder(spark, "store"), "code string, date date, close double"
    make = lambda rows: spark.createDataFrame([(c, DAY + dt.timedelta(days=t), x) for c, t, x in rows], schema)
    of = lambda: sorted((r.code, (r.date - DAY).days, r.close) for r in store.current(spark, path, schema).collect())
    assert of() == []
    assert store.merge(spark, path, make([("a", 0, 1.0), ("b", 0, 2.0), ("b", 0, 2.0)]), ["code", "date"]) == 1
    assert store.merge(spark, path, make([]), ["code", "date"]) == 0
    # rows of a version without its file of merges, as a driver that is lost before the last step leaves them
    make([("a", 5, 9.0)]).withColumn("bucket", store.bucket()).withColumn("version", F.lit(2).cast("long")).write.partitionBy("version", "bucket").parquet(f"{path}/rows", mode="append")
    assert of() == [("a", 0, 1.0), ("b", 0, 2.0)]
    again = make([("a", 0, 7.0), ("a", 1, 3.0)])
    assert store.merge(spark, path, again, ["code", "date"]) == 2
    first = of()
    assert first == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)]
    store.merge(spark, path, again, ["code", "date"])
    assert of() == first, "two runs in a row equal one"
    store.merge(spark, path, make([("a", 3, 8.0)]), ["code", "date"], replace=make([("a", 0, 0.0)]).select("code"))
    assert of() == [("a", 3, 8.0), ("b", 0, 2.0)]
    assert [r.code for r in store.current(spark, path, schema, codes=["b"]).collect()] == ["b"]


def test_weekly_results_are_built_once(spark):
    path, built = shared.folder(spark, "pool"), []

    def build(n: int):
        built.append(n)
        return spark.range(n)

    of = lambda n, week, refresh="weekly": store.weekly_result(spark, path, "k1", week, "id long", lambda: build(n), refresh).count()
    assert of(3, "2024-W01", "never") == 0 and of(0, "2024-W01") == 0 and of(5, "2024-W01") == 0, "an empty result is a result"
    assert of(2, "2024-W02") == 2 and of(4, "2024-W02", "always") == 4 and of(9, "2024-W02", "never") == 4
    assert built == [0, 2, 4]
    weeks = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 12, 31),), (dt.date(2018, 12, 31),)], "d date").select(store.iso_week("d").alias("w"))
    assert [r.w for r in weeks.collect()] == ["2020-W53", "2020-W53", "2019-W01"]


def test_trades_by_hand(spark):
    rows = [("a", t, 10.0 + t, 10.5 + t, p) for t, p in enumerate([False, True, True, None, True, False, True])] + [("b", 0, 5.0, 6.0, True)]
    own = spark.createDataFrame([(c, DAY + dt.timedelta(days=t), o, x, p) for c, t, o, x, p in rows], "code string, date date, open double, close double, position boolean")
    found = {(r.code, (r.entry - DAY).days): (r.bars, r.exit and (r.exit - DAY).days, r.entry_price, r.exit_price) for r in trades.trades(own).collect()}
    assert found == {("a", 1): (2, 3, 11.0, 13.0), ("a", 4): (1, 5, 14.0, 15.0), ("a", 6): (1, None, 16.0, 16.5), ("b", 0): (1, None, 5.0, 6.0)}
    stats = {r.code: r for r in trades.statistics(trades.trades(own)).collect()}
    assert (stats["a"].trades, stats["a"].open_trades, stats["a"].win_rate) == (2, 1, 1.0) and stats["a"].mean_pct == pytest.approx(50 * (2 / 11 + 1 / 14))
    assert (stats["b"].trades, stats["b"].win_rate) == (0, None)


def _shuffle_files(spark, most: int) -> int:
    """How many shuffle files there are, once there are no more than most or after ten seconds."""
    found = 0
    for _ in range(40):
        names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        found = sum(n.startswith("shuffle_") for n in names.split())
        if found <= most:
            break
        time.sleep(0.25)
    return found


def test_a_written_table_leaves_no_shuffle_files(spark):
    """The batches of a library left theirs until the end, so its disk grew with the number of batches."""
    was, before = _shuffle_files(spark, 0), spark.conf.get(shared.FREED)
    made = shared.written(spark.range(0, 5000).repartition(4, "id"))
    store.save_bars(spark.range(0, 500).selectExpr("cast(id % 7 as string) as code", "date_add(date'2020-01-01', int(id)) as date"), "barloom_bars_freed", 4)
    assert _shuffle_files(spark, was) <= was and spark.conf.get(shared.FREED) == before
    assert made.count() == 5000 and spark.table("barloom_bars_freed").count() == 500
