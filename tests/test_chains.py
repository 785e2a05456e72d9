from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.factors import library
from barloom.plans import blocks, chains

START = datetime.date(2020, 1, 6)


def ragged(spark):
    """Codes of different lengths with gaps and NULLs, one of a single bar, industries that are missing."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate([90, 1, 70, 90, 85, 33, 90, 64, 90]):
        days = sorted(rng.choice(100, n, replace=False).tolist())
        for day in days:
            price = [None] * 4 if rng.random() < 0.1 else [float(np.round(rng.uniform(5, 6), 3)) for _ in range(4)]
            rows.append((f"c{k}", START + datetime.timedelta(day), *price, float(rng.integers(1, 50)), f"i{k % 3}" if k % 4 else f"solo c{k}", day % 2 == 0))
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, solo string, even boolean")


@pytest.mark.parametrize(("family", "batch"), [("alpha101", 1), ("alpha101", 4), ("gtja191", 5), ("alpha101_variants", 2)])
def test_chains_are_as_steps_by_rows(spark, monkeypatch, family, batch):
    monkeypatch.setattr(blocks, "ROWS", 100)
    bars, names = ragged(spark), library.batches(family)[batch]
    also = ("close", "solo", "even")
    plan = library.factors(bars, names, also=also)
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r[:2]): tuple(r[2:]) for r in plan.collect()}
    monkeypatch.setattr(chains, "fits", lambda *_: False)
    rows = {tuple(r[:2]): tuple(r[2:]) for r in library.factors(bars, names, also=also).collect()}
    assert found == rows and len(found) == bars.count()


def test_a_row_a_block_and_day_is_exchanged(spark):
    bars = ragged(spark).union(ragged(spark).withColumn("code", F.concat(F.lit("d"), "code")))
    plan = library.factors(bars, library.batches("alpha101")[1])
    assert plan.count() == bars.count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in text and text.count("hashpartitioning(code") == 1
    assert library.factors(bars.limit(0), library.batches("gtja191")[5]).count() == 0
