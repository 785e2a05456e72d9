from __future__ import annotations

import json

import pytest

from barloom import __main__ as command
from barloom import library_queries
from barloom.sources import shared


def test_queries_by_name(spark, sf_dir, capsys):
    command.main(["list"])
    assert {"trade_statistics", "daily_ic"} <= set(capsys.readouterr().out.split())
    out = shared.folder(spark, "out")
    command.main(["write", "iso_weeks", sf_dir, out])
    assert spark.read.parquet(out).count() > 100
    command.main(["show", "iso_weeks", sf_dir])
    assert "bars" in capsys.readouterr().out
    for wrong in ([], ["show", "no_such_query", sf_dir], ["write", "iso_weeks", sf_dir]):
        with pytest.raises(SystemExit):
            command.main(wrong)


def test_analyze_and_pick(spark, sf_dir, capsys):
    out = shared.folder(spark, "out")
    command.main(["analyze", sf_dir, out, "--factors", "momentum_5,momentum_10,alpha_101", "--horizon", "3"])
    assert spark.read.parquet(f"{out}/summary").count() == 3 and spark.read.parquet(f"{out}/correlation").count() == 9
    capsys.readouterr()
    command.main(["pick", out, "--n", "2", "--most", "0.99"])
    assert len(capsys.readouterr().out.split()) == 2


def test_backtest_arms_and_latest(spark, sf_dir, tmp_path):
    out = shared.folder(spark, "out")
    code = spark.read.parquet(f"{sf_dir}/supplier.parquet").count() and library_queries.positions(spark, sf_dir).first()["code"]
    command.main(["backtest", sf_dir, f"{out}/one", "--fast", "2", "--slow", "5", "--stocks", code])
    assert [r.code for r in spark.read.parquet(f"{out}/one/statistics").collect()] == [code]
    (tmp_path / "base.json").write_text(json.dumps(library_queries.BASE))
    (tmp_path / "arms.json").write_text(json.dumps(library_queries.ARMS))
    command.main(["arms", sf_dir, str(tmp_path / "base.json"), str(tmp_path / "arms.json"), f"{out}/arms"])
    assert {r.arm: r.failed for r in spark.read.parquet(f"{out}/arms/arms").collect()} == {"a": False, "b": False, "broken": True}
    assert spark.read.parquet(f"{out}/arms/differences").count() > 0
    command.main(["latest", sf_dir, f"{out}/latest", "--factors", "momentum_5,alpha_101"])
    found = spark.read.parquet(f"{out}/latest/scores")
    assert found.count() == found.select("code").distinct().count() > 0 and found.where("score is not null").count() > 0
