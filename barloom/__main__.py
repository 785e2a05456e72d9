"""Run a registered query, or one of the jobs that take parameters, over a folder of tables.

    python -m barloom list
    python -m barloom show QUERY DIR
    python -m barloom write QUERY DIR OUT
    python -m barloom analyze DIR OUT --family gtja191 [--factors a,b] [--horizon 5]     daily coefficients and a summary of each factor
    python -m barloom pick OUT [--n 10] [--most 0.7]                                     of an analysis: the best that are not near another
    python -m barloom backtest DIR OUT [--fast 5] [--slow 20] [--stocks a,b]             trades of a moving-average cross, and their statistics
    python -m barloom arms DIR BASE.json ARMS.json OUT                                   results of several configurations, and their differences
    python -m barloom latest DIR OUT --factors a,b                                       each code's last bar by the newest monthly model
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import library_queries, queries
from .factors import registry, table
from .operators import analysis, arms, library_analysis, pipeline, trades
from .sources import adapters, shared


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(f"barloom {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def listed(text: str | None) -> list[str]:
    return [part for part in (text or "").split(",") if part]


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    names, panel = listed(args.factors) or registry.names(args.family), adapters.panel(spark, args.folder)
    labels = shared.written(analysis.forward_return(panel, args.horizon).select("code", "date", "fwd", "close"))
    ic = library_analysis.daily_ic(table.factor_rows(panel, names).join(labels, ["code", "date"]))
    write(ic, f"{args.out}/ic")
    found = spark.read.parquet(f"{args.out}/ic")
    write(library_analysis.summary(found), f"{args.out}/summary")
    write(library_analysis.ic_correlation(found, names), f"{args.out}/correlation")


def pick(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    found = spark.read.parquet(f"{args.out}/summary")
    best = analysis.pick(found.drop("degenerate"), spark.read.parquet(f"{args.out}/correlation"), args.n, args.most, degenerate=found)
    print(*best, sep="\n")
    return best


def backtest(spark: SparkSession, args: argparse.Namespace) -> None:
    bars = adapters.bars(spark, args.folder)
    own = bars.join(arms.codes_of({"stocks": listed(args.stocks)}, bars), "code", "left_semi")
    done = trades.trades(library_queries.crossed(own, args.fast, args.slow))
    write(done, f"{args.out}/trades")
    write(trades.statistics(spark.read.parquet(f"{args.out}/trades")), f"{args.out}/statistics")


def run_arms(spark: SparkSession, args: argparse.Namespace) -> None:
    with open(args.base, encoding="utf-8") as base, open(args.arms, encoding="utf-8") as own:
        of_base, of_arms = json.load(base), json.load(own)
    found, states = arms.run(adapters.bars(spark, args.folder), {name: arms.effective(of_base, arm) for name, arm in of_arms.items()}, library_queries.arm_trades)
    write(states, f"{args.out}/arms")
    if found is not None:
        write(found, f"{args.out}/results")
        ended = [r["arm"] for r in states.where("not failed").collect()]  # a row an arm
        if len(ended) > 1:
            write(arms.differences(found, "code", ["trades", "win_rate", "mean_pct"], *ended[:2]), f"{args.out}/differences")


def latest(spark: SparkSession, args: argparse.Namespace) -> None:
    names, panel = listed(args.factors), adapters.panel(spark, args.folder)
    labels = analysis.forward_return(panel, 5).select("code", "date", "fwd")
    vectors = table.as_vectors(table.factor_rows(panel, names), names).join(labels, ["code", "date"])
    rows = shared.written(vectors.select("code", "date", "fwd", *(F.col("x")[k].alias(n) for k, n in enumerate(names))))
    model = pipeline.Monthly(names=names).fit(rows)
    model.write().overwrite().save(f"{args.out}/model")
    write(pipeline.MonthlyModel.load(f"{args.out}/model").latest(rows).select("code", "date", "model_month", "score"), f"{args.out}/scores")


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="barloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = own.add_subparsers(dest="action", required=True)

    def job(name: str, *places: str):
        found = jobs.add_parser(name)
        for place in places:
            found.add_argument(place, **({"choices": sorted(queries.QUERIES), "metavar": "QUERY"} if place == "query" else {}))
        return found

    job("list")
    job("show", "query", "folder")
    job("write", "query", "folder", "out")
    found = job("analyze", "folder", "out")
    found.add_argument("--family", default="technical")
    found.add_argument("--factors")
    found.add_argument("--horizon", type=int, default=5)
    found = job("pick", "out")
    found.add_argument("--n", type=int, default=10)
    found.add_argument("--most", type=float, default=0.7)
    found = job("backtest", "folder", "out")
    found.add_argument("--fast", type=int, default=5)
    found.add_argument("--slow", type=int, default=20)
    found.add_argument("--stocks")
    job("arms", "folder", "base", "arms", "out")
    job("latest", "folder", "out").add_argument("--factors", required=True)
    return own


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.action == "list":
        print(*queries.QUERIES, sep="\n")
        return
    spark = session(args.action)
    if args.action == "show":
        queries.QUERIES[args.query](spark, args.folder).show(50, truncate=False)
    elif args.action == "write":
        write(queries.QUERIES[args.query](spark, args.folder), args.out)
    else:
        {"analyze": analyze, "pick": pick, "backtest": backtest, "arms": run_arms, "latest": latest}[args.action](spark, args)


if __name__ == "__main__":
    main()
