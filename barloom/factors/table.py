"""The factor library as a table of rows, written batch by batch from one stored panel."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared, store
from ..operators import cross, library_analysis
from ..plans.expression import column, evaluate
from . import library


def stored_panel(panel: DataFrame, buckets: int = 32) -> DataFrame:
    """panel as a bucketed table: each batch reads it, and its windows along a code need no exchange before them."""
    name = f"barloom_panel_{uuid.uuid4().hex}"
    store.save_bars(panel, name, buckets)
    return panel.sparkSession.table(name)


def factor_rows(panel: DataFrame, names: list[str], size: int = library.BATCH) -> DataFrame:
    """(factor, code, date, value) of many factors; a plan holds one batch, and each batch is written when it is done."""
    spark, own, path = panel.sparkSession, stored_panel(panel), shared.folder(panel.sparkSession, "factors")
    for k in range(0, len(names), size):
        batch = names[k : k + size]
        with shared.freed(spark):
            library.factors(own, batch).unpivot(["code", "date"], batch, "factor", "value").write.parquet(f"{path}/batch={k // size}")
    return spark.read.parquet(path).drop("batch")


def daily_ic(panel: DataFrame, names: list[str], size: int = library.BATCH) -> DataFrame:
    """library_analysis.daily_ic of many factors of a stored panel with labels (fwd), batch by batch."""
    path = shared.folder(panel.sparkSession, "ic")
    for k in range(0, len(names), size):
        batch = names[k : k + size]
        with shared.freed(panel.sparkSession):
            library_analysis.daily_ic_wide(library.factors(panel, batch, also=("fwd", "close")), batch).write.parquet(f"{path}/batch={k // size}")
    return panel.sparkSession.read.parquet(path).drop("batch")


def score_parts(panel: DataFrame, names: list[str], size: int = library.BATCH, also: tuple[str, ...] = ()) -> DataFrame:
    """(code, date, batch, has, z): a batch's factors as scores across their day and whether it has any of them, written; and
    the panel's doubles named in also, with the first batch."""
    spark, own, path = panel.sparkSession, stored_panel(panel), shared.folder(panel.sparkSession, "scores")
    for k in range(0, len(names), size):
        batch, more = names[k : k + size], also if not k else ()
        with shared.freed(spark):
            scored = evaluate(library.factors(own, batch, also=more), {f"z_{n}": cross.standard(column(n)) for n in batch}, rounded=False, also=(*batch, *more))
            scored.select("code", "date", *more, F.coalesce(*batch).isNotNull().alias("has"), F.array(*(f"z_{n}" for n in batch)).alias("z")).write.parquet(f"{path}/batch={k // size:04d}")
    return spark.read.schema(", ".join(["code string, date date", *(f"{c} double" for c in also), "has boolean, z array<double>, batch int"])).parquet(path)


def gathered(parts: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(code, date, x) of score_parts, for rows that have any factor: a row a batch, not a row a factor, is brought together."""
    found = parts.groupBy("code", "date").agg(F.max("has").alias("has"), *(F.max(c).alias(c) for c in also), F.sort_array(F.collect_list(F.struct("batch", "z"))).alias("of"))
    return found.where("has").select("code", "date", *also, F.flatten(F.col("of.z")).alias("x"))


def score_vectors(panel: DataFrame, names: list[str], size: int = library.BATCH) -> DataFrame:
    """(code, date, x): the factors as scores across their day in order of names, for rows that have any of them."""
    return gathered(score_parts(panel, names, size))


def as_vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    """(code, date, x): the values of a code's day as an array in order of names, NULL where there is none."""
    values = F.map_from_entries(F.collect_list(F.struct("factor", "value")))  # a row a factor, which the library bounds
    own = rows.where(F.col("factor").isin(names)).groupBy("code", "date").agg(values.alias("of"))
    return own.select("code", "date", F.transform(F.array(*map(F.lit, names)), lambda n: F.element_at("of", n)).alias("x"))
