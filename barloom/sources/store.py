"""Tables on disk: bars by code, dimensions, analysis results as JSON.

Two stores of bars. A catalog table (save_bars, table_bars) is bucketed by code and sorted, so that a window along a
code needs no exchange and a few codes only a few buckets. A folder that grows (merge, current) has a version of each
bucket for each merge that touched it: the rows are written first, one small file of (version, bucket) last, and only
versions with such a file are read. So a merge that breaks off leaves nothing behind that is read, and can be run again.
"""

from __future__ import annotations

import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Buckets of a bar table: bars of one code stand together, and a code's files can be skipped by its bucket.
BUCKETS = 256


def bucket(code: str = "code", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")


def write_bars(bars: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """By bucket of the code, sorted within, so that windows along a code read neighbours."""
    out = bars.withColumn("bucket", bucket(buckets=buckets))
    out.repartition("bucket").sortWithinPartitions("code", "date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bars(spark: SparkSession, path: str, codes: list[str] | None = None, last: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The bars of some codes (or all), of each the last so many. Only the buckets of the codes are read."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    if codes is not None:
        wanted = [r["b"] for r in spark.createDataFrame([(c,) for c in codes], "code string").select(bucket(buckets=buckets).alias("b")).distinct().collect()]
        df = df.where(F.col("bucket").isin(wanted) & F.col("code").isin(codes))
    if last is not None:
        df = df.withColumn("back", F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc()))).where(F.col("back") <= last).drop("back")
    return df.drop("bucket")


def save_bars(bars: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """The catalog table of this name, replaced, its files in a new shared folder: one file a bucket, sorted by code and date."""
    with shared.freed(bars.sparkSession):
        _save_bars(bars, table, buckets)


def _save_bars(bars: DataFrame, table: str, buckets: int) -> None:
    rows = bars.repartition(buckets, "code").sortWithinPartitions("code", "date")
    out = rows.write.mode("overwrite").format("parquet").option("path", shared.folder(bars.sparkSession, "bars"))
    out.bucketBy(buckets, "code").sortBy("code", "date").saveAsTable(table)


def table_bars(spark: SparkSession, table: str, codes: list[str] | None = None) -> DataFrame:
    """The bars of a catalog table, or of some codes, whose buckets alone are read."""
    df = spark.table(table)
    return df if codes is None else df.where(F.col("code").isin(codes))


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, bucket) of the merges that ended; none if there is no store yet."""
    schema = "version long, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/merges")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema: str, codes: list[str] | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of the store as of its last ended merge; schema is that of the merged rows.

    The newest version of each bucket is known on the driver (a number a bucket), so others are pruned by their folders.
    """
    newest = {r["bucket"]: r["version"] for r in _versions(spark, path).groupBy("bucket").agg(F.max("version").alias("version")).collect()}
    if codes is not None:
        only = [r["b"] for r in spark.createDataFrame([(c,) for c in codes], "code string").select(bucket().alias("b")).distinct().collect()]
    wanted = {b: v for b, v in newest.items() if only is None or b in only}
    if not wanted:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(f"{schema}, version long, bucket int").parquet(f"{path}/rows")
    of_version = [(F.col("version") == v) & F.col("bucket").isin([b for b, x in wanted.items() if x == v]) for v in sorted(set(wanted.values()))]
    kept = df.where(functools.reduce(operator.or_, of_version)).drop("version", "bucket")
    return kept if codes is None else kept.where(F.col("code").isin(codes))


def merge(spark: SparkSession, path: str, new: DataFrame, key: list[str], replace: DataFrame | None = None) -> int:
    """Adds new rows to the store, and gives the version, or 0 if there was nothing to add.

    Of rows with one key the stored one stays; all stored rows of the codes in replace (code) go first. Only the buckets
    of codes in new or replace are written again. A second run with the same rows changes nothing that is read.
    """
    new = new.dropDuplicates(key)
    codes = new.select("code") if replace is None else new.select("code").union(replace.select("code"))
    touched = [r["b"] for r in codes.select(bucket().alias("b")).distinct().collect()]  # a number a bucket at most
    if not touched:
        return 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    old = current(spark, path, schema, only=touched)
    if replace is not None:
        old = old.join(replace.select("code").distinct(), "code", "left_anti")
    rows = old.unionByName(new.join(old.select(*key), key, "left_anti"))
    version = (_versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    out = rows.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions(*key)
    out.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(version, b) for b in touched], "version long, bucket int").coalesce(1).write.mode("append").parquet(f"{path}/merges")
    return version


def states(universe: DataFrame, stored: DataFrame, today: str, history: int, source: str | None = None) -> DataFrame:
    """(code, state, since) of every code of the universe: what must be fetched, and from which day on (NULL: all).

    missing: nothing is stored; changed: it came from another source, and is replaced; short: fewer than history bars;
    stale: the last bar is before today; fresh: nothing to fetch. Short and stale ones go on after their last bar.
    """
    source_of = F.max("source") if source else F.lit(None).cast("string")
    have = stored.groupBy("code").agg(F.max("date").alias("last"), F.count("*").alias("bars"), source_of.alias("of"))
    found = universe.select("code").distinct().join(have, "code", "left")
    state = F.when(F.col("last").isNull(), "missing")
    state = state.when(F.col("of") != source, "changed") if source else state
    state = state.when(F.col("bars") < history, "short").when(F.col("last") < F.lit(today).cast("date"), "stale").otherwise("fresh")
    found = found.withColumn("state", state)
    return found.select("code", "state", F.when(F.col("state").isin("short", "stale"), F.date_add("last", 1)).alias("since"))


def quarters_to_load(codes: DataFrame, done: DataFrame, today: str, quarters: int = 16, max_age_days: int = 30) -> DataFrame:
    """(code, stat_date) that a load of the last quarters still lacks: no stored row, or one that was loaded too long ago.

    done: (code, stat_date, loaded). What an interrupted load has stored is left out of the next one.
    """
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(quarters)), lambda k: F.date_sub(F.add_months(F.trunc(F.lit(today).cast("date"), "quarter"), -3 * (k - 1)), 1))).alias("stat_date")
    valid = done.where(F.datediff(F.lit(today).cast("date"), "loaded") <= max_age_days).select("code", "stat_date").distinct()
    return codes.select("code").distinct().select("code", ends).join(valid, ["code", "stat_date"], "left_anti")


def iso_week(date) -> Column:
    """The ISO year and week of a day, as 2024-W09."""
    day = F.col(date) if isinstance(date, str) else date
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def weekly_result(spark: SparkSession, path: str, key: str, week: str, schema: str, build, refresh: str = "weekly") -> DataFrame:
    """The stored result of a key (such as the hash of a configuration) and ISO week, built and stored where it is not.

    refresh: "weekly" builds once a week, "always" builds again, "never" takes what is stored or nothing. A result
    without rows is stored like others, so it is not built again.
    """
    own = f"{path}/key={key}/week={week}"
    if refresh != "always":
        try:
            return spark.read.schema(schema).parquet(own)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        if refresh == "never":
            return spark.createDataFrame([], schema)
    build().write.mode("overwrite").parquet(own)
    return spark.read.schema(schema).parquet(own)


def to_fetch(universe: DataFrame, stored: DataFrame, today: str) -> DataFrame:
    """code, since: what a code lacks, from the day after its last bar, or from the start."""
    last = stored.groupBy("code").agg(F.max("date").alias("last"))
    found = universe.select("code").join(last, "code", "left").select("code", F.date_add("last", 1).alias("since"))
    return found.where(F.col("since").isNull() | (F.col("since") <= F.lit(today).cast("date")))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """A row of text for each row; numbers that are none are null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(name))


def from_json(text: DataFrame, schema: str, name: str = "json") -> DataFrame:
    return text.select(F.from_json(name, schema).alias("r")).select("r.*")
