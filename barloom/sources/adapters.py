"""The bar tables that the operators read, built from the star-schema test tables; and the same as SQL text.

bars: a supplier is a code, a week of shipments a bar, extended price per unit the price, in order of shipment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: This region's suppliers have no industry, so that unmapped codes occur.
UNMAPPED = "ASIA"


#: Exchange prefixes, by the supplier's key modulo their number.
PREFIXES = ("600", "300", "688", "830", "000")


def code_of(key: str) -> Column:
    """Prefix of the exchange and the key in six digits."""
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col(key) % len(PREFIXES) + 1).cast("int"))
    return F.concat(prefix, F.lpad(F.col(key).cast("string"), 6, "0"))


def code_sql(key: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PREFIXES))
    return f"(CASE {key} % {len(PREFIXES)} {cases} END || lpad(CAST({key} AS VARCHAR), 6, '0'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, every: str = "week") -> DataFrame:
    """code, date, open, high, low, close, volume: one row for each week (or day) with shipments."""
    lines = table(spark, sf_dir, "lineitem").select(
        code_of("l_suppkey").alias("code"),
        F.to_date(F.date_trunc(every, "l_shipdate")).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("nth"),
    )
    # a bar has few shipments: sorted after the exchange alone, in tasks of its size, not in each split of the input as well
    return lines.repartition("code", "date").groupBy("code", "date").agg(
        F.min_by("price", "nth").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "nth").alias("close"), F.sum("l_quantity").alias("volume")
    )


BARS = f"""
SELECT {code_sql("l_suppkey")} AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem) GROUP BY 1, 2
"""


DAILY = BARS.replace("'week'", "'day'")


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, ind: a row for each code, the industry NULL where unmapped."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapped = nations.select("n_nationkey", F.when(F.col("r_name") != UNMAPPED, F.col("n_name")).alias("ind"))
    suppliers = table(spark, sf_dir, "supplier").select(
        code_of("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 13 == 5, F.concat(F.lit("*St "), "s_name")).otherwise(F.col("s_name")).alias("name"), "s_nationkey"
    )
    return suppliers.join(mapped, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("code", "name", "ind")


INDUSTRIES = f"""
SELECT {code_sql("s_suppkey")} AS code, CASE WHEN s_suppkey % 13 = 5 THEN '*St ' || s_name ELSE s_name END AS name, CASE WHEN r_name <> '{UNMAPPED}' THEN n_name END AS ind
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""


def listings(bars: DataFrame) -> DataFrame:
    """code, ipo_date: the first bar, unknown for codes on 83."""
    return bars.groupBy("code").agg(F.min("date").alias("first")).select("code", F.when(~F.col("code").startswith("83"), F.col("first")).alias("ipo_date"))


LISTINGS = "SELECT code, CASE WHEN code NOT LIKE '83%' THEN min(date) END AS ipo_date FROM bars GROUP BY code"


def align(bars: DataFrame) -> DataFrame:
    """Every code on every date of the calendar; fields are NULL where a code has no bar, is_bar tells which.

    The calendar (one row a trading day) is the small side and goes to the codes.
    """
    calendar = bars.select("date").distinct()
    return bars.select("code").distinct().crossJoin(calendar).join(bars.withColumn("is_bar", F.lit(True)), ["code", "date"], "left").withColumn("is_bar", F.coalesce("is_bar", F.lit(False)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned bars with ind (industry), solo (industry, or the code where unmapped), ind_or_unknown."""
    own = shared.written(bars(spark, sf_dir))  # codes, days and rows are read from one pass over the shipments
    with_industry = align(own).join(industries(spark, sf_dir).select("code", "ind"), "code", "left")
    return with_industry.withColumns({"solo": F.coalesce("ind", F.concat(F.lit("solo "), "code")), "ind_or_unknown": F.coalesce("ind", F.lit("unknown"))})


PANEL = f"""
SELECT code, date, open, high, low, close, volume, b.close IS NOT NULL AS is_bar, ind, coalesce(ind, 'solo ' || code) AS solo, coalesce(ind, 'unknown') AS ind_or_unknown
FROM (SELECT code, date FROM (SELECT DISTINCT code FROM bars) CROSS JOIN (SELECT DISTINCT date FROM bars)) g
LEFT JOIN bars b USING (code, date) LEFT JOIN industries USING (code)
"""


def with_tables(query: str, **more: str) -> str:
    """query with bars, industries and further named queries before it."""
    parts = {"bars": BARS, "industries": INDUSTRIES, "listings": LISTINGS, "panel": PANEL, **more}
    head = ", ".join(f"{name} AS MATERIALIZED ({text.strip()})" for name, text in parts.items())
    body = query.strip()
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
