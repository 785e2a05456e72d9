"""What several corpus operators share: table access, lineage cuts, grouped streaming, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six ASCII white-space characters: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its own machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation.

    narrow: rows of a few numbers, for which a file a core is enough; many small files only cost calls to the file
    system. Spark removes the files when nothing refers to them, where spark.cleaner.referenceTracking.cleanCheckpoints
    is set.
    """
    shared_folder(df.sparkSession)
    if narrow:
        df = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: as cut(), for tables of many rows, which take less room by column."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts: the folds of the classifiers. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))


def components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges between longs: (node, root), root the least node of its component.

    Every round hangs each node under its least neighbour, follows the parents once, and contracts the edges;
    a chain shortens by a factor each round, so rounds grow with the logarithm of the longest one. Minima are
    combined before the shuffle and the joins are plain sort-merge joins of written tables, which AQE can split
    where one node has very many edges. Nothing but the count of edges left reaches the driver.
    """
    live = cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), narrow=True)
    roots = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node"))
    for _ in range(most_rounds):
        if live.isEmpty():
            return roots
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).union(live.select("b", "a"))
        up = cut(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up")), narrow=True)
        grand = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = cut(up.join(grand, "up").select("node", F.col("top").alias("up")), narrow=True)
        roots = cut(roots.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), narrow=True)
        live = live.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        live = cut(live.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), narrow=True)
    raise RuntimeError("components did not settle")

