"""Incremental ingest of bars: what has arrived since the last run, deduplicated, appended."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def weekly_volume(events: DataFrame, late: str = "14 days") -> DataFrame:
    """code and week with the volume, as a stream.

    Rows that come more than `late` behind the latest day of an earlier run are left out (run_once counts them), so
    arrivals must be in order of time, up to that.
    """
    return events.withWatermark("ts", late).groupBy("code", F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.sum("volume").alias("volume"))


def deduplicated(bars: DataFrame, late: str = "14 days") -> DataFrame:
    """The first row of each code and date among those within the watermark."""
    return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(["code", "date"])


def run_once(stream: DataFrame, out: str, state: str, mode: str = "append") -> int:
    """Process all that is there and stop; the state folder makes the next run go on from here. Gives the number of rows
    that came after the watermark and were dropped.

    In mode update every batch writes the groups that changed to a folder of its own; latest() reads the last of each.
    State that the watermark has passed is dropped, unlike with mode complete.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def latest(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """Of the batches below out the last row of each key."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*key, "last.*")


RUNNING = "code string, date date, week date, open double, high double, low double, close double, volume double, kind string"
STATE = "date date, week date, open double, high double, low double, close double, volume double"


def _running(key: tuple, batches, state):
    """A code's new bars in order of date, each as its week has run until then; older or repeated ones are told as such."""
    held = state.get if state.exists else None
    rows = pd.concat(batches).sort_values("date", kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        week = r.date - dt.timedelta(days=r.date.weekday())
        if held is not None and r.date <= held[0]:
            out.append((key[0], r.date, week, None, None, None, None, None, "repeated" if r.date == held[0] else "late"))
            continue
        if held is None or held[1] != week:
            held = (r.date, week, r.open, r.high, r.low, r.close, r.volume)
        else:
            held = (r.date, week, held[2], max(held[3], r.high), min(held[4], r.low), r.close, held[6] + r.volume)
        out.append((key[0], *held, "accepted"))
    if held is not None:
        state.update(held)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNNING.split(", ")])


def running_weeks(bars: DataFrame) -> DataFrame:
    """RUNNING of a stream of daily bars: the running week as of each bar, by a state of one row a code.

    Bars of one code must come in order of date, over all arrivals; one that is not after the code's last has no week of
    its own any more and comes out as "late" or "repeated", so that nothing is dropped without being counted. The state
    is in the checkpoint, so the next arrival, or a new start after a crash, goes on in the middle of a week.
    """
    return bars.groupBy("code").applyInPandasWithState(_running, RUNNING, STATE, "append", GroupStateTimeout.NoTimeout)
