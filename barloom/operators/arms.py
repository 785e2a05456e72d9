"""Experiments with two or more arms: configurations merged over a base, one shared input, an arm column.

A failing arm is told as such and the others go on. What all arms read is written once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def merged(base: dict, over: dict) -> dict:
    """base with the values of over: nested documents field by field, anything else (lists too) as a whole."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def effective(base: dict, arm: dict, replaced: tuple[str, ...] = ("strategy",)) -> dict:
    """The configuration of an arm: sections in replaced are the arm's as a whole, others are merged without its nulls."""

    def given(section):
        return {k: given(v) for k, v in section.items() if v is not None} if isinstance(section, dict) else section

    out = dict(base)
    for key, section in arm.items():
        if section is not None:
            out[key] = section if key in replaced or not isinstance(section, dict) else merged(out.get(key) or {}, given(section))
    return out


def content_hash(configuration: dict) -> str:
    """Eight digits that are the same for the same content, in whatever order its keys are."""
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, default=str).encode()).hexdigest()[:8]


def codes_of(configuration: dict, listed: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """(code): those of the pool where the configuration asks for it, else those listed; of these only its stocks, if it names some."""
    own = (pool if configuration.get("use_pool") and pool is not None else listed).select("code").distinct()
    wanted = configuration.get("stocks") or []
    return own.where(F.col("code").isin(list(wanted))) if wanted else own


def run(rows: DataFrame, arms: dict[str, dict], build: Callable[[DataFrame, dict], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(results with an arm column, (arm, hash, failed, error) of every arm).

    build makes one arm's results from the shared rows and its configuration. Each arm is written before the next, so
    that an arm that fails while it runs takes no other with it; arms of the same content are run once.
    """
    shared, done, told, known = written(rows), [], [], {}
    for name, configuration in arms.items():
        content = content_hash(configuration)
        error = None
        if content not in known:
            try:
                known[content] = written(build(shared, configuration))
            except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as e:
                error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
        if error is None:
            done.append(known[content].withColumn("arm", F.lit(name)))
        told.append((name, content, error is not None, error))
    states = rows.sparkSession.createDataFrame(told, "arm string, hash string, failed boolean, error string")
    return (reduce(DataFrame.unionByName, done) if done else None), states


def differences(results: DataFrame, key: str, metrics: list[str], a: str, b: str) -> DataFrame:
    """(key, metric, a, b, diff) for every key of either arm, in one pass over the results."""
    long = results.where(F.col("arm").isin(a, b)).unpivot([key, "arm"], metrics, "metric", "value")
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    return long.groupBy(key, "metric").agg(value(a).alias("a"), value(b).alias("b")).withColumn("diff", F.col("b") - F.col("a"))
