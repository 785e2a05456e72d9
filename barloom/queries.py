"""The registered queries of the engine, and the SQL that each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hand_sql, library_queries, market_queries, model_queries, report_queries
from .factors import library, registry, table
from .sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _add_factors(name: str, own: list[str]) -> None:
    add(name, lambda spark, sf_dir: library.factors(table.stored_panel(adapters.panel(spark, sf_dir)), own), adapters.with_tables(library.factors_sql("SELECT * FROM panel", own)))


CLASSIC = ("technical", "statistics", "ewma", "vwap", "position", "turnover", "acceleration", "range", "composite", "correlation", "breadth", "custom", "market", "liquidity", "extreme", "moments", "long")
for _family in CLASSIC:
    _add_factors(f"factors_{_family}", registry.names(_family))
for _family in ("alpha101", "gtja191", "alpha101_variants"):
    for _k, _own in enumerate(library.batches(_family)):
        _add_factors(f"factors_{_family}_{_k + 1:02d}", _own)
for _module in (market_queries, model_queries, report_queries, library_queries):
    for _name, _query in _module.QUERIES.items():
        add(_name, _query, _module.ORACLES.get(_name))
add("factors_by_hand", lambda spark, sf_dir: library.factors(table.stored_panel(adapters.panel(spark, sf_dir)), hand_sql.FACTORS), hand_sql.factors())
