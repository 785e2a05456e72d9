"""All factors over a panel: by name, by family, or in batches that one plan holds comfortably."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.expression import as_sql, evaluate
from . import alpha101, classic, gtja191, registry  # noqa: F401  they register their factors

#: Factors of one plan; more would only lengthen its generated code.
BATCH = 12


def batches(family: str, size: int = BATCH) -> list[list[str]]:
    names = registry.names(family)
    return [names[k : k + size] for k in range(0, len(names), size)]


def factors(panel: DataFrame, names: list[str], rounded: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """code, date, the panel's columns named in also, and a column for each factor."""
    return evaluate(panel, {n: registry.make(n) for n in names}, rounded, also)


def factors_sql(panel: str, names: list[str]) -> str:
    return as_sql(panel, {n: registry.make(n) for n in names})
