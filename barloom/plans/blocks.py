"""Windows over blocks of whole codes (or dates) in numpy, a block of rows at a time in a task that Spark fed and sorted.

A sliding frame costs Spark's window a pass over the frame for each row and each function. Here a frame of d rows costs d
additions of whole arrays. Sums run from a frame's oldest row to its newest, as in Spark's frames, so both agree to the bit.
NULL is NaN. An array of a code window is (time, code), shorter codes filled up with NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: A block has at least so many rows, where its partition has them: enough for numpy, few enough for a core's cache.
ROWS = 16384


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, least: int = ROWS) -> Iterator[pa.Table]:
    """The batches, in order of key, as tables that cut no group."""
    held, n, wait = [], 0, least
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < wait:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table.column(key))
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
            held, n, wait = table.slice(cut).to_batches(), n - cut, least
        else:
            wait = 2 * n  # a group longer than a block
    if n:
        yield pa.Table.from_batches(held)


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    ids = own.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def along_codes(table: pa.Table, key: str, runs: dict[str, tuple[Callable, list[str]]]) -> dict[str, np.ndarray]:
    starts, n = _starts(table.column(key)), table.num_rows
    lengths = np.diff(np.append(starts, n))
    longest = int(lengths.max())
    if longest * len(lengths) > 2 * n + ROWS:  # codes of very different length: filling up would cost more than it saves
        parts = [along_codes(table.slice(s, k), key, runs) for s, k in zip(starts.tolist(), lengths.tolist())]
        return {name: np.concatenate([p[name] for p in parts]) for name in runs}
    code = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n) - starts[code]
    grids: dict[str, np.ndarray] = {}
    for name in {a for _, args in runs.values() for a in args}:
        grids[name] = np.full((longest, len(lengths)), np.nan)
        if name != key:
            grids[name][at, code] = _doubles(table, name)
    with np.errstate(all="ignore"):
        return {name: run(*(grids[a] for a in args))[at, code] for name, (run, args) in runs.items()}


def across_date(table: pa.Table, key: str, runs: dict[str, tuple[Callable, list[str]]]) -> dict[str, np.ndarray]:
    starts = np.append(_starts(table.column(key)), table.num_rows).tolist()
    names = {a for _, args in runs.values() for a in args}
    columns = {a: _doubles(table, a) if pa.types.is_floating(table.schema.field(a).type) else _ids(table.column(a)) for a in names}
    found: dict[str, list[np.ndarray]] = {name: [] for name in runs}
    with np.errstate(all="ignore"):
        for a, b in zip(starts, starts[1:]):
            for name, (run, args) in runs.items():
                found[name].append(run(*(columns[c][a:b] for c in args)))
    return {name: np.concatenate(parts) for name, parts in found.items()}


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return pd.factorize(column.to_pandas(), use_na_sentinel=False)[0]


def evaluated(df: DataFrame, key: str, keep: list[str], runs: dict[str, tuple[Callable, list[str]]], each: Callable) -> DataFrame:
    """df, whose partitions hold whole groups of key in order, with a column for each run; only keep of its own goes on."""
    rows, doubles = packed(df)
    schema = StructType([*(f for f in df.schema.fields if f.name in keep), *(StructField(name, DoubleType()) for name in runs)])
    order = [f.name for f in schema.fields if f.name not in runs]

    def of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key):
            table = unpacked(table, doubles)
            values = each(table, key, runs)
            out = table.select(order)
            for name in runs:
                out = out.append_column(name, pa.array(values[name], from_pandas=True))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(of_blocks, schema)


PACKED = "_doubles"


def packed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its doubles as one array, and their names: for each row that goes to a worker Spark asks every column's size."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.select(*(c for c in df.columns if c not in doubles), F.array(*doubles).cast("array<double>").alias(PACKED)), doubles


def unpacked(table: pa.Table, doubles: list[str]) -> pa.Table:
    own = table.column(PACKED).combine_chunks()
    own = (pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own).flatten()
    values, none = (v.to_numpy(zero_copy_only=False).reshape(table.num_rows, len(doubles)).T.copy() for v in (own, own.is_null()))
    table = table.drop_columns(PACKED)
    for name, v, mask in zip(doubles, values, none):
        table = table.append_column(name, pa.array(v, pa.float64(), mask=mask))
    return table


def tidied(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the columns of names tidied, as expression.tidy does; so many cases are too long a method for Java to compile."""
    rows, doubles = packed(df)
    schema = df.schema

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = unpacked(pa.Table.from_batches([batch]), doubles)
            for name in names:
                own = table.column(name)
                value = pa.array(tidy(own.to_numpy()), pa.float64(), mask=own.is_null().to_numpy())
                table = table.set_column(table.schema.get_field_index(name), name, value)
            yield from table.select(schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(of_batches, schema)


def tidy(x: np.ndarray) -> np.ndarray:
    size = np.abs(x)
    with np.errstate(over="ignore"):
        small = whole(whole(x * 1e9) / 1e3) / 1e6
        return np.where(size < 1e3, small, np.where(size < 1e6, whole(x * 1e3) / 1e3, whole(x))) + 0.0


# windows of d rows; x and y are (time, code)


def rows_of(x: np.ndarray, d: int) -> Iterator[np.ndarray]:
    """For each place of the frame, from the oldest on, the value that every row sees there."""
    n = len(x)
    padded = np.concatenate([np.full((d - 1, x.shape[1]), np.nan), x])
    return (padded[k : k + n] for k in range(d))


def lag(x: np.ndarray, d: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    if d < len(x):
        out[d:] = x[: len(x) - d]
    return out


def lead(x: np.ndarray, d: int) -> np.ndarray:
    return lag(x[::-1], d)[::-1]


def count(x: np.ndarray, d: int) -> np.ndarray:
    total = np.cumsum(~np.isnan(x), axis=0, dtype=float)
    total[d:] = total[d:] - total[:-d].copy() if d < len(x) else total[d:]
    return total


def enough(x: np.ndarray, d: int, least: int, value: np.ndarray) -> np.ndarray:
    return np.where(count(x, d) >= least, value, np.nan)


def total(x: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros_like(x)
    for row in rows_of(np.where(np.isnan(x), 0.0, x), d):
        out += np.where(np.isnan(row), 0.0, row)
    return out


def extreme(best: np.ufunc, x: np.ndarray, d: int) -> np.ndarray:
    out = np.full_like(x, np.nan)
    for row in rows_of(x, d):
        best(out, row, out=out)
    return out


def moments(x: np.ndarray, d: int, order: int = 2) -> list[np.ndarray]:
    """n, mean and the sums of powers of the distances from it, value by value."""
    n, mean = np.zeros_like(x), np.zeros_like(x)
    m2, m3, m4 = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    gaps = bool(np.isnan(x).any()) or len(x) >= 1
    for row in rows_of(x, d):
        has = ~np.isnan(row) if gaps else True
        new = n + has
        delta = row - mean
        part = delta / new
        step2 = delta * (delta - part)
        if order > 2:
            sq, psq = delta * delta, part * part
            new2 = m2 + step2
            new3 = m3 - 3.0 * part * new2 + delta * (sq - psq)
            m4 = np.where(has, m4 - 4.0 * part * new3 - 6.0 * psq * new2 + delta * (delta * sq - part * psq), m4)
            m3 = np.where(has, new3, m3)
        m2 = np.where(has, m2 + step2, m2)
        mean = np.where(has, mean + part, mean)
        n = new
    return [n, mean, m2, m3, m4]


def rolled(name: str, x: np.ndarray, d: int, least: int) -> np.ndarray:
    if name in ("min", "max"):
        value = extreme(np.fmin if name == "min" else np.fmax, x, d)
    elif name in ("sum", "avg"):
        value = total(x, d)
        value = value / count(x, d) if name == "avg" else value
    else:
        n, _, m2, *_ = moments(x, d)
        value = np.sqrt(m2 / (n if name == "stddev_pop" else n - 1))
    return enough(x, d, least, value)


def since(name: str, x: np.ndarray, d: int) -> np.ndarray:
    """Rows since the window's largest (smallest) value, the oldest of equal ones."""
    best, at = np.full_like(x, np.nan), np.full_like(x, np.nan)
    for k, row in enumerate(rows_of(x, d)):
        better = (row > best if name == "max" else row < best) | (np.isnan(best) & ~np.isnan(row))
        best, at = np.where(better, row, best), np.where(better, d - 1.0 - k, at)
    return enough(x, d, d, at)


def ranked(x: np.ndarray, d: int) -> np.ndarray:
    below = np.zeros_like(x)
    for row in rows_of(x, d):
        below += row <= x
    return enough(x, d, d, below / d)


def product(x: np.ndarray, d: int, least: int) -> np.ndarray:
    out = np.ones_like(x)
    for row in rows_of(x, d):
        out *= np.where(np.isnan(row), 1.0, row)
    return enough(x, d, least, out)


def together(x: np.ndarray, y: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squared distances of x and of y from their means and of the products; only for windows without NULL."""
    ax, ay, mx, my, c = (np.zeros_like(x) for _ in range(5))
    for k, (u, v) in enumerate(zip(rows_of(x, d), rows_of(y, d))):
        dx, dy = u - ax, v - ay
        px, py = dx / (k + 1.0), dy / (k + 1.0)
        ax, ay = ax + px, ay + py
        mx, my = mx + dx * (dx - px), my + dy * (dy - py)
        c = c + dx * (v - ay)
    return mx, my, c


def correlated(x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
    mx, my, c = together(x, y, d)
    sx, sy = np.sqrt(mx / d), np.sqrt(my / d)
    return np.where((sx >= 1e-7) & (sy >= 1e-7), np.clip(c / d / (sx * sy), -1.0, 1.0), np.nan)


def _power(x: float, a: float) -> float:
    try:
        return math.pow(x, a)
    except (OverflowError, ValueError):  # x is not negative, so neither overflow nor 1 / 0 is anything else
        return math.inf


def power(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.frompyfunc(_power, 2, 1)(np.abs(x), a).astype(float)


def skewed(x: np.ndarray, d: int) -> np.ndarray:
    n, _, m2, m3, _ = moments(x, d, 3)
    return enough(x, d, d, np.where(m2 == 0, np.nan, np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2) * ((d * (d - 1)) ** 0.5 / (d - 2))))


def peaked(x: np.ndarray, d: int) -> np.ndarray:
    n, _, m2, _, m4 = moments(x, d, 4)
    a = (d - 1) / ((d - 2) * (d - 3))
    return enough(x, d, d, np.where(m2 == 0, np.nan, a * ((d + 1) * (n * m4 / (m2 * m2) - 3.0) + 6)))


# a day's codes; x is one row a code


def whole(x: np.ndarray) -> np.ndarray:
    """The nearest whole number, halves away from 0."""
    return np.where(np.abs(x) < 2.0**52, np.trunc(x + np.copysign(0.49999999999999994, x)), x)


def places(x: np.ndarray, p: int) -> np.ndarray:
    """x to p places as SQL rounds it, which is x times ten to the p to a whole number; Spark rounds its decimal digits."""
    with np.errstate(over="ignore"):
        own = whole(x * 10.0**p) / 10.0**p
    return np.where(np.isinf(own), x, own)


def mean_rank(x: np.ndarray) -> np.ndarray:
    """Share of the valid codes at or below, ties at their mean."""
    out, has = np.full_like(x, np.nan), np.flatnonzero(~np.isnan(x))
    if len(has):
        order = has[np.argsort(x[has], kind="stable")]
        own = x[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ties = np.diff(np.append(first, len(own)))
        out[order] = np.repeat((first + 1 + (ties - 1) / 2) / len(own), ties)
    return out


def scaled(x: np.ndarray, to: float) -> np.ndarray:
    size = np.nansum(np.abs(x))
    return x * to / size if size else np.full_like(x, np.nan)


def centred(x: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    has = ~np.isnan(x)
    group = np.zeros(len(x), dtype=int) if group is None else group
    sums, n = np.bincount(group[has], weights=x[has], minlength=group.max() + 1), np.bincount(group[has], minlength=group.max() + 1)
    return x - (sums / n)[group]


def standard(x: np.ndarray) -> np.ndarray:
    own = x[~np.isnan(x)]
    spread = own.std() if len(own) else 0.0
    return (x - own.mean()) / spread if spread > 1e-12 else np.full_like(x, np.nan)


def by_date(df: DataFrame, run: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """What run makes of each day's rows, as columns of schema."""

    def of_days(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "date"):
            starts = np.append(_starts(table.column("date")), table.num_rows).tolist()
            for a, b in zip(starts, starts[1:]):
                yield pa.RecordBatch.from_pydict(run(table.slice(a, b - a)))

    return df.repartition("date").sortWithinPartitions("date").mapInArrow(of_days, schema)
