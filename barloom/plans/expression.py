"""Factor expressions: SQL fragments over one bar table, staged so that windows nest.

SQL does not let a window stand inside a window. An expression here is a fragment with other expressions as its
arguments; stages() puts the windows of many expressions in as few steps as their nesting allows, alternating windows
along a code's dates ("t"), windows across a date's codes ("x"), and per-code recursions ("r"). Catalyst plans each
step: consecutive "t" steps share one exchange and sort by code, and only columns that a later step needs go on.

The same fragments run on Spark (evaluate) and print as plain SQL (as_sql), where the few functions whose names differ
are given for both.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, chains

SPARK, SQL = "spark", "sql"
CODE, DATE = "code", "date"


class Expression:
    """kind: "c" a column, "e" element-wise, "t" along a code, "x" across a date, "r" a recursion along a code.

    run does the window's work over blocks of whole codes (dates), by: a column that run gets after the arguments. A window
    without a run is left to Spark. there: what takes its place when it runs and is not printed as SQL. do is the same
    as the text of an element, over arrays whose NULL is NaN (a condition is false there); value is that of a number.
    """

    there: Expression | None = None
    do: Callable | None = None
    value: float | None = None

    def __init__(self, kind: str, text: str | dict[str, str], args: tuple[Expression, ...] = (), run: Callable | None = None, by: str | None = None):
        self.kind, self.text, self.args, self.run, self.by = kind, text if isinstance(text, dict) else {SPARK: text, SQL: text}, args, run, by
        self.key = f"{kind}:{self.text[SPARK]}({','.join(a.key for a in args)})" if args else self.text[SPARK]
        self.windows: frozenset[str] = frozenset().union(*(a.windows | ({a.key} if a.kind in "txr" else set()) for a in args))

    def __add__(self, other):
        return element("({0} + {1})", self, other, do=np.add)

    def __radd__(self, other):
        return element("({0} + {1})", other, self, do=np.add)

    def __sub__(self, other):
        return element("({0} - {1})", self, other, do=np.subtract)

    def __rsub__(self, other):
        return element("({0} - {1})", other, self, do=np.subtract)

    def __mul__(self, other):
        return element("({0} * {1})", self, other, do=np.multiply)

    def __rmul__(self, other):
        return element("({0} * {1})", other, self, do=np.multiply)

    def __truediv__(self, other):
        return element("({0} / nullif({1}, 0))", self, other, do=_divided)

    def __rtruediv__(self, other):
        return element("({0} / nullif({1}, 0))", other, self, do=_divided)

    def __pow__(self, other):
        return element("pow({0}, {1})", self, other, do=power)

    def __neg__(self):
        return element("(- {0})", self, do=np.negative)

    def __lt__(self, other):
        return element("({0} < {1})", self, other, do=np.less)

    def __le__(self, other):
        return element("({0} <= {1})", self, other, do=np.less_equal)

    def __gt__(self, other):
        return element("({0} > {1})", self, other, do=np.greater)

    def __ge__(self, other):
        return element("({0} >= {1})", self, other, do=np.greater_equal)

    def __and__(self, other):
        return element("({0} AND {1})", self, other, do=np.logical_and)


def column(name: str) -> Expression:
    return Expression("c", name)


def lift(value) -> Expression:
    if isinstance(value, Expression):
        return value
    if not isinstance(value, (int, float)):
        return Expression("c", str(value))
    own = Expression("c", f"CAST({value!r} AS DOUBLE)")
    own.value = float(value)
    return own


def element(text: str | dict[str, str], *args, do: Callable | None = None) -> Expression:
    own = Expression("e", text, tuple(lift(a) for a in args))
    own.do = do
    return own


def _divided(x, y):
    return x / np.where(np.equal(y, 0), np.nan, y)


def power(x, a):
    return np.where(np.isnan(x) | np.isnan(a), np.nan, np.power(x, a))


def along(text: str | dict[str, str], *args, run: Callable | None = None) -> Expression:
    return Expression("t", text, tuple(lift(a) for a in args), run)


def across(text: str | dict[str, str], *args, run: Callable | None = None, by: str | None = None) -> Expression:
    return Expression("x", text, tuple(lift(a) for a in args), run, by)


def recursion(name: str, sql: str, run: Callable, *args) -> Expression:
    """run takes the arguments, a column a code in order of date. sql is the same thing where no function is at hand."""
    return Expression("r", {SPARK: name, SQL: sql}, tuple(lift(a) for a in args), run)


def _running(node: Expression, made: dict[str, Expression]) -> Expression:
    if node.key not in made:
        if node.there:
            made[node.key] = _running(node.there, made)
        else:
            args = tuple(_running(a, made) for a in node.args)
            own = made[node.key] = node if all(a is b for a, b in zip(args, node.args)) else Expression(node.kind, node.text, args, node.run, node.by)
            own.do = node.do
    return made[node.key]


def _render(node: Expression, names: dict[str, str], dialect: str) -> str:
    if node.key in names:
        return names[node.key]
    if node.kind == "c":
        return node.text[dialect]
    return node.text[dialect].format(*(_render(a, names, dialect) for a in node.args))


class Step:
    """before: plain columns that this step's windows read; own: the windows; keep: names that go on."""

    def __init__(self, kind: str, before: dict[str, Expression], own: dict[str, Expression]):
        self.kind, self.before, self.own = kind, before, own
        self.prior: dict[str, str] = {}  # what stands before this step
        self.names: dict[str, str] = {}  # that and the plain columns
        self.keep: list[str] = []

    def texts(self) -> list[str]:
        """What the step reads, as it is rendered."""
        return [*(_render(n, self.prior, SPARK) for n in self.before.values()), *(_render(n, self.names, SPARK) for n in self.own.values()), *(_render(a, self.names, SPARK) for n in self.own.values() for a in n.args)]


def stages(outputs: dict[str, Expression]) -> tuple[list[Step], dict[str, str]]:
    """The steps, and the names under which nodes stand at the end."""
    found: dict[str, Expression] = {}

    def visit(node: Expression) -> None:
        if node.key in found:
            return
        for a in node.args:
            visit(a)
        if node.kind in "txr":
            found[node.key] = node

    for node in outputs.values():
        visit(node)
    names: dict[str, str] = {}
    number = itertools.count(1)
    left, steps, kind = dict(found), [], "t"
    while left:
        ready = {k: n for k, n in left.items() if n.windows <= names.keys()}
        own = {k: n for k, n in ready.items() if n.kind == kind}
        if not own:
            kind = next(k for k in ("r", "t", "x") if any(n.kind == k for n in ready.values()))
            continue
        before: dict[str, Expression] = {}
        known = dict(names)
        for a in (a for n in own.values() for a in n.args):
            if a.kind == "e" and a.key not in known:
                before[f"v{next(number)}"] = a
                known[a.key] = next(reversed(before))
        step = Step(kind, before, {f"v{next(number)}": n for n in own.values()})
        step.prior, step.names = dict(names), known
        names = known | {n.key: name for name, n in step.own.items()}
        for k in own:
            del left[k]
        steps.append(step)
    needed = {names[k] for node in outputs.values() for k in _uses(node, names)}
    for step in reversed(steps):
        step.keep = sorted(needed)
        for nodes, at in ((step.own, step.names), (step.before, step.prior)):
            needed |= {at[k] for node in nodes.values() for a in node.args for k in _uses(a, at)}
        needed -= step.own.keys() | step.before.keys()
    return steps, names


def _uses(node: Expression, names: dict[str, str]) -> Iterable[str]:
    if node.key in names:
        yield node.key
    else:
        for a in node.args:
            yield from _uses(a, names)


def places(text: str, p: int) -> dict[str, str]:
    """text to p places. Spark's round goes by a decimal number and rounds its digits; SQL's rounds text times ten to the p."""
    q = f"({text} * {10**p}D)"
    spark = f"CASE WHEN abs({q}) < 4503599627370496D THEN CAST(CAST({q} + sign({q}) * 0.49999999999999994D AS BIGINT) AS DOUBLE) / {10**p}D WHEN abs({q}) < 1e308D THEN {q} / {10**p}D ELSE {text} END"
    return {SPARK: f"({spark})", SQL: f"round({text}, {p})"}


def tidy(text: str) -> str:
    """A result to six digits behind the point, fewer for large numbers: what summing in another order may change is cut,
    and there is no negative zero. Small ones are first cut to nine, as products of ranks often lie halfway between two
    numbers of six, where the last bit would decide."""
    cut = lambda by: f"round({text} * CAST({by} AS DOUBLE)) / CAST({by} AS DOUBLE)"
    return f"CASE WHEN abs({text}) < 1000 THEN round(round({text} * CAST(1000000000 AS DOUBLE)) / CAST(1000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) + 0 WHEN abs({text}) < 1000000 THEN {cut(1000)} ELSE {cut(1)} END"


def evaluate(bars: DataFrame, outputs: dict[str, Expression], rounded: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """code, date, the columns of bars named in also, and a column for each output."""
    made: dict[str, Expression] = {}
    outputs = {name: _running(node, made) for name, node in outputs.items()}
    steps, names = stages(outputs)
    if chains.fits(bars, steps, outputs, also):
        return chains.run(bars, steps, outputs, rounded, also)
    final = {name: _render(node, names, SPARK) for name, node in outputs.items()}
    df, placed = bars, None  # placed: the key whose groups lie whole and in order in df's partitions
    for k, step in enumerate(steps):
        if step.before:
            df = df.select(*df.columns, *(F.expr(_render(n, step.prior, SPARK)).alias(name) for name, n in step.before.items()))
        words = set(re.findall(r"\w+", " ".join([*also, *final.values(), *(t for later in steps[k + 1 :] for t in later.texts())])))
        keep = [c for c in df.columns if c in (CODE, DATE) or c in step.keep or c in bars.columns and c in words]
        if all(n.run for n in step.own.values()):
            df = _in_blocks(df, step, keep, placed)
            placed = DATE if step.kind == "x" else CODE
        else:
            df, placed = df.select(*keep, *(F.expr(_render(n, step.names, SPARK)).alias(name) for name, n in step.own.items())), None
    raw = df.select(CODE, DATE, *also, *(F.expr(text).cast("double").alias(name) for name, text in final.items()))
    return blocks.tidied(raw, list(final)) if rounded and final else raw


def _in_blocks(df: DataFrame, step: Step, keep: list[str], placed: str | None) -> DataFrame:
    """A step's windows over blocks of whole codes (dates), which one exchange brings together unless they are already."""
    key = DATE if step.kind == "x" else CODE
    types = dict(df.dtypes)
    runs, own, read = {}, {}, set()
    for name, n in step.own.items():
        args = []
        for text in (_render(a, step.names, SPARK) for a in n.args):
            if text == CODE or types.get(text) == "double":
                args.append(text)
                read.add(text)
            else:
                args.append(own.setdefault(text, f"a{len(own)}"))
        runs[name] = (n.run, args + ([n.by] if n.by else []))
        read |= {n.by} if n.by else set()
    df = df.select(*(c for c in df.columns if c in keep or c in read), *(F.expr(text).cast("double").alias(name) for text, name in own.items()))
    if placed != key:
        df = df.repartition(key).sortWithinPartitions(*((CODE, DATE) if key == CODE else (DATE,)))
    return blocks.evaluated(df, key, keep, runs, blocks.across_date if key == DATE else blocks.along_codes)


def as_sql(bars: str, outputs: dict[str, Expression], rounded: bool = True) -> str:
    """The same as one query with a common table expression a step. bars: a query with the columns of the bar table."""
    steps, names = stages(outputs)
    parts, at = [f"s0 AS ({bars})"], "s0"
    for k, step in enumerate(steps):
        if step.before:
            own = ", ".join(f"{_render(n, step.prior, SQL)} AS {name}" for name, n in step.before.items())
            parts.append(f"b{k} AS (SELECT *, {own} FROM {at})")
            at = f"b{k}"
        own = ", ".join(f"{_render(n, step.names, SQL)} AS {name}" for name, n in step.own.items())
        parts.append(f"s{k + 1} AS (SELECT *, {own} FROM {at})")
        at = f"s{k + 1}"
    raw = ", ".join(f"CAST({_render(node, names, SQL)} AS DOUBLE) AS {name}" for name, node in outputs.items())
    parts.append(f"raw AS (SELECT {CODE}, {DATE}, {raw} FROM {at})")
    final = ", ".join(f"{tidy(name) if rounded else name} AS {name}" for name in outputs)
    return f"WITH {', '.join(parts)} SELECT {CODE}, {DATE}, {final} FROM raw"
