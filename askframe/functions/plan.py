"""Keeping computed columns computed once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seal(df: DataFrame, *names: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Make ``names`` columns that later steps read instead of computing them again; leave out
    the helper columns ``drop``.

    The optimizer moves filters below projections by putting the computation into the
    condition, and a chain of projections unfolds into a huge expression that way: a filter on
    a detected script would run the regular expressions dozens of times per row, and a join on
    a routed model would take minutes to plan. One generated row per row stops both, at the
    cost of a row copy inside the same stage.
    """
    rest = [c for c in df.columns if c not in names and c not in drop]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def aside(
    df: DataFrame, helpers: tuple[str, ...], *given: Column
) -> tuple[DataFrame, list[Column], Callable[[DataFrame], DataFrame]]:
    """Make room for helper columns: (table, the given expressions, the way back).

    Columns of the table that have the name of a helper get another one for the time being, and
    the expressions, which may read them, are computed before. Tables without such columns stay
    as they are.
    """
    low = {h.lower() for h in helpers}
    taken = [c for c in df.columns if c.lower() in low]
    if not taken:
        return df, list(given), lambda done: done
    names = {c.lower() for c in df.columns} | low

    def new(base: str) -> str:
        name = next(n for i in count() if (n := f"{base}_{i}").lower() not in names)
        names.add(name.lower())
        return name

    inputs = [new("given") for _ in given]
    moved = {c: new("kept") for c in taken}
    order = list(df.columns)
    df = df.withColumns(dict(zip(inputs, given, strict=True))).withColumnsRenamed(moved)

    def back(done: DataFrame) -> DataFrame:
        done = done.drop(*inputs).withColumnsRenamed({v: k for k, v in moved.items()})
        return done.select(*order, *[c for c in done.columns if c not in order])

    return df, [F.col(i) for i in inputs], back
