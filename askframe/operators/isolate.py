"""Batch functions over a column, where a faulty row does not take its batch with it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions.text import col


def run_isolated(values: list, make: Callable[[list], list]) -> tuple[list, list[str | None]]:
    """Results and errors of ``make`` over ``values``, one of the two per value.

    ``make`` gets lists and returns as many results. Where it raises, or returns another number of
    them, its list is halved, until the faulty value is alone; the others are then made without it.
    With f faulty values among n that takes about f * log2(n) more calls.
    """
    results: list = [None] * len(values)
    errors: list[str | None] = [None] * len(values)
    work = [(0, len(values))] if values else []
    while work:
        lo, hi = work.pop()
        try:
            made = make(values[lo:hi])
            if len(made) != hi - lo:
                raise ValueError(f"{len(made)} results for {hi - lo} rows")
        except Exception as e:  # the row is answered with it
            if hi - lo == 1:
                errors[lo] = f"{type(e).__name__}: {e}"
            else:
                middle = (lo + hi) // 2
                work += [(lo, middle), (middle, hi)]
            continue
        results[lo:hi] = made
    return results, errors


def map_isolated(
    df: DataFrame, value: Column | str, make: Callable[[list], list], out: str, out_type: T.DataType,
    error: str = "error", error_class: str = "error_class",
) -> DataFrame:
    """Add ``out``, made of ``value`` batch by batch, and the error of the rows that it fails for.

    A failing row has a null ``out``, the error's text and class ``internal``; all others are as if
    it were not there. Errors that came with the rows (columns ``error`` and ``error_class``) stay:
    such rows are not made. An Arrow job without a shuffle.
    """
    kind = T.StructType([T.StructField("out", out_type), T.StructField("problem", T.StringType())])

    @F.arrow_udf(kind)
    def job(values: pa.Array, skip: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        given, left_out = values.to_pylist(), skip.to_pylist()
        asked = [i for i, s in enumerate(left_out) if not s]
        results, errors = [None] * len(given), [None] * len(given)
        made, problems = run_isolated([given[i] for i in asked], make)
        for i, r, p in zip(asked, made, problems):
            results[i], errors[i] = r, p
        return pa.StructArray.from_arrays(
            [pa.array(results, to_arrow_type(out_type)), pa.array(errors, pa.string())],
            names=["out", "problem"])

    none = F.lit(None).cast("string")
    came = F.col(error) if error in df.columns else none
    known = F.col(error_class) if error_class in df.columns else none
    taken = {c.lower() for c in df.columns}
    job_name = next(n for n in ("job" + "_" * i for i in range(99)) if n not in taken)
    done = df.withColumn(job_name, job(col(value), came.isNotNull()))
    problem = F.col(job_name)["problem"]
    return done.withColumns({
        out: F.col(job_name)["out"],
        error_class: F.when(came.isNotNull(), known).when(problem.isNotNull(), "internal"),
        error: F.coalesce(came, problem),
    }).drop(job_name)
