"""Helpers of the corpus operators: tables, scratch tables, names and Arrow tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.sources.session import shared_dir, ship_package

#: White space of the word rule ``[^\\x20\\x09-\\x0D]+``.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet`` as it lies."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rerun of a scan, never of an iteration.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names near ``wanted`` that ``df`` does not have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_columns(
    df: DataFrame, columns: list[str], add: str, make: Callable[[pa.RecordBatch], list]
) -> DataFrame:
    """``columns`` of ``df`` and those of the schema ``add``, made batch by batch.

    ``make`` gets the batch and returns one Arrow array or list per new column. A new column takes
    the place of one that has its name, in any case of letters; ``make`` still sees the old one.
    Row order and number stay, so this is a map without a shuffle.
    """
    ship_package(df.sparkSession)
    picked = df.select(*[col(c) for c in columns])
    added = T.StructType.fromDDL(add).fields
    names = {f.name.lower() for f in added}
    stay = [i for i, f in enumerate(picked.schema.fields) if f.name.lower() not in names]
    schema = T.StructType([*[picked.schema.fields[i] for i in stay], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            new = make(batch)
            fields = list(target)[len(stay):]
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type)
                      for a, f in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in stay],
                 *[a.cast(f.type) for a, f in zip(arrays, fields)]],
                names=target.names)

    return picked.mapInArrow(run, schema)


def arrow_rows(
    df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], ddl: str
) -> DataFrame:
    """Rows of the schema ``ddl``, made per partition: ``make`` turns its batches into lists of rows."""
    ship_package(df.sparkSession)
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for rows in make(batches):
            columns = zip(*rows) if rows else [()] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)],
                schema=target)

    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    """How many words a text has: the word starts, counted without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
