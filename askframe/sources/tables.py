"""Reading tables and joining small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Read ``<root>/<name>.parquet`` as it lies.

    How many tasks read it is the session's matter (``spark.sql.files.maxPartitionBytes``).
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream_table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """``<root>/<name>.parquet`` as a stream, be it one file or a folder of files.

    A stream reads folders. A pattern that only this name fits is read as either; the name of a
    file alone, or of files in the folder above, finds nothing where the table is a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{root.rstrip('/')}/{name}.parque[t]")


#: Keys above this share of the rows are hot; so many of them there are at most.
HOT_SHARES = 64


def hot_keys(rows: DataFrame, key: Column) -> DataFrame:
    """``hot`` (a hash of the key) and ``salts`` of keys with more than 1/64 of the rows.

    One mergeable heavy-hitter sketch over the key alone; the result has at most 64 rows
    whatever the table holds. Counts may be a little too high, which only adds salts.
    """
    sketch = rows.select(F.xxhash64(key).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_SHARES}, {64 * HOT_SHARES})").alias("top"),
        F.count(F.lit(1)).alias("n"))
    one = F.col("top")["count"] * HOT_SHARES
    return sketch.select(F.explode("top").alias("top"), "n").where(one > F.col("n")).select(
        F.col("top")["item"].alias("hot"), F.ceil(one / F.col("n")).cast("int").alias("salts"))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str | list[str],
    how: str = "left",
    bounded: bool = False,
    row_id: str | list[str] | None = None,
    hot_by: str | None = None,
) -> DataFrame:
    """Join a lookup table whose key is unique to many rows, safe for hot keys.

    ``bounded`` is for tables that are bounded by construction (presets, checkpoints): they are
    broadcast. Any other table is shuffled together with the rows on (key, salt). Only keys that a
    sketch of the column ``hot_by`` (default: the first key) finds hot have more than one salt, and
    as many as their count asks for: their rows are spread by a hash of ``row_id``, their row of the
    table is copied. Null keys are spread like any other. A task that is run again gives its rows
    the same salts. Without a ``row_id`` the columns that are no text, array or struct are it.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join keeps the rows: left or inner")
    keys = [key] if isinstance(key, str) else list(key)
    if bounded:
        return rows.join(F.broadcast(table), keys, how)
    if row_id is None:
        row_id = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)
                  and not isinstance(f.dataType, (T.StringType, T.BinaryType))] or keys
    by = F.col(hot_by or keys[0])
    taken = {c.lower() for c in [*rows.columns, *table.columns]}
    salt, hot, salts = (next(n for n in (name + "_" * i for i in range(99)) if n not in taken)
                        for name in ("salt", "hot", "salts"))
    found = F.broadcast(hot_keys(rows, by).withColumnsRenamed({"hot": hot, "salts": salts}))
    ids = [row_id] if isinstance(row_id, str) else row_id
    spread = F.pmod(F.xxhash64(*ids), F.col(salts)).cast("int")
    salted_rows = (
        rows.withColumn(hot, F.xxhash64(by)).join(found, hot, "left")
        .withColumn(salt, F.coalesce(spread, F.lit(0))).drop(hot, salts)
    )
    every = F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1)
    salted_table = (
        table.withColumn(hot, F.xxhash64(by)).join(found, hot, "left")
        .withColumn(salt, F.explode(every)).drop(hot, salts)
    )
    return salted_rows.join(salted_table, [*keys, salt], how).drop(salt)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: its lineage is cut and its size is known."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table from the code, e.g. the presets."""
    return spark.createDataFrame(rows, schema)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
