"""Sharding along a Hilbert curve over quantised metadata.

Each row gets a few small whole numbers (source, language, size class ...), these a place on the
Hilbert curve, and the curve is cut into runs of equal row counts. A shard then spans a small box
in all dimensions at once, so minima and maxima per file prune by any of them.

The order is exact: rows are range-partitioned by (curve, ties), sorted inside the partitions and
written once; a row's rank is the number of rows in earlier partitions plus its place in its own.
No task sees more than its range, and a hot source, language or size is cut by the ties.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import arrow_columns, col, fresh, kept
from askframe.llm.hilbert import hilbert_index

#: monotonically_increasing_id has the partition above this bit, the place in it below.
PLACE_BITS = 33


def size_class(size: Column, bits: int) -> Column:
    """Half octaves of a size, so that a class spans a factor of about 1.4; the last is open."""
    return F.least(
        F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 2), F.lit((1 << bits) - 1)
    ).cast("int")


def name_class(name: Column, bits: int) -> Column:
    """A class for a name by its hash; null has one too."""
    return F.pmod(F.xxhash64(name), F.lit(1 << bits)).cast("int")


def on_curve(df: DataFrame, dimensions: dict[str, Column], bits: int, curve: str) -> DataFrame:
    """``df`` and its place ``curve`` on the Hilbert curve over ``dimensions``.

    Dimensions are whole numbers; nulls count as 0, and values out of range go to the nearest end.
    """
    top = (1 << bits) - 1
    helpers = fresh(df, *[f"dim_{d}" for d in dimensions])
    clipped = {
        name: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(top)).cast("int")
        for name, c in zip(helpers, dimensions.values(), strict=True)
    }
    wide = df.withColumns(clipped)
    places = [wide.columns.index(h) for h in helpers]

    def make(batch: pa.RecordBatch) -> list:
        axes = [batch.column(i).to_numpy(zero_copy_only=False) for i in places]
        return [pa.array(hilbert_index(axes, bits))]

    return arrow_columns(wide, wide.columns, f"`{curve}` long", make).drop(*helpers)


def ranked(df: DataFrame, order: list[str], rank: str) -> DataFrame:
    """``df`` and each row's exact place from 0 in the order of ``order``, and the row count.

    Adds ``rank`` and ``<rank>_of``. Rows equal in all of ``order`` share a range partition; name
    enough columns to tell rows apart. An empty table stays empty.
    """
    place, part, before, total = fresh(df, "place", "part", "before", f"{rank}_of")
    keys = [col(c).asc_nulls_first() for c in order]
    stored = kept(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn(place, F.monotonically_increasing_id()),
        "ranked",
    ).withColumn(part, F.shiftright(col(place), PLACE_BITS))
    # One row per partition of the sort: that many numbers bound the window and the broadcast.
    counts = stored.groupBy(part).agg(F.count("*").alias(before))
    offsets = counts.select(
        part,
        (F.sum(before).over(Window.orderBy(part)) - col(before)).alias(before),
        F.sum(before).over(Window.partitionBy()).alias(total),
    )
    return (
        stored.join(F.broadcast(offsets), part)
        .withColumn(rank, col(before) + col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
        .drop(place, part, before)
        .withColumnRenamed(total, f"{rank}_of")
    )


def hilbert_shards(
    df: DataFrame, dimensions: dict[str, Column], ties: list[str], shards: int = 16, bits: int = 5
) -> DataFrame:
    """``df`` with ``curve`` (long), ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long).

    Shards are runs along the curve whose row counts differ by one at most; ``slot`` counts from 0
    without gaps inside a shard, in curve order. Fewer rows than shards leave the others empty.
    Null metadata has a class of its own; equal rows get neighbouring slots in any order. Existing
    columns named ``curve``, ``shard`` or ``slot`` are refused with ``ValueError``.
    """
    clash = {"curve", "shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of the sharding; rename them")
    rank, = fresh(df, "rank")
    whole = ranked(on_curve(df, dimensions, bits, "curve"), ["curve", *ties], rank)
    exact = F.expr(f"cast((`{rank}` * {shards}) div `{rank}_of` as int)")
    first = F.expr(f"(shard * `{rank}_of` + {shards - 1}) div {shards}")
    return (
        whole.withColumn("shard", exact)
        .withColumn("slot", (col(rank) - first).cast("long"))
        .drop(rank, f"{rank}_of")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, for readers that skip files by minimum and maximum.

    A shard is written by several tasks when it is large: the range partitioning cuts by slot too.
    """
    (
        sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
