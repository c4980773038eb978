"""Hot keys: which they are, and how they are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from askframe.llm.common import kept

#: Keys above this share of the rows are hot, so there are at most as many hot keys.
SHARES = 4096


def repeated_keys(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``keys`` and the number ``n`` of the rows of those with more than one, and that of all rows.

    Counts cover all rows and are made on the map side first.
    """
    seen = Observation()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).observe(
        seen, F.sum("n").alias("total"))
    return kept(counts.where("n > 1"), "counts"), seen.get["total"] or 0


def hot_keys(repeated: DataFrame, total: int, shares: int | None = None) -> DataFrame:
    """Keys of ``repeated_keys`` with more than 1/``shares`` (default ``SHARES``) of the rows, and
    the ``salts`` to spread each over.

    There are at most ``shares`` of them whatever the input, so the table may be broadcast; the
    salts sum up to at most twice that number.
    """
    shares = shares or SHARES
    return kept(
        repeated.where(F.col("n") * shares > total)
        .withColumn("salts", F.ceil(F.col("n") * shares / F.lit(max(total, 1))).cast("int"))
        .drop("n"), "hot")
