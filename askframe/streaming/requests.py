"""Requests as a stream: the batch functions over ``readStream``.

Everything is stateless, so there is no watermark. Each micro-batch is written once, under its own
batch id and parted into answered rows and dead letters; a batch that is run again after a failure
replaces its own files, which makes the sink exactly-once. How much a batch holds is the source's
matter: give ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` when reading, as a backlog is else
one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def spread(stream: DataFrame) -> DataFrame:
    """Deal the rows of every micro-batch evenly to all tasks, before a step that is dear per row.

    A micro-batch is read by about one task per file, so large files would be parsed by a few tasks
    however many cores there are. Rows are dealt in turn, as keys may be null or repeat.
    """
    spark = stream.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stream.repartition(max(tasks, spark.sparkContext.defaultParallelism))


def write_stream(
    rows: DataFrame, target: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write transformed streaming rows to ``target``, in folders by batch and by ``dead``.

    ``rows`` is the stream after parsing, routing or prediction, so its plan is built once and
    not in every micro-batch. Rows whose ``error`` is set are dead letters; without that column
    none is.
    """
    dead = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)

    def write(out: DataFrame, batch_id: int) -> None:
        out.withColumn("dead", dead).write.mode("overwrite").partitionBy("dead").parquet(
            f"{target}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_stream_results(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """What a stream has written: rows without and with an error."""
    rows = spark.read.parquet(target).drop("batch_id")
    dead = F.col("dead").cast("boolean")  # a folder name
    return rows.where(~dead).drop("dead"), rows.where(dead).drop("dead")
