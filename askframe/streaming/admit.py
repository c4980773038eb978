"""Requests as a stream up to admission: specs interned over the life of the stream.

What has been interned is kept by spec hash in the folder ``specs``, in parts by batch. A batch
first reduces its requests to their distinct specs and then hands on only those that no earlier
batch had, so whatever is done once per question (heads, option texts, tokens) is done once in the
life of the stream, not once in every batch. A batch that is run again sees the specs of the
batches before it and replaces its own files, so it ends in the same state.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from askframe.operators.route import RouterOptions
from askframe.plans.predict import QUESTIONS_TYPE, admit, keyed_by_spec, specs_of

SPECS = f"spec_id string, questions {QUESTIONS_TYPE}"
BATCHES = "rows long, dead long, new_specs long"


def admit_batch(
    batch: DataFrame,
    batch_id: int,
    target: str,
    catalog: DataFrame,
    options: RouterOptions = RouterOptions(),
    max_len: int = 0,
) -> None:
    """Admit one batch of parsed requests and write its folders ``specs``, ``rows`` (parted by
    ``dead``) and ``batches`` (its counts, observed while they were written)."""
    spark = batch.sparkSession

    def place(name: str) -> str:
        return f"{target}/{name}/batch_id={batch_id}"

    # Parsing and hashing are the dear part, and specs and rows both need them, several times over.
    # A lost part is parsed again.
    batch = keyed_by_spec(batch).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, own = specs_of(batch)
        earlier = spark.read.schema(f"{SPECS}, batch_id long").parquet(f"{target}/specs").where(
            F.col("batch_id") < batch_id)
        new, admitted = Observation(), Observation()
        (
            own.select("spec_id", "questions").join(earlier.select("spec_id"), "spec_id", "left_anti")
            .observe(new, F.count(F.lit(1)).alias("n"))
            .write.mode("overwrite").parquet(place("specs"))
        )
        (
            admit(rows, own, catalog, options, max_len)
            .withColumn("dead", F.col("error").isNotNull())
            .observe(admitted, F.count(F.lit(1)).alias("rows"), F.count("error").alias("dead"))
            .write.mode("overwrite").partitionBy("dead").parquet(place("rows"))
        )
        counts = admitted.get
        spark.createDataFrame([(counts["rows"], counts["dead"], new.get["n"])], BATCHES).coalesce(1).write.mode(
            "overwrite").parquet(place("batches"))
    finally:
        batch.unpersist()


def admit_stream(
    requests: DataFrame,
    target: str,
    checkpoint: str,
    catalog: DataFrame,
    options: RouterOptions = RouterOptions(),
    max_len: int = 0,
    available_now: bool = True,
) -> StreamingQuery:
    """Intern, route and admit a stream of parsed requests (``parse_requests``) below ``target``.

    ``read_stream_results(spark, f"{target}/rows")`` reads the admitted and the dead ones,
    ``read_specs`` the specs, each of which was handed on once.
    """
    # So that the first batch has something to read; later starts leave the folder as it is.
    requests.sparkSession.createDataFrame([], SPECS).write.mode("ignore").parquet(f"{target}/specs/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        admit_batch(batch, batch_id, target, catalog, options, max_len)

    writer = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_specs(spark: SparkSession, target: str) -> DataFrame:
    """The specs of a stream and the batch that brought each."""
    return spark.read.schema(f"{SPECS}, batch_id long").parquet(f"{target}/specs")


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """Requests, dead letters and new specs of every batch."""
    return spark.read.schema(f"{BATCHES}, batch_id long").parquet(f"{target}/batches")
