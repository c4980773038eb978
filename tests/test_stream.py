import json

from pyspark.sql import functions as F

from askframe.operators.route import route
from askframe.plans import workloads
from askframe.sources.requests import parse_requests
from askframe.streaming.requests import read_stream_results, spread, write_stream

NOUL = {"q": {"type": "noul", "instructions": "?"}}


def answer(rows):
    df = parse_requests(rows, endpoint="route")
    df = route(df, "context_text", "model", "task", "lang")
    return df.select("value", "error", F.col("route.model").alias("model"), "route.reason")


def test_stream_equals_batch_and_keeps_dead_letters(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    texts = ["hello my dear friend", "привет", "Der die das und nicht auch", "{", ""]

    def add(n, bodies):
        (source / f"part{n}.txt").write_text("\n".join(bodies), encoding="utf8")

    def run():
        stream = spark.readStream.text(str(source)).withColumn("body", F.col("value"))
        query = write_stream(answer(stream), str(target / "out"), str(target / "state"))
        query.awaitTermination()

    add(1, [json.dumps({"context": t, "spec": NOUL}, ensure_ascii=False) for t in texts] + ["{broken"])
    run()
    add(2, ['{"context": "x", "lang": "de"}', '{"nothing": 1}', "[]"])
    run()
    run()  # nothing new: nothing is written twice
    batch = answer(spark.read.text(str(source)).withColumn("body", F.col("value")))
    columns = batch.columns
    ok, dead = (d.select(columns) for d in read_stream_results(spark, str(target / "out")))
    assert sorted(ok.unionByName(dead).collect(), key=str) == sorted(batch.collect(), key=str)
    assert dead.count() == 3 and dead.filter("error IS NULL").count() == 0
    assert ok.filter("error IS NOT NULL").count() == 0


def test_a_table_of_many_files_streams_like_one_file(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "hello my dear friend" if i % 2 else None, "en") for i in range(12)],
        "doc_id long, text string, lang string")
    folder, file = tmp_path / "folder", tmp_path / "file"
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    file.mkdir()
    part, = (tmp_path / "one").glob("part-*.parquet")
    (file / "documents.parquet").write_bytes(part.read_bytes())
    many, one = (sorted(workloads.stream_requests(spark, str(p)).collect(), key=str) for p in (folder, file))
    assert many == one and sum(r.n for r in many) == 12
    assert sum(r.n for r in many if r.dead) == 4


def test_a_batch_of_one_file_is_dealt_to_all_tasks(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(4000).selectExpr("if(id % 2 = 0, null, id) AS id").coalesce(1).write.parquet(source)
    stream = spread(spark.readStream.schema("id long").parquet(source))
    write_stream(stream.withColumn("task", F.spark_partition_id()), out, str(tmp_path / "state")).awaitTermination()
    tasks = spark.read.parquet(out).groupBy("task").count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism
    assert sum(t["count"] for t in tasks) == 4000 and max(t["count"] for t in tasks) < 1000
