import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.llm import queries, shards
from askframe.llm.hilbert import hilbert_index


@pytest.mark.parametrize("n, bits", [(1, 5), (2, 4), (3, 3), (4, 2), (6, 1)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = hilbert_index(list(grid.T), bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def cut(df, shards_, **dims):
    return shards.hilbert_shards(
        df, dims or {"a": F.col("a"), "b": F.col("b")}, ties=["id"], shards=shards_, bits=4)


@pytest.mark.parametrize("rows", [0, 1, 5, 16, 333])
def test_runs_along_the_curve(spark, rows):
    df = spark.createDataFrame([(i, i * 7 % 16, i * 3 % 16) for i in range(rows)], "id long, a int, b int")
    got = cut(df.repartition(5), 16).orderBy("shard", "slot").collect()
    assert len(got) == rows
    sizes = {s: sum(r.shard == s for r in got) for s in range(16)}
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert [r.slot for r in got if r.shard == s] == list(range(sizes[s]))
    assert [r.curve for r in got] == sorted(r.curve for r in got)
    want = hilbert_index([np.array([r.a for r in got]), np.array([r.b for r in got])], 4)
    assert [r.curve for r in got] == list(want)


def test_odd_rows_hot_values_and_clashing_names(spark):
    rows = [(1, None, 99)] * 40 + [(i, -3, 5) for i in range(10)] + [(None, 2, None)]
    df = spark.createDataFrame(rows, "id long, a int, b int").withColumn("rank", F.lit("x")).withColumn(
        "place", F.lit("y"))
    got = cut(df, 4).collect()
    assert len(got) == 51 and {r["rank"] for r in got} == {"x"} and {r["place"] for r in got} == {"y"}
    assert sorted(sum(r.shard == s for r in got) for s in range(4)) == [12, 13, 13, 13]
    with pytest.raises(ValueError, match="slot"):
        cut(df.withColumn("Slot", F.lit(1)), 4)


def test_files_span_small_boxes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 16, i // 16) for i in range(256)], "id long, a int, b int")
    shards.write_shards(cut(df, 16), str(tmp_path / "out"))
    boxes = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(
        (F.max("a") - F.min("a") + 1).alias("w"), (F.max("b") - F.min("b") + 1).alias("h")).collect()
    assert len(boxes) == 16 and all(r.w * r.h == 16 for r in boxes)


def test_query(spark, documents, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_hilbert_sharding(spark, str(tmp_path)).collect()
    texts = odd.collect()
    assert sorted(r.size for r in got) == sorted(len((r.text or "").encode()) + 1 for r in texts)
    assert {r.law for r in got} == {"rows"} and {r.slot for r in got} == {0}
