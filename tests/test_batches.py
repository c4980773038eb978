"""Batches by length, lookups of hot keys, movement of probabilities."""

import random

import pytest
from pyspark.sql import functions as F

from askframe.operators import reports, sequence
from askframe.sources import tables

BUDGET, STEP = 100, 8


def plain_batches(rows):
    """Class by class, one row after the other."""
    out, batch = {}, -1
    fill, last = 0, None
    for n, key in sorted(rows):
        cls = (max(n, 1) - 1) // STEP
        if cls != last or fill == max(1, BUDGET // ((cls + 1) * STEP)):
            batch, fill, last = batch + 1, 0, cls
        out[key] = batch
        fill += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 700])
def test_batches_equal_plain_version(spark, tmp_path, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([0, 1, 8, 9, 16, 17, 17, 17, 17, 300]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "n long, id long").withColumn("k", F.lit(2)).repartition(5)
    done = sequence.length_batches(df, "n", ["id"], BUDGET, str(tmp_path / "b"), STEP)
    assert done.columns == ["n", "id", "k", "batch_id"]
    found = {r.id: r.batch_id for r in done.collect()}
    assert found == plain_batches(rows)
    report = sequence.batch_report(done, "n", "k").collect()
    assert sorted(r.batch_id for r in report) == list(range(len(report)))
    assert sum(r.n_rows for r in report) == n
    assert all(r.padded_ids <= BUDGET or r.n_rows == 1 for r in report)


def test_no_window_over_rows(spark, tmp_path):
    df = spark.range(500).select(F.lit(5).alias("n"), F.col("id"))
    done = sequence.length_batches(df, "n", ["id"], BUDGET, str(tmp_path / "b"), STEP)
    text = done._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_place" not in w and " id#" not in w for w in windows)


def test_salts_follow_the_counts(spark):
    rows = spark.range(6000).select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 AND id < 3000 THEN 'warm' "
                     "ELSE concat('k', id) END").alias("k"))
    found = {r.hot: r.salts for r in tables.hot_keys(rows, F.col("k")).collect()}
    key = {r.h: r.k for r in rows.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    salts = {key[h]: n for h, n in found.items()}
    assert set(salts) == {"hot", "warm"}
    assert 21 <= salts["hot"] <= 24 and 10 <= salts["warm"] <= 13
    assert tables.hot_keys(rows.limit(0), F.col("k")).collect() == []


def test_hot_spec_is_spread_and_rows_stay(spark):
    """A third of the rows have one spec and a third none; only the key and the row id are hashed."""
    rows = spark.range(9000).select(
        "id", F.expr("CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN concat('s', id % 100) END").alias("spec"),
        F.expr("repeat('long text ', 20)").alias("text"))
    table = rows.select("spec").distinct().where("spec IS NOT NULL").withColumn("n", F.length("spec"))
    joined = tables.lookup_join(rows, table, "spec", row_id="id")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_top_k" in plan and "xxhash64(text" not in plan
    got = {r.id: r.n for r in joined.collect()}
    assert len(got) == joined.count() == 9000
    assert got == {i: (3 if i % 3 == 0 else len(f"s{i % 100}") if i % 3 == 1 else None) for i in range(9000)}
    parts = (
        rows.withColumn("hot", F.xxhash64("spec")).join(tables.hot_keys(rows, F.col("spec")), "hot", "left")
        .groupBy("spec", F.expr("pmod(xxhash64(id), salts)").alias("salt")).count().collect())
    assert max(r["count"] for r in parts if r.spec in (None, "hot")) < 9000 / 40


def test_inner_join_and_two_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", None)],
                                 "salt int, spec string, model string")
    table = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "spec string, model string, hot int")
    keys = ["spec", "model"]
    for how, want in (("inner", {1: 1, 2: 2}), ("left", {1: 1, 2: 2, 3: None, 4: None})):
        done = tables.lookup_join(rows, table, keys, how, hot_by="spec")
        assert {r.salt: r.hot for r in done.collect()} == want


def test_probability_movement(spark):
    left = spark.createDataFrame(
        [(1, "choice", [0.5, 0.3, 0.2]), (2, "choice", [0.9, 0.1]), (3, "noul", [0.4, 0.6]), (4, "score", [1.0])],
        "id long, qtype string, p array<float>")
    right = spark.createDataFrame(
        [(1, "choice", [0.2, 0.6, 0.2]), (2, "choice", [0.8, 0.2]), (3, "noul", [0.4, 0.6]), (9, "noul", [0.0])],
        "id long, qtype string, p array<float>")
    got = {r.qtype: r for r in reports.probability_movement(left, right, ["id"]).collect()}
    assert set(got) == {"choice", "noul"}
    choice = got["choice"]
    assert (choice.n, choice.id, choice.n_flips) == (2, 1, 1)
    assert choice.max_movement == pytest.approx(0.3, abs=1e-6)
    assert choice.mean_movement == pytest.approx(0.2, abs=1e-6)
    assert got["noul"].max_movement == 0 and got["noul"].n_flips == 0
