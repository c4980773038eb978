import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askframe.functions import calibrate
from askframe.sources import sinks

SLOW = settings(
    max_examples=4, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
FLOAT = st.floats(-40, 40, width=32)


def probabilities(z, t):
    scaled = np.asarray(z, np.float32) / np.float32(max(1e-3, t))
    e = np.exp((scaled - scaled.max()).astype(np.float64)).astype(np.float32)
    total = np.float32(0)
    for v in e:
        total = np.float32(total + v)
    return e / total


def confidence(p):
    if len(p) < 2:
        return 1.0
    h = np.float32(0)
    for v in p:
        c = min(max(v, np.float32(1e-12)), np.float32(1))
        h = np.float32(h - v * np.float32(math.log(c)))
    return float(min(max(np.float32(1) - h / np.float32(math.log(len(p))), 0), 1))


@SLOW
@given(st.lists(st.tuples(st.lists(FLOAT, min_size=1, max_size=14), st.floats(0, 3)),
                min_size=80, max_size=80))
def test_softmax_and_confidence(spark, rows):
    df = spark.createDataFrame(rows, "z array<float>, t double")
    df = df.withColumn("p", calibrate.scaled_softmax("z", F.col("t")))
    df = df.withColumn("c", calibrate.entropy_confidence(F.col("p")).cast("double"))
    df = df.withColumn("s", calibrate.expected_level(F.col("p")))
    for r in df.collect():
        want = probabilities(r["z"], r["t"])
        assert np.array_equal(np.asarray(r["p"], np.float32), want), r["z"]
        assert abs(r["c"] - confidence(want)) <= 1e-6
        assert abs(r["s"] - float((np.arange(len(want)) * want.astype(np.float64)).sum())) <= 1e-12


def test_published_answers(spark):
    rows = [([0.9628, 0.0147, 0.0112, 0.0113], 0.856, None), ([0.1164, 0.3271, 0.5565], 0.1425, 1.44)]
    df = spark.createDataFrame(rows, "p array<float>, c double, s double")
    df = df.withColumn("got", calibrate.entropy_confidence(F.col("p")).cast("double"))
    df = df.withColumn("score", calibrate.expected_level(F.col("p")))
    for r in df.collect():
        assert abs(r["got"] - r["c"]) < 1e-3
        assert r["s"] is None or abs(r["score"] - r["s"]) < 1e-3
    noul = spark.createDataFrame([([1 - 0.112, 0.112],)], "p array<float>")
    assert noul.select(calibrate.noul_confidence(F.col("p"))).first()[0] == 0.888


def test_temperatures(spark):
    df = spark.sql("""SELECT * FROM VALUES ('choice', 1), ('choice', 2), ('score', 5), ('score', 6),
        ('choice', 10), ('choice', 11), ('noul', 2) AS t(qtype, k)""")
    df = df.withColumn("by_type", F.array(F.lit(1.5), F.lit(2.5), F.lit(3.5)))
    df = df.withColumn("by_options", F.expr("map('choice:2', 0.5D, 'score:3-5', 0.25D, 'choice:11+', 9D)"))
    t = calibrate.temperature_for("qtype", "k", "by_type", "by_options")
    got = {(r["qtype"], r["k"]): (r["b"], r["t"]) for r in df.withColumn("t", t).withColumn(
        "b", calibrate.temperature_bucket("qtype", "k")).collect()}
    assert got["choice", 1] == ("choice:2", 0.5)
    assert got["choice", 2] == ("choice:2", 0.5)
    assert got["score", 5] == ("score:3-5", 0.25)
    assert got["score", 6] == ("score:6-10", 2.5)
    assert got["choice", 10] == ("choice:6-10", 1.5)
    assert got["choice", 11] == ("choice:11+", 9.0)
    assert got["noul", 2] == ("noul:2", 3.5)


def test_answers_of_a_request(spark):
    df = spark.sql("""SELECT array(
        named_struct('qid', 'a', 'qtype', 'choice', 'keys', array('x', 'y', 'z'), 'legend', array()),
        named_struct('qid', 'b', 'qtype', 'score', 'keys', array(), 'legend', array('"lo"', '"hi"')),
        named_struct('qid', 'c', 'qtype', 'noul', 'keys', array(), 'legend', array()),
        named_struct('qid', 'd', 'qtype', 'choice', 'keys', array('only'), 'legend', array())) AS questions,
      array(array(1f, 3f, 3f), array(0f, 0f), array(2f, 2f), array(5f)) AS z,
      array(array(9f, -9f), array(0f, 0f), array(-9f, 9f), array(1f, 1f)) AS a""")
    df = df.withColumn("answers", calibrate.answers("questions", "z", "a", F.expr("array(1D, 1D, 1D, 1D)")))
    got = df.select(F.explode("answers").alias("r")).select("r.*").collect()
    assert [r["qid"] for r in got] == ["a", "b", "c", "d"]
    assert got[0]["choice"] == "y"                       # the first of equal maxima
    assert got[1]["score"] == 0.5 and got[1]["prob_keys"] == ["0", "1"]
    assert got[2]["noul"] == 0.5 and got[2]["probabilities"] is None
    assert got[3]["choice"] == "only" and got[3]["confidence"] == 1.0
    assert [r["act_probability"] for r in got] == [1.0, 0.5, 0.0, 0.5]
    text = df.select(sinks.answers_json("answers").alias("j")).first()["j"]
    assert text.startswith('{"a": {"type": "choice", "choice": "y", "probabilities": {"x": 0.0634, "y": 0.4683')
    assert '"legend": {"0": "lo", "1": "hi"}' in text
    assert text.endswith('"d": {"type": "choice", "choice": "only", "probabilities": {"only": 1.0}, '
                         '"confidence": 1.0, "action": {"act_probability": 0.5}}}')


def test_number_texts(spark):
    df = spark.createDataFrame([(1.0,), (0.856,), (0.0,), (0.0001,), (12.5,), (0.1,)], "x double")
    got = [r[0] for r in df.select(sinks.round4_text(F.col("x"))).collect()]
    assert got == ["1.0", "0.856", "0.0", "0.0001", "12.5", "0.1"]


def test_uncertainty_of_one_option(spark):
    df = spark.createDataFrame([([3.0],), ([1.0, 1.0],)], "z array<float>")
    one, two = [r[0] for r in df.select(calibrate.uncertainty("z")).collect()]
    assert one["top1"] == 1.0 and one["margin"] == 1.0
    assert two["margin"] == 0.0 and abs(two["entropy"] - 1) < 1e-6
