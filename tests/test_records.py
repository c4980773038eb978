"""Recorded cases, results on disk, compact JSON, extras of emails, percentiles."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import pyjson
from askframe.functions.email import email_context, email_text
from askframe.operators import sequence
from askframe.sources import golden, raw_json, sinks

ANSWER = ("array<struct<qid:string,qtype:string,choice:string,score:double,noul:double,legend:array<string>,"
          "prob_keys:array<string>,probabilities:array<double>,confidence:double,act_probability:double>>")
CASES = (f"model string, case string, state string, questions string, sequences "
         f"array<struct<qid:string,ids:array<int>,markers:array<int>>>, answers {ANSWER}, input_tokens int")


def cases(spark, score=0.4, tokens=7, ids=(1, 5, 2)):
    answers = [
        ("dep", "choice", 'x"', None, None, None, ['x"', "y"], [0.9, 0.1], 0.5, 1.0),
        ("urg", "score", None, score, None, ['"lo"', '{"a": [1, 2.5]}', '"hi"'], ["0", "1", "2"],
         [0.6, 0.3, 0.1], 0.1, 0.2),
        ("risk", "noul", None, None, 0.8, None, None, None, 0.8, 1.0)]
    sequences = [("dep", list(ids), [1]), ("urg", [4], []), ("risk", [], [])]
    return spark.createDataFrame(
        [("english", f"c{i}", '{"b": [1.50, "é"]}', '{"dep": {}}', sequences, answers, tokens)
         for i in range(3)], CASES)


def test_recorded_cases_come_back(spark, tmp_path):
    path = str(tmp_path / "golden")
    golden.write_golden(cases(spark), path)
    back = golden.read_golden(spark, path, lines=True)
    assert back.count() == 3 and json.loads(back.first().state) == {"b": [1.5, "é"]}
    same = golden.golden_parity(cases(spark), back).collect()
    # type, value, confidence, act; shares; levels; sequences; usage
    assert len(same) == 3 * (3 * 4 + 5 + 3 + 3 + 1) and {r.verdict for r in same} == {"ok"}
    run = golden.golden_parity(cases(spark, 0.5, 8, (1, 5, 3)), back)
    bad = {(r.field, r.verdict) for r in run.where("verdict <> 'ok'").collect()}
    assert bad == {("answers.urg.score", "differs"), ("usage.input_tokens", "differs"),
                   ("sequences.dep", "differs")}
    fewer = cases(spark).where("case <> 'c1'").withColumn("answers", F.slice("answers", 2, 2)).withColumn(
        "sequences", F.slice("sequences", 2, 2))
    lost = golden.golden_parity(fewer, back).where("verdict = 'missing'").collect()
    assert {r.field for r in lost if r.case == "c0"} == {
        "answers.dep." + f for f in ("type", "choice", "confidence", "act_probability", 'probabilities.x"',
                                     "probabilities.y")} | {"sequences.dep"}
    assert sum(r.case == "c1" for r in lost) == 24


def test_results_are_replaced_by_batch(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.range(4000).select(
        "id", F.expr("CASE WHEN id % 10 < 8 THEN 'a' ELSE concat('m', id % 10) END").alias("model")).repartition(16)
    first = {r.model: r for r in sinks.write_results(rows, path, "1").collect()}
    assert {m: r.rows for m, r in first.items()} == {"a": 3200, "m8": 400, "m9": 400}
    assert all(r.files <= 2 for r in first.values())
    sinks.write_results(rows.where("model <> 'm9'"), path, "2")
    again = sinks.write_results(rows.where("model = 'a'"), path, "1").collect()
    assert [(r.model, r.rows) for r in again] == [("a", 3200)]
    left = spark.read.parquet(path).groupBy("batch", "model").count().collect()
    assert {(r.batch, r.model): r["count"] for r in left} == {(1, "a"): 3200, (2, "a"): 3200, (2, "m8"): 400}
    assert sinks.write_results(rows.limit(0), path, "3").collect() == []


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.floats(allow_nan=False, allow_infinity=False),
                 st.text(st.characters(exclude_categories=["Cs"]), max_size=6), st.sampled_from("<>&  "))
JSON = st.recursive(LEAF, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(
    st.characters(exclude_categories=["Cs"]), max_size=3), x, max_size=3)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, st.sampled_from([None, 2]))
def test_compact_text_is_the_same_value(value, indent):
    text = raw_json._compact(json.dumps(value, indent=indent, ensure_ascii=indent is None))
    assert json.loads(text) == value
    plain = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&  ":
        plain = plain.replace(c, f"\\u{ord(c):04x}")
    assert text == plain


def test_compact_keeps_numbers_and_order(spark):
    deep = "[" * 5000 + "]" * 5000
    rows = ['{"b": 1.50, "a": -0, "b": 1E5}', " [ ] ", "1.0e+1", None, "", "{", deep, '{"a": [{}, [], {"x": [1]}]}']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(raw_json.compact_json("t")).collect()]
    assert got == ['{"b":1E5,"a":-0}', "[]", "1.0e+1", None, None, None, deep, '{"a":[{},[],{"x":[1]}]}']


def test_extras_of_any_kind(spark):
    df = spark.createDataFrame([(1, 2.5, [("t", None)], {"k": "v"}, "plain"), (None,) * 5],
                               "i int, x double, l array<struct<s:string,n:int>>, m map<string,string>, e string")
    extra = {c: (c, df.schema[c].dataType) for c in ("i", "x", "l", "m")} | {"e": "e"}
    fields = email_context(F.lit("sub"), F.lit("body"), None, extra)
    rows = df.select(pyjson.object_text(fields), email_text(fields)).collect()
    assert rows[0][0] == ('{"subject": "sub", "body": "body", "i": 1, "x": 2.5, "l": [{"s": "t", "n": null}], '
                          '"m": {"k": "v"}, "e": "plain"}')
    assert rows[0][1] == "sub body t v plain"
    assert tuple(rows[1]) == ('{"subject": "sub", "body": "body"}', "sub body")


@pytest.mark.parametrize("n", [1, 50, 40_000])
def test_percentiles_from_merged_sketches(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice("ab"), rnd.choice("xy"), rnd.randrange(10_000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, h string, dropped long").repartition(7)
    sketches = sequence.truncation_sketches(df, "g", "h")
    assert sketches.count() <= 4
    for r in sequence.truncation_percentiles(sketches, ["g", "h"], (0.5, 0.99)).collect():
        own = sorted(d for g, h, d in rows if r.g in (None, g) and r.h in (None, h))
        assert r.n == len(own)
        for share, got in ((0.5, r.p50), (0.99, r.p99)):
            exact = own[-(-len(own) * int(share * 100) // 100) - 1]
            assert got == exact or (n > 4096 and abs(got - exact) <= 10_000 * 0.01)
