import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.operators.isolate import map_isolated, run_isolated


def halves(values):
    if any(v == 13 for v in values):
        raise RuntimeError("thirteen")
    return [v / 2 for v in values]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 13]), max_size=40))
def test_only_faulty_values_fail(values):
    results, errors = run_isolated(values, halves)
    assert results == [None if v == 13 else v / 2 for v in values]
    assert errors == ["RuntimeError: thirteen" if v == 13 else None for v in values]


def test_few_calls_for_few_faults():
    calls = []

    def counted(values):
        calls.append(len(values))
        return halves(values)

    run_isolated([1] * 500 + [13] + [2] * 523, counted)
    assert len(calls) <= 2 * 10 + 1
    assert run_isolated([1, 2], lambda v: v[:1])[1] == [None, None]
    assert run_isolated([1], lambda v: [])[1] == ["ValueError: 0 results for 1 rows"]


@pytest.mark.parametrize("earlier", [False, True])
def test_rows_keep_their_errors(spark, earlier):
    df = spark.range(200).select(F.when(F.col("id") % 50 == 7, 13).otherwise(2).alias("v"), F.col("id").alias("job"))
    if earlier:
        df = df.withColumns({"error": F.expr("if(job % 100 = 7, 'came', null)"),
                             "error_class": F.expr("if(job % 100 = 7, 'bad_request', null)")})
    def make(values):  # not of this module, which the workers do not have
        if any(v == 13 for v in values):
            raise RuntimeError("thirteen")
        return [v / 2 for v in values]

    rows = map_isolated(df, "v", make, "half", T.DoubleType()).collect()
    assert len(rows) == 200 and {r.half for r in rows if r.v == 2} == {1.0}
    bad = {r.job: (r.half, r.error, r.error_class) for r in rows if r.error}
    mine = (None, "RuntimeError: thirteen", "internal")
    came = (None, "came", "bad_request") if earlier else mine
    assert bad == {7: came, 57: mine, 107: came, 157: mine}
    assert map_isolated(df.limit(0), "v", make, "half", T.DoubleType()).collect() == []
