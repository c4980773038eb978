import numpy as np
import pytest
from pyspark.sql import functions as F

from askframe.llm import curves


def table(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v])
            for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute(vectors, ids, k):
    x = np.asarray(vectors, np.float32).astype(float)
    out = {}
    for i, own in enumerate(ids):
        if own % 100 == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != own][:k]
            out[own] = [(ids[j], d[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def search(df, k=10, **given):
    return curves.search(df, F.col("vec_id") % 100 == 0, k, curves.Curves(**given))


@pytest.mark.parametrize("rows", [1, 2, 7, 200])
def test_small_tables_are_exact(spark, rows):
    x = np.random.default_rng(1).normal(size=(rows, 6)).astype(np.float32)
    got, want = found(search(table(spark, x))), brute(x, np.arange(rows), 10)
    assert {q: [v for v, _ in g] for q, g in got.items()} == {
        q: [v for v, _ in w] for q, w in want.items() if w}
    for q, g in got.items():
        assert np.allclose([s for _, s in g], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("cut", [20_000, 40])
def test_recall_on_the_hardest_vectors(spark, cut):
    x = np.random.default_rng(2).normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)  # no structure at all
    got = found(search(table(spark, x), blocks=64, rows_per_task=cut))
    want = brute(x, np.arange(len(x)), 10)
    hits = [len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want]
    assert np.mean(hits) >= 9.0


def test_ties_copies_and_useless_vectors(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 0.0], [np.nan, 1.0], [np.inf, 0.0], [None, 1.0], None, [], [1.0, 2.0, 3.0]]
    ids = list(range(30)) + [100, 200, 300, 400, 500, 600, 700]
    got = found(search(table(spark, x, ids)))
    assert got == {0: [(i, 0.0) for i in range(1, 11)]}
    repeated = table(spark, [[1.0, 0.0], [1.0, 0.0], [0.5, 0.0], [0.9, 0.0]], [0, 0, 1, 1])
    assert [(v, round(s, 6)) for v, s in found(search(repeated))[0]] == [(1, 0.1)]
    assert search(table(spark, [])).collect() == []
    extra = table(spark, [[1.0], [2.0]]).withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    assert found(search(extra)) == {0: [(1, 1.0)]}


@pytest.mark.parametrize("noise", [0.0, 0.001, 0.01])
def test_recall_inside_a_tight_group(spark, noise):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(18_000, 16))
    group = np.arange(0, len(x), 3)
    x[group] = x[0] + noise * draw.normal(size=(len(group), 16))
    x = x.astype(np.float32)
    got, want = found(search(table(spark, x))), brute(x, np.arange(len(x)), 10)
    inside = [q for q in want if q % 3 == 0]
    hits = [len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in inside]
    assert len(inside) == 60 and np.mean(hits) >= 9.95
    if not noise:
        assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in inside)


def test_each_length_is_searched_on_its_own(spark):
    draw = np.random.default_rng(5)
    mixed = [draw.normal(size=d).astype(np.float32) for d in [8] * 1500 + [5] * 900 + [3] * 30 + [2]]
    ids = draw.permutation(len(mixed))
    got = found(search(table(spark, mixed, ids)))
    hits, all_of = [], 0
    for d in (8, 5, 3, 2):
        here = [i for i, v in enumerate(mixed) if len(v) == d]
        for q, w in brute([mixed[i] for i in here], [int(ids[i]) for i in here], 10).items():
            if not w:
                assert q not in got
                continue
            hits.append(len({v for v, _ in w} & {v for v, _ in got[q]}) / len(w))
            all_of += 1
            if d == 3:  # too few for an index: exact
                assert [v for v, _ in got[q]] == [v for v, _ in w]
    assert all_of == len(got) and np.mean(hits) >= 0.9


@pytest.mark.parametrize("cut", [30, 20_000])
def test_smallest_ids_in_steps(spark, cut):
    rows = table(spark, [[1.0]] * 100 + [[2.0]] * 3, list(range(100, 0, -1)) + [7, 8, 9])
    got = {tuple(r.v): r.ids for r in curves._smallest_ids(rows.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 2, cut).collect()}
    assert got == {(1.0,): [1, 2], (2.0,): [7, 8]}
