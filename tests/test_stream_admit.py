import json

from pyspark.sql import functions as F

from askframe.plans import doubles
from askframe.plans.predict import admit, intern_specs
from askframe.sources.requests import parse_requests
from askframe.streaming.admit import admit_batch, admit_stream, read_batches, read_specs
from askframe.streaming.requests import read_stream_results

COLUMNS = ["request_id", "spec_id", "context_text", "model", "window", "workflow", "error", "error_class"]


def body(n, context, **more):
    spec = {"q": {"type": "noul", "instructions": f"question {n}?"}}
    return json.dumps({"context": context, "spec": spec, **more}, ensure_ascii=False)


def add(source, n, bodies, start):
    rows = [json.dumps({"request_id": start + i, "body": b}) for i, b in enumerate(bodies)]
    (source / f"part{n}.json").write_text("\n".join(rows), encoding="utf8")


FIRST = [body(i % 3, "hello my dear friend") for i in range(40)] + [
    "{broken", body(1, "привет"), body(1, "x", max_len=100), '{"context": "no spec"}']
SECOND = [body(2, "again"), body(7, "a new question"), body(7, "and once more", model="nope"), "[]"]


def as_rows(df):
    return sorted(df.select(COLUMNS).collect(), key=str)


def test_stream_equals_batch_and_each_spec_comes_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    catalog = doubles.catalog(spark)

    def run():
        stream = spark.readStream.schema("request_id long, body string").json(str(source))
        admit_stream(parse_requests(stream), target, str(tmp_path / "state"), catalog).awaitTermination()

    add(source, 1, FIRST, 0)
    run()
    add(source, 2, SECOND, 100)
    run()
    run()  # nothing new
    rows, own = intern_specs(parse_requests(
        spark.read.schema("request_id long, body string").json(str(source))))
    want = as_rows(admit(rows, own, catalog))
    ok, dead = read_stream_results(spark, f"{target}/rows")
    assert as_rows(ok.unionByName(dead)) == want and len(want) == 48
    assert ok.where("error is not null").count() == 0 and dead.where("error is null").count() == 0

    specs = read_specs(spark, target)
    asked = specs.select("spec_id", F.col("questions")[0]["instructions"].alias("text"), "batch_id").collect()
    assert sorted((r.text, r.batch_id) for r in asked) == [
        ("question 0?", 0), ("question 1?", 0), ("question 2?", 0), ("question 7?", 1)]
    assert {r.spec_id for r in asked} == {r.spec_id for r in own.collect()}
    counts = sorted((r.batch_id, r.rows, r.dead, r.new_specs) for r in read_batches(spark, target).collect())
    assert [c[0] for c in counts] == [0, 1] and [c[1] for c in counts] == [44, 4]
    assert [c[3] for c in counts] == [3, 1] and sum(c[2] for c in counts) == dead.count()


def test_a_batch_run_again_ends_in_the_same_state(spark, tmp_path):
    target, catalog = str(tmp_path / "out"), doubles.catalog(spark)
    spark.createDataFrame([], "spec_id string").write.parquet(f"{target}/specs/batch_id=-1")
    parsed = [
        parse_requests(spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string"))
        for bodies in (FIRST, SECOND, [])]

    def state():
        return (
            sorted(read_specs(spark, target).collect(), key=str),
            sorted(read_batches(spark, target).collect(), key=str),
            as_rows(spark.read.parquet(f"{target}/rows")))

    for n, batch in enumerate(parsed):
        admit_batch(batch, n, target, catalog)
    once = state()
    for n in (1, 1, 0, 2):
        admit_batch(parsed[n], n, target, catalog)
    assert state() == once
    assert [(r.rows, r.new_specs) for r in read_batches(spark, target).orderBy("batch_id").collect()] == [
        (44, 3), (4, 1), (0, 0)]


def test_specs_are_written_and_hashed_once_per_request(spark, tmp_path, monkeypatch):
    target, kept = str(tmp_path / "out"), []
    batch = parse_requests(spark.createDataFrame(list(enumerate(SECOND)), "request_id long, body string"))
    persist = type(batch).persist
    monkeypatch.setattr(type(batch), "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    spark.createDataFrame([], "spec_id string").write.parquet(f"{target}/specs/batch_id=-1")
    admit_batch(batch, 0, target, doubles.catalog(spark))
    assert len(kept) == 1 and dict(kept[0].dtypes)["questions"] == "string"  # not written again by each pass
    rows, own = intern_specs(batch)
    ids = {r.request_id: r.spec_id for r in kept[0].collect()}
    assert ids == {r.request_id: r.spec_id for r in rows.collect()}
    found = {r.spec_id: r.n for r in own.collect()}
    assert sorted(found.values()) == [1, 2] and found.keys() < set(ids.values())
    assert {r.spec_id for r in read_specs(spark, target).collect()} == found.keys()
