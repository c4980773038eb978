import json

from pyspark.sql import functions as F

from askframe.operators import specs
from askframe.operators.route import route
from askframe.sources.requests import failure_class, parse_requests, split_valid

NOUL = {"q": {"type": "noul", "instructions": "?"}}


def parse(spark, bodies, **options):
    rows = [(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    return parse_requests(spark.createDataFrame(rows, "id int, body string"), **options)


def test_faulty_requests(spark):
    cases = [
        ({"questions": NOUL, "model": "en"}, 'missing "context"'),
        ({"state": {"ticket": 17, "lines": ["a", "b"]}}, 'missing "spec"'),
        ({"state": [1], "questions": {"mood": {"type": "score", "instructions": "rate it", "criteria": []}}},
         'question "mood": score questions need at least two rubric levels'),
        ({"state": "s", "priority": "high", "questions": NOUL}, 'unknown field "priority"'),
        ({"state": "s", "questions": NOUL, "max_len": [512]}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "max_len": 8193}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "max_len": 511.0}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "max_len": 2**31}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "max_len": 2**63}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "max_len": -1}, "between 1 and 8192"),
        ({"state": "s", "questions": NOUL, "a\nb\x01\"": 0}, r'unknown field "a\nb\x01\""'),
        ('{"context": "x", "spec": {}, "max_len": 1e3}', "max_len"),
        ('{"context": "x", "max_len": 99999999999999999999}', "max_len"),
        ({"context": "x", "lang": ["de"], "bogus": 1}, '"lang" must be a string'),
        ({"bogus": 1, "lang": ["de"]}, "unknown field"),
        ("[]", "JSON object"), ("", "empty request body"), (None, "empty request body"),
        ("{", "invalid JSON"), ('{"context": 1} 2', "trailing data"),
        ({"context": "x", "spec": []}, "got array"),
        ({"context": "x", "spec": {"a": NOUL["q"], "b": 1, "c": {}}}, '"b": definition must be an object'),
    ]
    got = parse(spark, [c for c, _ in cases]).orderBy("id").collect()
    for r, (body, part) in zip(got, cases):
        assert part in r["error"], (body, r["error"])
        assert r["error_class"] == "bad_request"


def test_valid_requests(spark):
    bodies = [
        {"context": "x", "spec": NOUL, "max_len": 0, "model": "ml", "task": None},
        '{"state": 1, "context": {"a": "p", "b": ["q", 1]}, "questions": 3, "spec": '
        + json.dumps(NOUL) + ', "max_len": 4096}',
        '{"context": "x", "spec": {"q": 1}, "spec": ' + json.dumps(NOUL) + "}",
    ]
    df = parse(spark, bodies)
    good, bad = split_valid(df)
    assert bad.count() == 0
    got = good.orderBy("id").collect()
    assert (got[0]["max_len"], got[0]["model"], got[0]["task"]) == (0, "ml", None)
    assert got[1]["state_text"] == '{"a": "p", "b": ["q", 1]}'
    assert got[1]["context_text"] == "p q"
    assert got[1]["max_len"] == 4096
    assert [q["qid"] for q in got[2]["questions"]] == ["q"]


def test_route_endpoint_needs_no_spec(spark):
    df = parse(spark, [{"context": {"body": "二重に請求されました"}},
                       {"context": "hello there my friend", "lang": "fr"},
                       {"context": "x", "model": "nope"}, {"context": "x", "spec": {}}], endpoint="route")
    got = route(df, "context_text", "model", "task", "lang").orderBy("id").collect()
    assert [r["route"]["model"] for r in got[:3]] == ["multilingual", "multilingual", None]
    assert "unknown model" in got[2]["route"]["error"]
    assert got[3]["error"] == "spec has no questions"


def test_preset_endpoint(spark):
    rows = [("triage", '{"context": {"message": "hi"}, "spec": {}}'), ("nope", '{"context": "x"}'),
            ("guard", '{"context": "x"}'), ("nope", '{"x": 1}'),
            ("email", '{"context": "x", "categories": {"a": "x", "b": ""}}')]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, p string, body string")
    got = parse_requests(df, endpoint="preset", preset="p", presets=specs.presets(spark)).orderBy("id").collect()
    assert "own spec" in got[0]["error"] and got[0]["error_class"] == "bad_request"
    assert got[1]["error_class"] == "not_found"
    assert got[2]["error"] is None and len(got[2]["questions"]) == 5
    assert got[3]["error_class"] == "bad_request"
    assert got[4]["questions"][0]["keys"] == ["a", "b"]


def test_failure_classes(spark):
    messages = {"unknown model \"x\"": "bad_request", "load english: gone": "unavailable",
                "max_len must be positive, got -1": "bad_request", "boom": "internal",
                'question "q" options exceed head_max_len=1': "bad_request"}
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    for r in df.select("m", failure_class(F.col("m")).alias("c")).collect():
        assert r["c"] == messages[r["m"]]


def test_one_request_stays_one_row(spark):
    """A document with many nodes is an array in its row, so nothing is exploded or shuffled."""
    body = json.dumps({"context": ["w"] * 5000, "spec": {f"q{i}": NOUL["q"] for i in range(300)}})
    df = parse(spark, [body])
    assert len(df.first()["questions"]) == 300
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
