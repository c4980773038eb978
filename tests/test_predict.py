import json

import pytest
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.operators import reports, specs
from askframe.operators.route import RouterOptions
from askframe.operators.score import OnnxFiles, TokenizerFiles
from askframe.plans import doubles
from askframe.plans.predict import decisions, intern_specs, predict
from askframe.sources import catalog, golden, sinks
from askframe.sources.requests import parse_requests

CONFIG = {
    "english": {"repo": "hub/en", "encoder": "large", "max_len": 512, "head_max_len": 192,
                "temperature": [1.0, 2.0, 3.0], "temperature_by_options": {"choice:2": 0.5},
                "act_costs": {"act": 0.1},
                "special_tokens": {"cls_id": 1, "sep_id": 2, "mask_id": 3, "pad_id": 0, "mask": "[MASK]"},
                "onnx": {"file": "model.onnx", "opset": 18}},
    "multilingual": {"max_len": 0, "temperature": [1.0], "special_tokens": {"cls_id": 1, "sep_id": 2,
                     "mask_id": 3, "pad_id": 0}},
    "unrelated": {"max_len": 7},
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """A checkpoint folder as an export writes it, with stand-in tokenizer and graph."""
    folder = tmp_path_factory.mktemp("models")
    for name, config in CONFIG.items():
        (folder / name).mkdir()
        (folder / name / "family_config.json").write_text(json.dumps(config, indent=2))
        (folder / name / "model.onnx").write_bytes(doubles.graph_bytes())
        from tokenizers import Tokenizer
        from tokenizers.models import WordLevel
        from tokenizers.pre_tokenizers import WhitespaceSplit

        t = Tokenizer(WordLevel({"[UNK]": 9, "refund": 10, "question:": 11}, unk_token="[UNK]"))
        t.pre_tokenizer = WhitespaceSplit()
        t.enable_truncation(4)
        t.save(str(folder / name / "tokenizer.json"))
    return str(folder)


def test_catalog(spark, root):
    df = catalog.read_catalog(spark, root)
    got = {r["model"]: r for r in df.collect()}
    assert set(got) == {"english", "multilingual"}
    m = got["multilingual"]
    assert (m["max_len"], m["head_max_len"], m["temperature"]) == (512, 192, [1.0, 1.0, 1.0])
    assert (m["mask"], m["graph_file"]) == ("[MASK]", "model.onnx")
    assert (m["graph_inputs"], m["graph_outputs"]) == (fixed.GRAPH_INPUTS, fixed.GRAPH_OUTPUTS)
    assert got["english"]["temperature_by_options"] == {"choice:2": 0.5}
    listing = catalog.catalog_listing(df).collect()
    assert [(r["name"], r["repo"], r["max_len"]) for r in listing] == [
        ("english", "hub/en", 512), ("multilingual", None, 512)]
    assert {r["max_len"] for r in catalog.catalog_listing(df, 4096).collect()} == {4096}


def test_windows(spark):
    rows = [(n,) for n in (None, 0, 512, 2048, 8192, -1, 100, 8193)]
    df = spark.createDataFrame(rows, "n int").withColumn("h", F.lit(256))
    got = {r["n"]: r["e"] for r in df.withColumn("e", catalog.max_len_error("n", "h")).collect()}
    assert [got[n] for n in (None, 0, 512, 2048, 8192)] == [None] * 5
    assert "positive" in got[-1] and "too small" in got[100] and "exceeds" in got[8193]
    assert "at least 272" in got[100]


def requests_of(spark, rows):
    schema = "request_id string, spec_id string, context_text string, state_text string, model string, max_len int"
    return spark.createDataFrame(rows, schema)


def test_predict_from_files(spark, root):
    rows = [
        ("a", "triage", "please refund this to me", "please refund this to me", None, None),
        ("b", "email", "二重に請求", "二重に請求 [MASK] x", None, None),
        ("c", "triage", "x", "x", "nope", None),
        ("d", "triage", "x", "x", "typed", None),
        ("e", "triage", "x", "x", "en", 100),
        ("f", "missing", "x", "x", "en", None),
        ("g", "guard", "w " * 9000, "w " * 9000, "en", 300),
    ]
    df = predict(
        requests_of(spark, rows), specs.presets(spark), catalog.read_catalog(spark, root),
        TokenizerFiles(root), OnnxFiles(root), RouterOptions(), bounded_specs=True,
    )
    got = {r["request_id"]: r for r in df.collect()}
    assert [got[x]["error_class"] for x in "abcdefg"] == [
        None, None, "bad_request", "unavailable", "bad_request", "bad_request", None]
    assert got["d"]["error"] == "load typed-decisions: no checkpoint"
    assert [a["qid"] for a in got["a"]["answers"]] == list(fixed.PRESETS["triage"])
    assert got["b"]["model"] == "multilingual" and got["c"]["answers"] is None
    # logits grow with the position of the mask, so the last label wins.
    assert got["a"]["answers"][0]["choice"] == "other"
    # 5 sequences, all cut to the window that was asked for.
    assert got["g"]["input_tokens"] == 5 * 300
    words = lambda t: len(t.split())
    heads = [words(f"{t} question: {i}") for t, i, _ in fixed.PRESETS["triage"].values()]
    assert got["a"]["input_tokens"] > sum(heads)
    long = decisions(df).filter("request_id = 'a'").orderBy("q_pos").collect()
    assert [r["q_pos"] for r in long] == [0, 1, 2, 3, 4]
    results = {r["request_id"]: r["result"] for r in sinks.result_json(df).collect()}
    assert results["c"] is None
    result = json.loads(results["a"])
    assert result["routing"]["detection"] == {
        "script": "latin", "script_profile": {"latin": 1.0}, "language": "en", "is_english": True,
        "non_latin_fraction": 0.0}
    assert result["routing"]["workflow"] is None
    assert list(result["answers"]) == list(fixed.PRESETS["triage"])
    assert result["usage"] == {"input_tokens": got["a"]["input_tokens"], "output_tokens": 0}


def test_batching_does_not_change_answers(spark, root):
    rows = [(str(i), "router", "w " * (i % 37), "w " * (i % 37), "en", None) for i in range(200)]
    run = lambda tokens: predict(
        requests_of(spark, rows), specs.presets(spark), catalog.read_catalog(spark, root),
        TokenizerFiles(root), OnnxFiles(root), max_tokens=tokens, bounded_specs=True,
    ).select("request_id", "answers", "input_tokens")
    assert sorted(run(1).collect()) == sorted(run(10**6).collect())


@pytest.mark.parametrize("store", [False, True])
def test_requests_with_their_own_specs(spark, root, tmp_path, store):
    spec = {"team": {"type": "choice", "instructions": "who?", "criteria": ["a", "b"]},
            "late": {"type": "score", "instructions": {"q": 1}, "criteria": ["no", 2]}}
    bodies = [(str(i), json.dumps({"context": {"n": i, "t": "hello my friend"}, "spec": spec})) for i in range(20)]
    df = parse_requests(spark.createDataFrame(bodies, "request_id string, body string"))
    folder = str(tmp_path / "specs") if store else None
    keyed, distinct = intern_specs(df.drop("error", "error_class"), folder)
    assert distinct.count() == 1
    out = predict(keyed, distinct, catalog.read_catalog(spark, root), TokenizerFiles(root), OnnxFiles(root))
    got = out.collect()
    assert len(got) == 20
    assert all([a["qid"] for a in r["answers"]] == ["team", "late"] for r in got)
    assert got[0]["answers"][1]["legend"] == ['"no"', "2"]


def test_errors_of_parsing_come_out_at_the_end(spark, root):
    spec = {"q": {"type": "noul", "instructions": "?"}}
    bodies = [
        {"context": "hello my friend", "spec": spec}, {"context": "x", "spec": spec, "note": 1},
        {"context": "x", "spec": spec, "lang": 3}, {"context": "x", "spec": spec, "max_len": 2**31},
        {"context": "x", "spec": spec, "model": "nope"}, {"context": "x", "spec": spec, "max_len": 20},
        {"context": "x"}, {"context": "x", "spec": {"q": {"type": "choice", "instructions": "?"}}},
        {"context": "x", "spec": spec, "model": "ml"},
    ]
    rows = [(str(i), json.dumps(b)) for i, b in enumerate(bodies)]
    parsed = parse_requests(spark.createDataFrame(rows, "request_id string, body string"))
    keyed, own = intern_specs(parsed)
    known = catalog.read_catalog(spark, root).where("model <> 'multilingual'")
    got = {r["request_id"]: r for r in predict(
        keyed, own, known, TokenizerFiles(root), OnnxFiles(root)).collect()}
    assert len(got) == len(bodies)
    assert got["0"]["error"] is None and len(got["0"]["answers"]) == 1
    parts = {"1": "unknown field", "2": '"lang" must be a string', "3": "max_len", "4": "unknown model",
             "5": "too small", "6": 'missing "spec"', "7": 'need "criteria"', "8": "no checkpoint"}
    for i, part in parts.items():
        assert part in got[i]["error"] and got[i]["answers"] is None, i
        assert got[i]["error_class"] == ("unavailable" if i == "8" else "bad_request"), i


def test_golden_files_and_parity(spark, tmp_path):
    answers = {
        "dep": {"type": "choice", "choice": "x", "probabilities": {"x": 0.9, "y": 0.1}, "confidence": 0.5,
                "action": {"act_probability": 1.0}},
        "urg": {"type": "score", "score": 0.4, "legend": {"0": "lo", "1": "hi"},
                "probabilities": {"0": 0.6, "1": 0.4}, "confidence": 0.1, "action": {"act_probability": 0.2}},
        "risk": {"type": "noul", "noul": 0.8, "confidence": 0.8, "action": {"act_probability": 1.0}},
    }
    case = {"state": {"b": 1, "a": [1.50, "é"]}, "questions": {"dep": {"type": "choice"}},
            "sequences": {"dep": {"ids": [1, 5, 2], "markers": [1], "options": ["x: a", "y"]}},
            "result": {"answers": answers, "usage": {"input_tokens": 3, "output_tokens": 0}}}
    path = tmp_path / "golden_english.json"
    path.write_text(json.dumps({"model": "english", "cases": {"one": case}}, indent=1, ensure_ascii=False))
    df = golden.read_golden(spark, str(path))
    assert df.first()["result"]["usage"]["input_tokens"] == 3
    assert json.loads(df.first()["state"]) == case["state"]
    seq = golden.golden_sequences(df).first()
    assert (seq["qid"], seq["ids"], seq["options"]) == ("dep", [1, 5, 2], ["x: a", "y"])
    want = golden.golden_answers(df)
    keys = ["model", "case", "qid"]
    same = reports.answer_parity(want, want, keys)
    assert same.filter("verdict <> 'ok'").count() == 0 and same.count() == 6 + 8 + 4
    near = want.withColumn("score", F.col("score") + 0.0019).withColumn("noul", F.col("noul") + 0.0021)
    verdicts = {(r["qid"], r["field"]): r["verdict"] for r in reports.answer_parity(near, want, keys).collect()}
    assert verdicts["urg", "score"] == "ok" and verdicts["risk", "noul"] == "differs"
    lost = reports.answer_parity(want.filter("qid <> 'dep'"), want, keys)
    assert {r["qid"] for r in lost.filter("verdict = 'missing'").collect()} == {"dep"}


def test_drift_gate(spark):
    rows = [(1, [1.0, 2.0], [0.0, 0.0]), (2, [3.0], [1.0, 1.0])]
    a = spark.createDataFrame(rows, "id int, logits array<float>, act_logits array<float>")
    b = a.withColumn("logits", F.transform("logits", lambda x: (x + 0.02).cast("float")))
    assert reports.logit_drift(a, a, ["id"]).first()["within_gate"]
    r = reports.logit_drift(a, b, ["id"]).first()
    assert not r["within_gate"] and abs(r["max_logit_diff"] - 0.02) < 1e-6 and r["n"] == 2
