import json

from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.operators import sequence, specs
from askframe.sources.requests import parse_requests
from askframe.sources.tables import lookup_join

RAW_SPECS = {
    "parcels": {
        "size": {"type": "choice", "instructions": "How large is the parcel?",
                 "criteria": ["letter", "box", "pallet", "box"]},
        "late": {"type": "noul", "instructions": "Did `parcel` arrive late?",
                 "criteria": {"true": "after the promised day", "false": "in time"}},
        "carrier": {"type": "choice", "instructions": {"who": "brought it", "when": [1, 2]},
                    "criteria": {"own": {"vans": 3, "since": "1999"}, "post": [True, None], "bike": 0, "foot": ""}},
        "levels": {"type": "score", "instructions": "how", "criteria": [None, 1.50, "top"]},
        "odd": {"type": "noul", "instructions": None, "criteria": ["not", "an", "object"]},
    }
}


def option_rows(df):
    rows = specs.question_rows(df)
    return rows.withColumn("options", specs.option_texts({c: F.col(c) for c in rows.columns}))


def test_presets(spark):
    df = option_rows(specs.presets(spark)).orderBy("spec_id", "q_pos").collect()
    assert sorted({r["spec_id"] for r in df}) == ["email", "guard", "moderation", "router", "triage"]
    for name, questions in fixed.PRESETS.items():
        mine = [r for r in df if r["spec_id"] == name]
        assert [r["qid"] for r in mine] == list(questions)
    by_id = {(r["spec_id"], r["qid"]): r for r in df}
    assert by_id["email", "category"]["options"][0] == "billing: invoices, payments, refunds"
    assert by_id["guard", "topic"]["options"][:2] == ["product_support", "coding"]
    assert by_id["email", "is_phishing"]["options"] == [
        "false: a legitimate email", "true: phishing, scam, or fraud"]
    assert by_id["triage", "frustration"]["options"][3] == "level 3: very angry or using strong language"
    assert by_id["email", "urgency"]["legend"][0] == '"no time pressure"'


def test_rendered_options_of_a_raw_spec(spark):
    bodies = [(n, json.dumps({"context": {"parcel": "x"}, "spec": s})) for n, s in RAW_SPECS.items()]
    df = parse_requests(spark.createDataFrame(bodies, "name string, body string"))
    got = {r["qid"]: r for r in option_rows(df.select("name", "error", "questions")).collect()}
    assert got["size"]["options"] == ["letter", "box", "pallet"]
    assert got["late"]["options"] == ["false: in time", "true: after the promised day"]
    assert got["carrier"]["options"] == [
        'own: {"vans": 3, "since": "1999"}', "post: [true, null]", "bike: 0", "foot"]
    assert got["carrier"]["instructions"] == '{"who": "brought it", "when": [1, 2]}'
    assert got["levels"]["options"] == ["level 0: null", "level 1: 1.5", "level 2: top"]
    assert got["levels"]["legend"] == ["null", "1.5", '"top"']
    assert got["odd"]["options"] == ["false: " + fixed.NOUL_FALSE, "true: " + fixed.NOUL_TRUE]
    assert got["odd"]["instructions"] == "null"


def test_custom_categories(spark):
    df = specs.presets(spark).withColumn(
        "cats", F.expr("array(named_struct('key','a','val','x'), named_struct('key','b','val','y'))")
    )
    df = specs.with_categories(df, "spec_id", "cats")
    got = {(r["spec_id"], r["qid"]): r["options"] for r in option_rows(df).collect()}
    assert got["email", "category"] == ["a: x", "b: y"]
    assert got["triage", "intent"][0].startswith("refund: ")


def test_lookup_join_with_a_hot_key(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    table = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    plain = rows.join(table, "k", "left")
    salted = lookup_join(rows, table, "k")
    assert salted.columns == plain.columns
    assert plain.exceptAll(salted.select(plain.columns)).count() == 0
    assert salted.count() == 9000


def prefixes(spark, head, options, limit):
    df = spark.createDataFrame(
        [(list(range(100, 100 + head)), [[7] * n for n in options], limit, 1, 2, 3)],
        "head array<int>, options array<array<int>>, head_max_len int, cls int, sep int, mask int",
    ).withColumn("qid", F.lit("q"))
    return sequence.question_prefix(df, "head", "options", "cls", "sep", "mask", "head_max_len")


def test_prefix_without_cuts(spark):
    r = prefixes(spark, 3, [2, 1], 192).first()
    assert r["prefix"] == [1, 100, 101, 102, 2, 3, 7, 7, 3, 7, 2]
    assert r["markers"] == [5, 8]


def test_budgets(spark):
    r = prefixes(spark, 300, [60, 1], 192).first()       # 48 ids at most per option
    assert r["markers"][1] - r["markers"][0] == 49
    assert len(r["prefix"]) == 192 + 3                    # the head takes what is left
    r = prefixes(spark, 300, [40] * 12, 192).first()      # tight: (192 - 16) // 12 = 14 ids each
    assert [b - a for a, b in zip(r["markers"], r["markers"][1:])] == [14] * 11
    r = prefixes(spark, 300, [40] * 60, 192).first()      # never below 4 ids, head never below 8
    assert [b - a for a, b in zip(r["markers"], r["markers"][1:])] == [4] * 59
    assert r["markers"][0] == 1 + 8 + 1


def test_assembly_cuts_the_state_and_reports_lost_options(spark):
    df = prefixes(spark, 3, [2, 1], 192).withColumn("state", F.sequence(F.lit(1000), F.lit(1900)))
    df = df.select("*", F.explode(F.expr("array(20, 11, 9, 8)")).alias("m"))
    got = {r["m"]: r for r in sequence.assemble(df, "state", "sep", "m").collect()}
    assert got[20]["ids"][-9:] == [1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, 2]
    assert len(got[20]["ids"]) == 20 and got[20]["error"] is None
    assert got[11]["ids"][-1] == 2 and len(got[11]["ids"]) == 11
    assert got[9]["error"] is None and got[9]["markers"] == [5, 8]
    assert got[8]["error"] == 'question "q" options exceed head_max_len=192'
