import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from askframe.functions.detect import detect, dominant_script, with_latin_language, with_script_counts
from askframe.functions.text import round4
from askframe.operators.route import RouterOptions, resolve_name, route

LETTERS = "abcXYZéßñıİſ ΑωΣς бЯ ءب क ক 漢字 かナ 한 ა ሀ ក Ա ﬀ ⅷ ² 12 .,-!\n\t’“😀"
MIXED = st.text(alphabet=st.sampled_from(LETTERS), max_size=60)
WORDS = st.lists(
    st.sampled_from("the is und nicht le la que está não é è gli het een zzz été the, İl".split()),
    max_size=14,
).map(" ".join)
SLOW = settings(
    max_examples=4, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string")


@SLOW
@given(st.lists(MIXED, min_size=60, max_size=60))
def test_scripts_follow_the_rule(spark, rows):
    df = with_script_counts(texts(spark, rows), "t", "c")
    for r in df.withColumn("d", dominant_script(F.col("c"))).collect():
        assert {c["script"]: c["n"] for c in r["c"]} == plain.script_counts(r["t"]), r["t"]
        assert r["d"] == plain.dominant(r["t"]), r["t"]


@SLOW
@given(st.lists(WORDS, min_size=60, max_size=60))
def test_languages_follow_the_rule(spark, rows):
    for r in with_latin_language(texts(spark, rows), "t", "g").collect():
        assert r["g"] == plain.language(r["t"]), r["t"]


def test_detection_of_known_texts(spark):
    rows = {
        "abc абв": ("cyrillic", None, False, 0.5),
        "абв αβγ ab": ("cyrillic", None, False, 0.75),
        "ab αβγ абв": ("greek", None, False, 0.75),
        "12345 !!!": ("unknown", None, True, 0.0),
        "Հայերեն": ("unknown", None, True, 0.0),
        "": ("unknown", None, True, 0.0),
        "ééé èèè ààà ûûû": ("latin", "fr", False, 0.0),
        "x y z": ("latin", None, True, 0.0),
        "The quick brown fox jumps over the lazy dog": ("latin", "en", True, 0.0),
        "Der Kunde wurde zweimal belastet und möchte das Geld zurück": ("latin", "de", False, 0.0),
    }
    got = detect(texts(spark, rows), "t", "d").select("t", "d.*").collect()
    for r in got:
        found = (r["script"], r["language"], r["is_english"], r["non_latin_fraction"])
        assert found == rows[r["t"]], r["t"]


def test_only_the_window_counts(spark):
    rows = ["a" * 4000 + "б" * 5000, "б" * 4000 + "a" * 9000]
    got = [r["s"] for r in detect(texts(spark, rows), "t", "d").select(
        F.col("d.script").alias("s")).collect()]
    assert got == ["latin", "cyrillic"]


def test_shares_and_null_text(spark):
    df = detect(texts(spark, ["二重に請求されました", None]), "t", "d").orderBy("id").collect()
    assert df[0]["d"]["script"] == "kana"
    assert df[0]["d"]["script_profile"] == {"kana": 0.6, "han": 0.4}
    assert df[1]["d"] is None


def test_routing_of_known_requests(spark):
    rows = [
        ("I was charged twice, please refund.", None, None, None, "english"),
        ("मुझसे दो बार शुल्क लिया गया", None, None, None, "multilingual"),
        ("二重に請求されました", None, None, None, "multilingual"),
        ("Der Kunde wurde zweimal belastet und möchte das Geld zurück", "", "", "", "multilingual"),
        ("12345 !!!", None, None, None, "english"),
        (None, "ml", None, None, "multilingual"),
        (None, None, None, "de-AT", "multilingual"),
        (None, None, None, "en_US", "multilingual"),
        (None, None, None, "ENG", "english"),
        (None, None, "typed_decisions", "de", "typed-decisions"),
        (None, None, "Typed-Decisions", None, "typed-decisions"),
        ("hello there my friend", None, None, "fr", "multilingual"),
        ("hello", "nope", None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, m string, k string, l string, want string")
    for r in route(df, "t", "m", "k", "l").select("want", "route.*").collect():
        assert r["model"] == r["want"]
        assert (r["error"] is None) == (r["model"] is not None)
        assert (r["reason"] is None) == (r["model"] is None)


def test_reasons(spark):
    rows = [
        ("l'x", "explicit lang=\"l'x\""),
        ("it's \"x\"", "explicit lang='it\\'s \"x\"'"),
        ("de", "explicit lang='de'"),
    ]
    df = spark.createDataFrame(rows, "l string, want string").withColumn("t", F.lit("x"))
    for r in route(df, "t", lang="l").select("want", "route.reason").collect():
        assert r["reason"] == r["want"]
    # Ties go to the even number: 62.5 % is written as 62, 87.5 % as 88.
    df = texts(spark, ["абвгд" + "abc", "абвгдеж" + "a"])
    got = [r["reason"] for r in route(df, "t").select("id", "route.reason").orderBy("id").collect()]
    assert got[0] == "non-Latin script (cyrillic, 62% of letters); the English checkpoint cannot read it"
    assert got[1] == "non-Latin script (cyrillic, 88% of letters); the English checkpoint cannot read it"


def test_columns_with_helper_names_stay(spark):
    df = texts(spark, ["привет", "hello there my friend"]).withColumn("_text", F.col("t"))
    df = df.withColumn("_model", F.lit("kept"))
    for operator in (
        lambda c: detect(df, c, "out"), lambda c: with_script_counts(df, c, "out"),
        lambda c: route(df, c, out="out"),
    ):
        by_other, by_own = operator("t"), operator(F.col("_text"))
        assert by_own.columns == by_other.columns == [*df.columns, "out"]
        rows = by_own.orderBy("id").collect()
        assert rows == by_other.orderBy("id").collect()
        assert [r["_text"] for r in rows] == [r["t"] for r in rows]
        assert {r["_model"] for r in rows} == {"kept"}


def test_workflow_only_on_request(spark):
    df = spark.createDataFrame([("hello", "customer_service")], "t string, w string")
    off = route(df, "t", workflow="w").select("route.*").first()
    on = route(df, "t", workflow="w", options=RouterOptions(auto_task=True)).select("route.*").first()
    assert (off["model"], off["workflow"]) == ("english", "customer_service")
    assert (on["model"], on["workflow"]) == ("typed-decisions", "customer_service")
    assert on["detection"] is None


def test_family_names_come_from_the_repo(spark):
    df = spark.createDataFrame([("Family",), ("family-multilingual",), ("en",), ("x",)], "n string")
    options = RouterOptions(repo_base="owner/family")
    got = [r[0] for r in df.select(resolve_name(F.col("n"), options)).collect()]
    assert got == ["english", "multilingual", "english", None]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(1, 4000)), min_size=300, max_size=300))
def test_round4_is_exact(spark, pairs):
    rows = [(1 - a / b,) for a, b in pairs] + [((2 * a + 1) / 32,) for a, _ in pairs]
    df = spark.createDataFrame(rows, "x double")
    for r in df.select("x", round4(F.col("x")).alias("y")).collect():
        assert r["y"] == round(r["x"], 4), r["x"]
