from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from askframe.functions.email import clean_email, email_context
from askframe.functions.pyjson import object_text

LINES = st.sampled_from([
    "", " ", "\t", "\u000b", "\x1c", " ", "Hi team,", "  indented  text\t ", "> old", "  > old",
    " > old", ">", "On Mon, Bob wrote:", "on x wrote: ", "Only wrote: x", "-- Original Message --",
    "--- forwarded message ---", "________", "_______", "From: a@b.c", "from:", "From: ", "--", " -- ",
    "Thanks,", "thanks a lot; really", "Kind regards, Bob", "Best", "cheers!", "Sent from my iPhone",
    "This email is CONFIDENTIAL.", "intended for the addressee only", "intended solely for the recipient",
    "if you received this e-mail in error", "a" * 60, "Best " + "x" * 40, "naïve Grüße 😀", "ends \r",
])
NEWLINE = st.sampled_from(["\n", "\n", "\n", "\r\n", "\r", "\\n"])
BODY = st.lists(st.tuples(LINES, NEWLINE), max_size=16).map(lambda x: "".join(a + b for a, b in x))
SLOW = settings(
    max_examples=8, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


@SLOW
@given(st.lists(BODY, min_size=120, max_size=120))
def test_cleaner_follows_the_rule(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for r in clean_email(df, "b", "c").collect():
        assert r["c"] == plain.clean(r["b"]), r["b"]


def test_known_bodies(spark):
    long = "word " * 2000
    cases = {
        "Hi team,\n\nWe were billed twice.\nPlease refund.\n\nThanks,\nBob\n\nOn Mon, Bob wrote:\n"
        "> old stuff\n\nThis email is confidential.": "Hi team,\n\nWe were billed twice.\nPlease refund.",
        "On Mon, Bob wrote:\nreal text": "On Mon, Bob wrote:\nreal text",
        "> quoted\nFrom: x\ny": "From: x\ny",
        "": "",
        "> a\n> b": "",
        "Sent from my iPhone": "Sent from my iPhone",
        "one\nSent from my iPhone": "one",
        "one\nſent from my IPHONE": "one",
        "one\nKind regards": "one",
        "one\nKind regards": "one",
        "one\nsent from my ıphone": "one\nsent from my ıphone",
        long: ("word " * 600),
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "b string, want string")
    for r in clean_email(df, "b", "c").collect():
        assert r["c"] == r["want"], r["b"][:80]


def test_email_context(spark):
    df = spark.createDataFrame(
        [("  Re: x ", "hi", "", None), ("s", "b", "a@b", "x")], "s string, b string, f string, e string"
    )
    got = df.select(object_text(email_context("s", "b", "f", {"e": F.col("e")})).alias("j")).collect()
    assert got[0]["j"] == '{"subject": "Re: x", "body": "hi"}'
    assert got[1]["j"] == '{"subject": "s", "body": "b", "from": "a@b", "e": "x"}'
