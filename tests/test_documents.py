"""JSON documents as wholes: typed leaves, differences, and columns beside a body."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askframe.functions.pyjson import json_text
from askframe.operators import reports, specs
from askframe.sources import raw_json
from askframe.sources.requests import HELPERS, parse_requests

LEAVES = ("day date, at timestamp, local timestamp_ntz, raw binary, n decimal(9,2), b boolean, "
          "i int, s string")
VALUE = (dt.date(2024, 5, 1), dt.datetime(2024, 5, 1, 12, 30, 0, 5), dt.datetime(1999, 12, 31, 23, 59),
         b"\x00\xff", Decimal("1.50"), True, 3, 'q"é')
TEXT = ('"day": "2024-05-01", "at": "2024-05-01T12:30:00.000005+00:00", "local": "1999-12-31T23:59:00", '
        '"raw": "AP8=", "n": 1.50, "b": true, "i": 3, "s": "q\\"é"')


def text_of(spark, value, ddl):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    return df.select(json_text("v", df.schema["v"].dataType)).first()[0]


def test_same_text_with_and_without_a_double_beside(spark):
    nulls = (None,) * len(VALUE)
    empty = TEXT.split('"day"')[0] + ", ".join(f'"{f.split()[0]}": null' for f in LEAVES.split(", "))
    assert text_of(spark, [VALUE, nulls, None], f"array<struct<{LEAVES.replace(' ', ':')
                   .replace(',:', ',')}>>") == f"[{{{TEXT}}}, {{{empty}}}, null]"
    ddl = f"struct<{LEAVES.replace(' ', ':').replace(',:', ',')},x:double>"
    assert text_of(spark, [(*VALUE, 2.5)], f"array<{ddl}>") == f'[{{{TEXT}, "x": 2.5}}]'
    assert text_of(spark, {"k": (*VALUE, None)}, f"map<string,{ddl}>") == f'{{"k": {{{TEXT}, "x": null}}}}'
    assert json.loads(text_of(spark, [(*VALUE, 1e30)], f"array<{ddl}>"))[0]["x"] == 1e30


def test_variants_keep_what_they_hold(spark):
    v = F.parse_json(F.lit('{"b": [1, 2.50, "é", null], "a": {"t": true}}'))
    df = spark.range(1).select(
        v.alias("v"), F.array(v, F.lit(None)).alias("vs"), F.struct(v.alias("in"), F.lit(0.5).alias("x")).alias("s"))
    text = json_text("v", df.schema["v"].dataType)
    one, many, inside = df.select(text, *[
        json_text(c, df.schema[c].dataType) for c in ("vs", "s")]).first()
    assert json.loads(one) == {"b": [1, 2.5, "é", None], "a": {"t": True}} and '"é", null]' in one
    assert many == f"[{one}, null]" and inside == f'{{"in": {one}, "x": 0.5}}'


def test_types_without_text_are_refused_on_both_paths(spark):
    for ddl in ("array<struct<i:interval day to second,x:double>>", "struct<i:interval day to second>"):
        df = spark.createDataFrame([], f"v {ddl}")
        with pytest.raises(TypeError):
            json_text("v", df.schema["v"].dataType)


# --- differences ------------------------------------------------------------------------------


def plain_equal(a, b, tol=2e-3):
    number = lambda x: x is None or (isinstance(x, (int, float)) and not isinstance(x, bool))
    if number(a) and number(b):
        return abs((a or 0) - (b or 0)) <= tol
    fields = lambda x: x is None or isinstance(x, dict)
    if fields(a) and fields(b):
        a, b = a or {}, b or {}
        return len(a) == len(b) and all(k in b and plain_equal(a[k], b[k], tol) for k in a)

    def even(x):
        if isinstance(x, list):
            return [even(v) for v in x]
        if isinstance(x, dict):
            return {k: even(v) for k, v in x.items()}
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else x

    return json.dumps(even(a), sort_keys=True) == json.dumps(even(b), sort_keys=True)


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.001, 1.0, 1.0015, 1.5]),
                 st.sampled_from(["", "a", "1"]))
DOCUMENT = st.recursive(
    LEAF, lambda inner: st.one_of(
        st.lists(inner, max_size=2), st.dictionaries(st.sampled_from(["a", "b", "/", "~"]), inner, max_size=3)),
    max_leaves=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(DOCUMENT, DOCUMENT), min_size=20, max_size=60))
def test_difference_equals_recursive_comparison(spark, pairs):
    pairs = pairs + [(a, a) for a, _ in pairs[:5]]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    parity = reports.document_parity(
        df.select("id", F.col("a").alias("d")), df.select("id", F.col("b").alias("d")), ["id"], "d")
    got = {r.id: r.equal for r in reports.equal_documents(parity, ["id"]).collect()}
    assert got == {i: plain_equal(a, b) for i, (a, b) in enumerate(pairs)}


def test_paths_and_documents_of_one_side(spark):
    a = spark.createDataFrame([(1, '{"x": {"/y": [1, {"z": 2}]}, "n": 1}'), (2, "{"), (3, None), (4, "{}")],
                              "id long, d string")
    b = spark.createDataFrame([(1, '{"n": 1.001, "x": {"/y": [1.0, {"z": 2}], "~": 0}}'), (2, "{"), (3, None),
                               (5, "[]")], "id long, d string")
    got = {(r.id, r.path): r.verdict for r in reports.document_parity(a, b, ["id"], "d").collect()}
    assert got == {(1, ""): "ok", (1, "/n"): "ok", (1, "/x"): "differs", (1, "/x/~1y"): "ok",
                   (1, "/x/~0"): "missing", (2, ""): "ok", (3, ""): "ok", (4, ""): "extra", (5, ""): "missing"}


# --- own columns ------------------------------------------------------------------------------


def test_own_columns_beside_a_body(spark):
    """Every helper name, in other letters too, keeps its value."""
    own = [h.upper() if i % 2 else h for i, h in enumerate(HELPERS)]
    body = '{"context": "c", "spec": {"q": {"type": "noul", "instructions": "?"}}}'
    df = spark.createDataFrame([(body, "guard", *range(len(own)))],
                               "body string, pre string, " + ", ".join(f"`{c}` int" for c in own))
    for extra in ({}, {"endpoint": "route"}, {"endpoint": "preset", "preset": "pre",
                                              "presets": specs.presets(spark)}):
        done = parse_requests(df, **extra)
        row = done.first().asDict()
        assert [row[c] for c in own] == list(range(len(own)))
        assert (row["body"], row["pre"], row["state_text"]) == (body, "guard", "c")
        assert row["error"] is None or extra.get("endpoint") == "preset"


def test_body_in_a_column_of_a_helper_name(spark):
    df = spark.createDataFrame([('{"context": "c"}', 7)], "kind string, spec_id int")
    row = parse_requests(df, "kind", endpoint="route").first()
    assert (row.kind, row.spec_id, row.state_text, row.error) == ('{"context": "c"}', 7, "c", None)
    parsed = raw_json.parse_json(df.withColumn("NODES", F.lit(1)), "kind")
    assert parsed.columns == ["spec_id", "invalid", "kind", "canonical", "nodes"]
    assert parsed.first().kind == "object"
