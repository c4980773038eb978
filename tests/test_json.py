import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import pyjson
from askframe.sources import raw_json

SLOW = settings(
    max_examples=4, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=20)


@SLOW
@given(st.lists(st.tuples(TEXT, st.integers(-2**62, 2**62), st.booleans(),
                          st.floats(allow_nan=False), st.lists(TEXT, max_size=3)),
                min_size=60, max_size=60))
def test_typed_rows_dump_like_python(spark, rows):
    schema = "s string, n bigint, b boolean, f double, a array<string>"
    df = spark.createDataFrame(rows, schema)
    dtype = T.StructType(df.schema.fields)
    df = df.withColumn("j", pyjson.json_text(F.struct("s", "n", "b", "f", "a"), dtype))
    for r in df.withColumn("e", pyjson.ascii_escape(F.col("j"))).collect():
        value = {k: r[k] for k in "snbfa"}
        assert r["j"] == json.dumps(value, ensure_ascii=False)
        assert r["e"] == json.dumps(value)


def test_nulls_and_nesting(spark):
    df = spark.sql("""SELECT named_struct('a', cast(null AS string), 'm', map('z', 1, 'a', null),
        'l', array(named_struct('x', true), null), 'd', array(1.0D, null), 'e', array()) AS c""")
    text = df.select(pyjson.json_text("c", df.schema["c"].dataType).alias("j")).first()["j"]
    assert text == '{"a": null, "m": {"a": null, "z": 1}, "l": [{"x": true}, null], "d": [1.0, null], "e": []}'


def test_context_depth(spark):
    df = spark.sql("""SELECT named_struct('a', 'top', 'n', 1, 'b', array('x', null, 'y'),
      'd', array(array(array(array(array('six'))))), 'e', array(array(array(array(array(array('seven'))))))) AS c""")
    text = df.select(pyjson.context_text("c", df.schema["c"].dataType).alias("t")).first()["t"]
    assert text == "top x y six"


DUMPS = [
    ('{"a": 1, "b": [1.0, 2.5e-7, 1e21, true, null], "c": "é\\n\\"q\\"", "d": {"z": 1, "a": 2}}',
     '{"a": 1, "b": [1.0, 2.5e-07, 1e+21, true, null], "c": "é\\n\\"q\\"", "d": {"z": 1, "a": 2}}'),
    ("[100000000000000000000.0, 0.0001, 0.00001, 123456789012345680000]",
     "[1e+20, 0.0001, 1e-05, 123456789012345680000]"),
    ('"😀"', '"😀"'),
    ('{"a":1,"b":2,"a":[3]}', '{"a": [3], "b": 2}'),
    ("[-0, -0.0, 1e400, -1e400, 2.50]", "[0, -0.0, Infinity, -Infinity, 2.5]"),
    ('"\\ud800x\\ud83d\\ude00"', '"�x😀"'),
    (" 1 ", "1"),
    ("1" * 5000, "1" * 5000),
]
BROKEN = ["{", "{} x", "[1,]", "NaN", "Infinity", "{'a': 1}", '"\x01"', "01", "[" * 100000]


def test_raw_json(spark):
    rows = [(t, w) for t, w in DUMPS] + [(t, None) for t in BROKEN] + [("", None), (None, None)]
    df = raw_json.parse_json(spark.createDataFrame(rows, "t string, want string"), "t")
    for r in df.collect():
        assert r["canonical"] == r["want"], r["t"][:60]
        assert (r["invalid"] is not None) == (r["t"] in BROKEN), r["t"]
    escaped = raw_json.parse_json(
        spark.createDataFrame([('{"q": "Grüße 😀"}',)], "t string"), "t"
    ).select(pyjson.ascii_escape(F.col("canonical")).alias("e")).first()["e"]
    assert escaped == '{"q": "Gr\\u00fc\\u00dfe \\ud83d\\ude00"}'


JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | TEXT,
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(TEXT, inner, max_size=4),
    max_leaves=12,
)


@SLOW
@given(st.lists(JSON, min_size=60, max_size=60))
def test_raw_nodes(spark, values):
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    df = raw_json.parse_json(df, "t").withColumn("root", F.element_at("nodes", 1))
    df = df.withColumn("kids", raw_json.children(F.col("nodes"), F.col("root")))
    df = df.withColumn(
        "parts", F.transform("kids", lambda k: raw_json.node_json(F.col("canonical"), k))
    )
    for r in df.collect():
        value = json.loads(r["t"])
        assert r["canonical"] == json.dumps(value, ensure_ascii=False)
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
        assert r["parts"] == [json.dumps(v, ensure_ascii=False) for v in inner]
        if isinstance(value, dict):
            assert [k["key"] for k in r["kids"]] == list(value)


def test_documents_of_any_depth(spark):
    deep = "[" * 6000 + '{"a": [1.50, "x"]}' + "]" * 6000
    keyed = '{"k": ' * 3000 + "null" + "}" * 3000
    bad = {"[" * 3000: "Expecting value", "[" * 3000 + "1" + "]" * 2999: "Expecting ',' delimiter",
           '{"k" 1}': "Expecting ':' delimiter", '{"k": ' * 3000 + "1" + "}" * 3001: "trailing data after JSON value"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([deep, keyed, *bad])], "id int, body string")
    got = {r["id"]: r for r in raw_json.parse_json(df, "body").collect()}
    assert got[0]["canonical"] == deep.replace("1.50", "1.5") and len(got[0]["nodes"]) == 6004
    assert got[0]["nodes"][0]["size"] == 6004 and got[0]["nodes"][-1]["depth"] == 6002
    assert got[1]["canonical"] == keyed and got[1]["nodes"][-1]["key"] == "k"
    for i, message in enumerate(bad.values(), 2):
        assert got[i]["invalid"] == message and got[i]["nodes"] == []


def test_doubles_and_maps_deep_inside(spark):
    df = spark.sql("""SELECT named_struct(
        'items', array(named_struct('p', 1e21D, 'f', CAST(0.1 AS FLOAT)), named_struct('p', CAST(NULL AS DOUBLE), 'f', NULL)),
        'd', CAST(12.30 AS DECIMAL(6, 2)),
        'm', map('b', map('y', 2, 'x', 1), 'a', CAST(NULL AS MAP<STRING, INT>)),
        'n', map('z', array(2.5e-7D), 'a', array()), 't', array(map('k', 'vé"'))) AS c""")
    text = df.select(pyjson.json_text("c", df.schema["c"].dataType).alias("t")).first()["t"]
    assert text == ('{"items": [{"p": 1e+21, "f": 0.10000000149011612}, {"p": null, "f": null}], "d": 12.30, '
                    '"m": {"a": null, "b": {"x": 1, "y": 2}}, "n": {"a": [], "z": [2.5e-07]}, "t": [{"k": "vé\\""}]}')


def test_a_document_is_read_without_an_encoder_per_string(monkeypatch):
    texts = [
        '{"a": "x", "b" :[1.50, -0, 1e2], "c":{ "q\\"\\u00e9" : null}}', '{"é\U0001f600": "\\ud800", "\\n": "a\\\\"}',
        '{"": {"": [true, "\u2028"]}}', '[{"k"\t:\n"v"}, {}]', '{"\\ud83d\\ude00": "\x7f/\\/"}']
    want = []
    for text in texts:
        nodes = raw_json._Nodes()
        canonical = raw_json._document_of(raw_json._decoded(text), nodes)
        assert canonical.count('"') == text.count('"')
        want.append((canonical, vars(nodes)))

    class Costly(json.JSONEncoder):
        def __init__(self, *args, **more):
            raise AssertionError("an encoder set up for a single string")

    monkeypatch.setattr(json, "JSONEncoder", Costly)
    for text, (canonical, columns) in zip(texts, want, strict=True):
        nodes = raw_json._Nodes()
        assert raw_json._document(text, nodes) == canonical and vars(nodes) == columns


def test_keys_that_are_no_plain_keys():
    for text in ('{"a" 1}', '{"a\tb": 1}', '{"a": 1,}', '{a: 1}', '{"a', '{"a"', '{"a":', '{"a\\x": 1}', '{"\0": 1}'):
        try:
            json.loads(text)
            raise AssertionError(text)
        except json.JSONDecodeError as e:
            want = e.msg
        found = raw_json._parse_batch([text])
        assert found[0].to_pylist() == [want] and found[3].to_pylist() == [[]]
    nodes = raw_json._Nodes()
    assert raw_json._document('{"a": 1, "\\u0061": {"b": 2}}', nodes) == '{"a": {"b": 2}}' and len(nodes) == 3
