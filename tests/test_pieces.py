"""Python steps hold bounded pieces of a batch, whatever a batch holds."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import pyjson
from askframe.functions.batches import PIECE_BYTES, even_pieces, piece_edges, pieces
from askframe.operators.score import token_ids
from askframe.sources import raw_json


def test_pieces_hold_bounded_text_and_every_row():
    texts = ["a" * 10, None, "b" * 300, "", "c" * 40, "d" * 60, "é" * 50]
    got = list(pieces(pa.array(texts), limit=100))
    assert [p.to_pylist() for p in got] == [texts[:2], texts[2:3], texts[3:6], texts[6:]]
    assert [p.to_pylist() for p in pieces(pa.array([], pa.string()))] == [[]]
    both = list(pieces(pa.array(texts), pa.array(range(7)), limit=100))
    assert [b.to_pylist() for _, b in both] == [[0, 1], [2], [3, 4, 5], [6]]
    assert list(piece_edges(np.array([0, 0, 0]), 5)) == [(0, 3)]


def nested(rnd, depth=0):
    leaf = ["1", "-0", "1.50", "1E400", "null", "true", '"é\\n"', '"\\ud800"', "{}", " [ ]", "01", "tru"]
    if depth > 3 or rnd.random() < 0.4:
        return rnd.choice(leaf[:10] if rnd.random() < 0.95 else leaf)
    inner = [nested(rnd, depth + 1) for _ in range(rnd.randrange(1, 4))]
    if rnd.random() < 0.5:
        return "[" + rnd.choice([",", " , "]).join(inner) + "]"
    return "{" + ",".join(f'"{rnd.choice("abcdefé")}" :{x}' for x in inner) + " }"


def test_one_pass_gives_what_decoding_gives():
    rnd, equal_keys, broken = random.Random(3), 0, 0
    for _ in range(3000):
        text = nested(rnd)
        one, two = raw_json._Nodes(), raw_json._Nodes()
        try:
            canonical = raw_json._document_at_once(text, one)
        except (raw_json._Unusual, json.JSONDecodeError):
            try:
                raw_json._decoded(text)
                equal_keys += 1
            except ValueError:
                broken += 1
            continue
        assert canonical == raw_json._document_of(raw_json._decoded(text), two)
        assert vars(one) == vars(two), text
    assert equal_keys and broken


def test_deep_documents_come_in_pieces(spark, monkeypatch):
    """A batch of deep texts is not held as nodes at once: no call sees more than a piece."""
    depth, n = 2000, 1000
    parse = raw_json._parse_batch

    def bounded(texts):
        if sum(len(t) for t in texts) > PIECE_BYTES:
            raise ValueError("the whole batch at once")
        return parse(texts)

    texts = pa.array(["[" * depth + "7" + "]" * depth] * n)
    with pytest.raises(ValueError):
        bounded(texts.to_pylist())
    assert sum(len(bounded(p.to_pylist())[0]) for p in pieces(texts)) == n
    df = spark.range(n).selectExpr(f"concat(repeat('[', {depth}), id, repeat(']', {depth})) AS body")
    got = raw_json.parse_json(df.coalesce(1), "body").selectExpr(
        "size(nodes) AS n", "nodes[size(nodes) - 1].text AS leaf").collect()
    assert {r.n for r in got} == {depth + 1} and {int(r.leaf) for r in got} == set(range(n))


def test_an_encoder_sees_a_piece_at_a_time(spark):
    def load(model):
        def encode(texts):
            if sum(len(t) for t in texts) > PIECE_BYTES:
                raise ValueError("the whole batch at once")
            return [[len(t), int(t[:4])] for t in texts]

        return encode

    df = spark.range(1000, 3000).selectExpr(
        "id", "CASE WHEN id % 7 > 0 THEN concat(id, repeat(' word', 200)) END AS text",
        "CASE WHEN id % 5 > 0 THEN concat('m', id % 2) END AS model")
    ids = token_ids(load)(F.col("text"), F.col("model"))
    got = df.coalesce(1).withColumn("ids", ids).select("id", "ids").collect()
    assert len(got) == 2000
    for r in got:
        assert r.ids == ([1004, r.id] if r.id % 7 and r.id % 5 else None)


def test_compact_texts_and_fields_come_in_pieces():
    texts = ['{"a": [1, "%s"]}' % ("x" * 1000), None, "{", " 1 "] * 1000
    out = list(raw_json.compact_json.func(iter([pa.array(texts)])))
    assert len(out) > 3 and max(p.nbytes for p in out) <= PIECE_BYTES + 8 * len(texts)
    assert [t for p in out for t in p.to_pylist()] == [
        '{"a":[1,"%s"]}' % ("x" * 1000), None, None, "1"] * 1000
    fields = list(raw_json.json_fields.func(iter([pa.array(texts)])))
    assert len(fields) > 3 and sum(len(p) for p in fields) == 4000
    assert [f["path"] for f in fields[0][0].as_py()] == ["", "/a"] and fields[0][1].as_py() is None


def test_nested_doubles_are_written_by_columns():
    """One call for a column of values, whatever part of it, nulls and order of map keys."""
    dtype = T.ArrayType(T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.FloatType())))]))
    arrow = pa.list_(pa.struct([
        ("n", pa.int32()), ("x", pa.float64()), ("m", pa.map_(pa.string(), pa.list_(pa.float32())))]))
    rows = [
        ([{"n": 1, "x": 1e21, "m": [("z", [0.5]), ("a\"", None), ("\uffee", []), ("😀", [None])]}],
         '[{"n": 1, "x": 1e+21, "m": {"a\\"": null, "z": [0.5], "\uffee": [], "😀": [null]}}]'),
        (None, "null"),
        ([], "[]"),
        ([None, {"n": None, "x": float("nan"), "m": None}, {"n": -2, "x": None, "m": []}],
         '[null, {"n": null, "x": NaN, "m": null}, {"n": -2, "x": null, "m": {}}]'),
        ([{"n": 3, "x": -0.0, "m": [("k", [1, 0.1])]}],
         '[{"n": 3, "x": -0.0, "m": {"k": [1.0, 0.10000000149011612]}}]'),
    ]
    values = pa.array([v for v, _ in rows], arrow)
    for start in range(5):
        for n in range(6 - start):
            got = pyjson._texts(values.slice(start, n), dtype).to_pylist()
            assert got == [t for _, t in rows[start:start + n]]
    many = pa.array([v for v, _ in rows] * 5000, arrow)
    parts = list(even_pieces(many, PIECE_BYTES))
    assert max(p.nbytes for p in parts) < 2 * PIECE_BYTES and sum(len(p) for p in parts) == 25000
    assert [p.to_pylist() for p in even_pieces(values.slice(0, 0))] == [[]]
