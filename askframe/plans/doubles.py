"""Stand-ins for the files of a checkpoint, which cannot be shipped with this repository.

``WordTokenizer`` knows only the stopwords; ``GraphDouble`` is a real ONNX graph of eight nodes
with the inputs and outputs of a checkpoint, but without a model in it. They let the whole
pipeline run and be checked; their answers mean nothing.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from askframe.functions import fixed
from askframe.functions.detect import ALL_WORDS
from askframe.operators.score import _once
from askframe.sources.tables import small_table

UNKNOWN_ID = 9
FIRST_WORD_ID = 10
LOGIT_STEP = 0.03125
LENGTH_STEP = 0.0078125


class WordTokenizer:
    """Blank-separated words: a stopword has its own id, anything else is unknown."""

    def __call__(self, model: str):
        from tokenizers import Tokenizer
        from tokenizers.models import WordLevel
        from tokenizers.pre_tokenizers import WhitespaceSplit

        def load():
            vocabulary = {w: FIRST_WORD_ID + i for i, w in enumerate(ALL_WORDS)}
            vocabulary["[UNK]"] = UNKNOWN_ID
            tokenizer = Tokenizer(WordLevel(vocabulary, unk_token="[UNK]"))
            tokenizer.pre_tokenizer = WhitespaceSplit()
            return tokenizer

        tokenizer = _once(("word tokenizer",), load)
        return lambda texts: [
            e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]


class GraphDouble:
    """logits = marker position x LOGIT_STEP; act_logits = [length x LENGTH_STEP, type code]."""

    def __call__(self, model: str):
        import onnxruntime as ort

        def load():
            options = ort.SessionOptions()
            options.intra_op_num_threads = 1
            return ort.InferenceSession(
                graph_bytes(), options, providers=["CPUExecutionProvider"]
            )

        session = _once(("graph double", model), load)
        return lambda inputs: tuple(session.run(fixed.GRAPH_OUTPUTS, inputs))


def catalog(spark: SparkSession) -> DataFrame:
    """Checkpoints of the stand-ins; the multilingual one has other settings."""
    rows = [
        ("english", "hub/en", 512, 192, [1.0, 1.0, 1.0], {"choice:6-10": 0.5}, 1, 2, 3, 0,
         fixed.DEFAULT_MASK),
        ("multilingual", "", 1024, 64, [0.5, 2.0, 1.5], {}, 1, 2, 3, 0, "<mask>"),
        ("typed-decisions", "hub/td", 256, 100, [1.0, 1.0, 0.25], {"score:3-5": 0.125}, 1, 2, 3,
         0, fixed.DEFAULT_MASK),
    ]
    return small_table(
        spark,
        rows,
        "model string, repo string, max_len int, head_max_len int, temperature array<double>, "
        "temperature_by_options map<string,double>, cls_id int, sep_id int, mask_id int, "
        "pad_id int, mask string",
    )


# --- a tiny ONNX file by hand: protobuf fields of the public onnx.proto ------------------------

_FLOAT, _INT64 = 1, 7


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _part(field: int, value: bytes | str) -> bytes:
    data = value.encode() if isinstance(value, str) else value
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _attribute(name: str, value: int | list[int]) -> bytes:
    if isinstance(value, int):
        body = _part(1, name) + _int(3, value) + _int(20, 2)
    else:
        body = _part(1, name) + b"".join(_int(8, v) for v in value) + _int(20, 7)
    return _part(5, body)


def _node(op: str, inputs: list[str], output: str, **attributes) -> bytes:
    body = b"".join(_part(1, i) for i in inputs) + _part(2, output) + _part(4, op)
    return _part(1, body + b"".join(_attribute(k, v) for k, v in attributes.items()))


def _constant(name: str, value: float) -> bytes:
    return _part(5, _int(2, _FLOAT) + _part(8, name) + _part(9, struct.pack("<f", value)))


def _tensor(field: int, name: str, dtype: int, dims: list[str]) -> bytes:
    shape = b"".join(_part(1, _part(2, d)) for d in dims)
    kind = _part(1, _int(1, dtype) + _part(2, shape))
    return _part(field, _part(1, name) + _part(2, kind))


def graph_bytes() -> bytes:
    wide, narrow = ["n", "l"], ["n", "k"]
    shapes = dict(zip(fixed.GRAPH_INPUTS, [wide, wide, narrow, narrow, ["n"]]))
    graph = (
        _node("Cast", ["marker_pos"], "positions", to=_FLOAT)
        + _node("Mul", ["positions", "logit_step"], "logits")
        + _node("Cast", ["attention_mask"], "mask", to=_FLOAT)
        + _node("ReduceSum", ["mask"], "length", axes=[1], keepdims=1)
        + _node("Mul", ["length", "length_step"], "scaled_length")
        + _node("Cast", ["qtype"], "code", to=_FLOAT)
        + _node("Unsqueeze", ["code"], "code_column", axes=[1])
        + _node("Concat", ["scaled_length", "code_column"], "act_logits", axis=1)
        + _part(2, "double")
        + _constant("logit_step", LOGIT_STEP)
        + _constant("length_step", LENGTH_STEP)
        + b"".join(_tensor(11, n, _INT64, dims) for n, dims in shapes.items())
        + _tensor(12, "logits", _FLOAT, narrow)
        + _tensor(12, "act_logits", _FLOAT, ["n", "two"])
    )
    return _int(1, 6) + _part(7, graph) + _part(8, _part(1, "") + _int(2, 11))
