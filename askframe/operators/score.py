"""The two steps that need Python: tokenisation and the forward pass.

Both work on Arrow batches and keep their loaded files per Python worker, so a worker that is
reused loads a tokenizer or a graph once. Files are read from a folder that all executors
share; nothing of the size of a model travels through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import fixed
from askframe.functions.batches import pieces

Encoder = Callable[[list[str]], list[list[int]]]
Scorer = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]

_LOADED: dict[tuple, object] = {}


def _once(key: tuple, load: Callable[[], object]):
    """Load something once per Python worker."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


# --- tokenisation -----------------------------------------------------------------------------


class TokenizerFiles:
    """Loads ``<root>/<model>/tokenizer.json``."""

    def __init__(self, root: str, file: str = "tokenizer.json"):
        self.root, self.file = root.rstrip("/"), file

    def __call__(self, model: str) -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        from tokenizers import Tokenizer

        def load():
            tokenizer = Tokenizer.from_file(f"{self.root}/{model}/{self.file}")
            tokenizer.no_padding()
            tokenizer.no_truncation()
            return tokenizer

        tokenizer = _once(("tokenizer", self.root, self.file, model), load)
        return lambda texts: [
            e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]


def token_ids(load_encoder: Callable[[str], Encoder]) -> Callable[[Column, Column], Column]:
    """UDF (text, model) -> ids without special tokens; null text or model gives null."""

    def ids_of(texts: pa.Array, models: pa.Array) -> pa.Array:
        rows: dict[str, list[int]] = {}
        given = texts.to_pylist()
        for i, (text, model) in enumerate(zip(given, models.to_pylist())):
            if text is not None and model is not None:
                rows.setdefault(model, []).append(i)
        found: list = [None] * len(given)
        for model, wanted in rows.items():
            encoded = load_encoder(model)([given[i] for i in wanted])
            for i, ids in zip(wanted, encoded):
                found[i] = np.array(ids, np.int32)
        return pa.array(found, pa.list_(pa.int32()))

    # An encoder keeps far more per token than its id, so it sees a piece of a batch at a time.
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, models in batches:
            for piece in pieces(texts, models):
                yield ids_of(*piece)

    return encode


# --- forward pass -----------------------------------------------------------------------------


class OnnxFiles:
    """Loads ``<root>/<model>/<file>`` as an ONNX Runtime session."""

    def __init__(self, root: str, file: str = fixed.DEFAULT_GRAPH_FILE, threads: int = 1):
        self.root, self.file, self.threads = root.rstrip("/"), file, threads

    def __call__(self, model: str) -> Scorer:
        import onnxruntime as ort

        def load():
            options = ort.SessionOptions()
            options.intra_op_num_threads = self.threads
            options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
            return ort.InferenceSession(
                f"{self.root}/{model}/{self.file}", options, providers=["CPUExecutionProvider"]
            )

        session = _once(("onnx", self.root, self.file, model), load)
        return lambda inputs: tuple(session.run(fixed.GRAPH_OUTPUTS, inputs))


def padded_batch(
    rows: list[int], ids: list[np.ndarray], markers: list[np.ndarray], qcodes: np.ndarray,
    pad_id: int,
) -> dict[str, np.ndarray]:
    """The five dense inputs of a graph for some sequences."""
    length = max(len(ids[r]) for r in rows)
    width = max(2, max(len(markers[r]) for r in rows))  # the graph wants two options or more
    batch = {
        "input_ids": np.full((len(rows), length), pad_id, np.int64),
        "attention_mask": np.zeros((len(rows), length), np.int64),
        "marker_pos": np.zeros((len(rows), width), np.int64),
        "marker_mask": np.zeros((len(rows), width), np.int64),
        "qtype": qcodes[rows].astype(np.int64),
    }
    for i, r in enumerate(rows):
        batch["input_ids"][i, : len(ids[r])] = ids[r]
        batch["attention_mask"][i, : len(ids[r])] = 1
        batch["marker_pos"][i, : len(markers[r])] = markers[r]
        batch["marker_mask"][i, : len(markers[r])] = 1
    return batch


def _ragged(lists: pa.ListArray) -> list[np.ndarray]:
    values = lists.values.to_numpy(zero_copy_only=False)
    edges = lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _list_of_floats(rows: list[np.ndarray]) -> pa.ListArray:
    edges = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    values = np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values))


def _score_sequences(
    flat: pa.StructArray, models: np.ndarray, pads: np.ndarray,
    load_scorer: Callable[[str], Scorer], max_tokens: int,
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Logits and act logits of every sequence, scored in batches of similar length."""
    names = [f.name for f in flat.type]
    fields = dict(zip(names, flat.flatten()))
    ids, markers = _ragged(fields["ids"]), _ragged(fields["markers"])
    qcodes = fields["qcode"].to_numpy(zero_copy_only=False)
    lengths = np.array([len(x) for x in ids])
    logits: list = [None] * len(ids)
    act: list = [None] * len(ids)
    for model in sorted(set(models)):
        scorer = load_scorer(model)
        mine = np.flatnonzero(models == model)
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        start = 0
        while start < len(mine):
            # Ascending lengths: the last row of a batch decides its width.
            stop = start + 1
            while stop < len(mine) and (stop + 1 - start) * lengths[mine[stop]] <= max_tokens:
                stop += 1
            rows = mine[start:stop].tolist()
            z, a = scorer(padded_batch(rows, ids, markers, qcodes, int(pads[rows[0]])))
            if z.shape[0] != len(rows) or a.shape[0] != len(rows):
                raise ValueError(f"graph of {model} returned {z.shape} and {a.shape}")
            for i, r in enumerate(rows):
                logits[r], act[r] = z[i, : len(markers[r])], a[i]
            start = stop
    return logits, act


def score(
    df: DataFrame,
    load_scorer: Callable[[str], Scorer],
    sequences: str = "sequences",
    model: str = "model",
    pad_id: str = "pad_id",
    max_tokens: int = 16384,
) -> DataFrame:
    """Replace ``sequences`` by ``logits`` and ``act_logits`` (ARRAY<ARRAY<FLOAT>>).

    Sequences are batched across requests inside an Arrow batch: sorted by length and cut so
    that a padded batch holds at most ``max_tokens`` ids. Rows without sequences get nulls.
    """
    at = {c: df.columns.index(c) for c in (sequences, model, pad_id)}
    kept = [f for f in df.schema.fields if f.name != sequences]
    nested = T.ArrayType(T.ArrayType(T.FloatType()))
    schema = T.StructType(
        kept + [T.StructField("logits", nested), T.StructField("act_logits", nested)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at[sequences])
            counts = np.array([0 if n is None else n for n in _sizes(column)], np.int64)
            models = np.array(batch.column(at[model]).to_pylist(), dtype=object)
            pads = np.array([p or 0 for p in batch.column(at[pad_id]).to_pylist()], np.int64)
            logits, act = _score_sequences(
                column.flatten(), models.repeat(counts), pads.repeat(counts), load_scorer,
                max_tokens,
            )
            # A null in the offsets makes the list null.
            edges = np.concatenate([[0], np.cumsum(counts)])
            missing = np.append(column.is_null().to_numpy(zero_copy_only=False), False)
            offsets = pa.array(edges.astype(np.int32), mask=missing)
            outputs = [
                pa.ListArray.from_arrays(offsets, _list_of_floats(x)) for x in (logits, act)
            ]
            rest = [c for i, c in enumerate(batch.columns) if i != at[sequences]]
            yield pa.RecordBatch.from_arrays([*rest, *outputs], names=schema.names)

    return df.mapInArrow(run, schema)


def _sizes(column: pa.ListArray) -> list:
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_pylist()
