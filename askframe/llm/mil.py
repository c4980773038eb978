"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; only whole documents have labels. Every passage is
encoded, a gated attention gives each one a weight, and the score is read off the weighted sum, so
that a few bad passages of a long text can decide. Model (all learned together, in numpy):

    h = tanh(W x + b)            the encoded passage
    a = w . (tanh(V h) * sigmoid(U h))     its attention, softmax over the document
    score = sigmoid(c . sum(a h) + d)

Passage features describe the make-up of the text, in any language: shares of byte classes, word
lengths, repetition of words. Nothing but the text goes in.

The fit takes a bounded sample of labelled documents (``Fit.documents``) and every passage of each;
scoring reads every passage of every document. The model is a few thousand numbers and travels with
the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import arrow_columns, col

PASSAGE = 64
#: Text bytes that are encoded at once; a longer text is cut at white space near this length.
BLOCK = 512 << 10
#: Rows of an Arrow batch that are scored at once, which bounds a worker's memory.
ROWS = 500


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit: bound of the sample, sizes of the layers, steps of descent."""

    documents: int = 4000
    hidden: int = 16
    gate: int = 8
    steps: int = 200
    rate: float = 0.03
    decay: float = 1e-4
    seed: int = 42


def _classes() -> np.ndarray:
    """A class for each byte."""
    of = np.zeros(256, dtype=np.int64)
    groups = [
        range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b"\t\x0b\x0c\r ", b"\n", b"|",
        b"!", b".,;:?", b"'\"()-", range(0x80, 0xA0), range(0xA0, 0xC0), range(0xC0, 0x100),
    ]
    for i, group in enumerate(groups, 1):
        of[list(group)] = i
    return of


_CLASS = _classes()
_N_CLASSES = int(_CLASS.max()) + 1
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_RANDOM = np.random.default_rng(7).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
N_FEATURES = _N_CLASSES + 6


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The texts as runs of about ``BLOCK`` bytes: bytes, starts of the pieces, document numbers.

    Where a long text is cut depends on that text alone.
    """
    joined, starts, owners, size = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = min(at + BLOCK, len(text))
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                end = cut + 1 if cut > at else end
            starts.append(size)
            owners.append(i)
            joined.append(text[at:end] + b" ")
            size += end - at + 1
            at = end
            if size >= BLOCK:
                yield np.frombuffer(b"".join(joined), np.uint8), np.array(starts), np.array(owners)
                joined, starts, owners, size = [], [], [], 0
            if not text:
                break
    if joined:
        yield np.frombuffer(b"".join(joined), np.uint8), np.array(starts), np.array(owners)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of the text that each belongs to, in order.

    A text without words is one passage of zeros.
    """
    features, owners = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)]
    for data, starts, own in blocks(texts):
        space = _SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        words = np.flatnonzero(first)  # every piece ends with a space, so none runs into the next
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        piece = np.searchsorted(starts, words, side="right") - 1
        before = np.searchsorted(words, starts)
        opens = (np.arange(len(words)) - before[piece]) % PASSAGE == 0
        passage = np.cumsum(opens) - 1
        n = int(opens.sum())
        # A passage's bytes: from its first word (of the first passage, from the start of the
        # piece) to the next passage. Pieces without words count for nobody.
        opened = piece[opens]
        leads = np.append(True, opened[1:] != opened[:-1])[:n]
        mute = np.setdiff1d(np.arange(len(starts)), opened)
        edge = np.concatenate([np.where(leads, starts[opened], words[opens]), starts[mute]])
        row = np.concatenate([np.arange(n), np.full(len(mute), n)])
        order = np.argsort(edge, kind="stable")
        which = np.repeat(row[order], np.diff(np.append(edge[order], len(data))))
        counts = np.bincount(
            which * _N_CLASSES + _CLASS[data], minlength=(n + 1) * _N_CLASSES
        ).reshape(n + 1, _N_CLASSES)[:n].astype(float)
        in_words = np.bincount(passage, minlength=n).astype(float)
        width = (ends - words).astype(float)
        # A word's hash: each byte by its value, weighed by its place in the word.
        place = np.arange(len(data)) - np.repeat(
            np.concatenate([[0], words]), np.diff(np.concatenate([[0], words, [len(data)]])))
        mixed = _RANDOM[0][data] * _RANDOM[1][place & 0xFF]
        mixed[space] = 0
        code = np.add.reduceat(mixed, words) if len(words) else np.zeros(0, np.uint64)
        spread = code ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(spread, kind="stable")
        same = np.zeros(len(words), bool)
        same[order[1:]] = spread[order[1:]] == spread[order[:-1]]
        total = np.maximum(in_words, 1)
        size = np.maximum(counts.sum(axis=1), 1)
        mean = np.bincount(passage, width, minlength=n) / total
        spread_of = np.sqrt(np.maximum(
            np.bincount(passage, width ** 2, minlength=n) / total - mean ** 2, 0))
        follows = np.zeros(len(words), bool)
        follows[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
        found = np.column_stack([
            counts / size[:, None],
            np.bincount(passage, same, minlength=n) / total,
            np.bincount(passage, follows, minlength=n) / total,
            mean / 10, spread_of / 10, in_words / PASSAGE,
            np.bincount(passage, width <= 2, minlength=n) / total,
        ])
        owner = own[piece[opens]]
        silent = np.setdiff1d(own, owner)
        features.append(np.concatenate([found, np.zeros((len(silent), N_FEATURES))]).astype(np.float32))
        owners.append(np.concatenate([owner, silent]))
    x, owner = np.concatenate(features), np.concatenate(owners)
    # A long text that only has white space in some piece has its words elsewhere.
    order = np.argsort(owner, kind="stable")
    return x[order], owner[order]


@dataclass
class Model:
    """The learned numbers; ``constant`` replaces them where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags of passages that begin at ``starts``."""
        p = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "s": s, "sizes": sizes}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts or self.constant is not None:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        x, owner = passages(texts)
        return self.forward(x, np.searchsorted(owner, np.arange(len(texts))))["s"]


def gradient(model: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The mean cross entropy's slope along every weight."""
    p, f = model.weights, model.forward(x, starts)
    ds = (f["s"] - y) / len(y)
    bag = np.repeat(np.arange(len(y)), f["sizes"])
    dz = ds[:, None] * p["c"]
    along = (f["h"] * dz[bag]).sum(axis=1)
    da = f["alpha"] * (along - np.repeat(np.add.reduceat(f["alpha"] * along, starts), f["sizes"]))
    dt = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["alpha"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "W": f["x"].T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ da, "c": f["z"].T @ ds, "d": np.array([ds.sum()]),
    }


def learn(bags: list[np.ndarray], labels: np.ndarray, fit: Fit) -> Model:
    """Fit a model to bags of passage features by Adam on the mean cross entropy."""
    blank = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    if len(bags) == 0 or labels.min() == labels.max():
        blank.constant = float(labels[0]) if len(bags) else 0.5
        return blank
    x = np.concatenate(bags).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    y = labels.astype(float)
    draw = np.random.default_rng(fit.seed)

    def start(*shape: int) -> np.ndarray:
        return draw.normal(0, 1 / np.sqrt(shape[0]), shape)

    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {
        "W": start(N_FEATURES, fit.hidden), "b": np.zeros(fit.hidden),
        "V": start(fit.hidden, fit.gate), "U": start(fit.hidden, fit.gate),
        "w": start(fit.gate), "c": start(fit.hidden), "d": np.zeros(1),
    })
    p = model.weights
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, fit.steps + 1):
        grads = gradient(model, x, starts, y)
        for k, grad in grads.items():
            grad = grad + fit.decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad ** 2
            p[k] -= fit.rate * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _as_bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, label: str, fit: Fit = Fit(), key: str = "doc_id",
          text: str = "text") -> Model:
    """Learn ``label`` (0 or 1) of ``labels`` from the texts of ``docs``.

    Takes the ``fit.documents`` labelled keys with the smallest hashes, so the sample does not
    depend on how the tables lie. Of several labels of a key the smallest counts; null keys and
    labels take no part. Without labels the model gives 0.5, with one kind only that one.
    """
    sample = (
        labels.select(col(key).alias("k"), col(label).cast("int").alias("y"))
        .where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("k", F.lit(fit.seed)), "k").limit(fit.documents)
    )
    # fit.documents rows of two numbers: bounded by the parameter.
    picked = docs.select(col(key).alias("k"), col(text).alias("t")).join(F.broadcast(sample), "k")

    def make(batch: pa.RecordBatch) -> list:
        texts = _as_bytes(batch.column(1))
        x, owner = passages(texts)
        bags = np.split(x, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []
        return [[b.tobytes() for b in bags]]

    rows = arrow_columns(picked, ["k", "t", "y"], "x binary", make).select("k", "y", "x").collect()
    rows.sort(key=lambda r: (r.k, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    return learn(bags, np.array([r.y for r in rows]), fit)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and the probability of label 1 of each whole text; null counts as empty.
    A column of ``docs`` named ``out`` is replaced.

    A map without a shuffle: the model goes with the task.
    """
    where = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list:
        texts = batch.column(where)
        parts = [model.score(_as_bytes(texts.slice(i, ROWS))) for i in range(0, len(texts), ROWS)]
        return [pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())]

    return arrow_columns(docs, docs.columns, f"`{out}` double", make)
