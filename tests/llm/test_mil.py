import random

import numpy as np
from pyspark.sql import functions as F

from askframe.llm import mil


def texts(n=160):
    draw = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeio" for c in ("r", "nt", "ling", "")]
    for i in range(n):
        prose = [" ".join(draw.choice(words) for _ in range(64)) for _ in range(draw.randrange(2, 6))]
        good = i % 3 != 0
        if not good:  # one bad passage among good ones
            prose[draw.randrange(len(prose))] = draw.choice([
                "spam " * 64, "BUY!! NOW!! " * 32, " | ".join(draw.choice(words) for _ in range(32))])
        yield i, "\n".join(prose), int(good)


def test_bad_passages_decide_and_held_out_labels(spark, documents):
    rows = list(texts())
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, quality int")
    model = mil.train(docs, labels, "quality")
    got = {r.doc_id: r.score for r in mil.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i % 4 == 0]) >= 0.95
    again = mil.train(docs.repartition(7), labels.repartition(5), "quality")
    assert all(np.array_equal(again.weights[k], v) for k, v in model.weights.items())


def loss(model, x, starts, y):
    s = model.forward(x, starts)["s"]
    return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))


def test_gradient_against_differences():
    draw = np.random.default_rng(0)
    bags = [draw.normal(size=(k, mil.N_FEATURES)).astype(np.float32) for k in (1, 3, 2, 4)]
    y, starts, x = np.array([0, 1, 1, 0]), np.array([0, 1, 4, 6]), np.concatenate(bags).astype(float)
    model = mil.learn(bags, y, mil.Fit(steps=5, decay=0))
    slopes, step = mil.gradient(model, x, starts, y), 1e-6
    for name, weight in model.weights.items():
        for at in np.ndindex(weight.shape):
            was = weight[at]
            weight[at] = was + step
            above = loss(model, x, starts, y)
            weight[at] = was - step
            below = loss(model, x, starts, y)
            weight[at] = was
            assert abs((above - below) / (2 * step) - slopes[name][at]) < 1e-7, (name, at)
    first = mil.learn(bags, y, mil.Fit(steps=1, rate=0.0, decay=0))
    after = mil.learn(bags, y, mil.Fit(steps=60, decay=0))
    assert loss(after, x, starts, y) < 0.2 * loss(first, x, starts, y)


def plain_score(text, model):
    """The forward pass of one text in plain loops over its passages of 64 words."""
    p = model.weights
    words = text.split()
    parts = [" ".join(words[i:i + mil.PASSAGE]) for i in range(0, len(words), mil.PASSAGE)] or [""]
    hidden, attention = [], []
    for part in parts:
        x = np.clip((features(part) - model.mean) / model.scale, -8, 8)
        h = [np.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))]
        gated = [
            np.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h))))
            / (1 + np.exp(-sum(h[i] * p["U"][i, j] for i in range(len(h))))) for j in range(len(p["w"]))]
        hidden.append(h)
        attention.append(sum(a * w for a, w in zip(gated, p["w"])))
    weights = [np.exp(a) for a in attention]
    z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(len(p["c"]))]
    return 1 / (1 + np.exp(-(sum(a * c for a, c in zip(z, p["c"])) + p["d"][0])))


def features(part):
    """What a passage looks like, from its words; single spaces between them, one at the end."""
    if not part:
        return np.zeros(mil.N_FEATURES)
    words, data = part.split(" "), (part + " ").encode()
    counts = [0] * (mil.N_FEATURES - 6)
    for byte in data:
        counts[mil._CLASS[byte]] += 1
    size = [len(w.encode()) for w in words]
    mean = sum(size) / len(size)
    return np.array([c / len(data) for c in counts] + [
        (len(words) - len(set(words))) / len(words),
        sum(a == b for a, b in zip(words, words[1:])) / len(words),
        mean / 10, (sum(n * n for n in size) / len(size) - mean ** 2) ** 0.5 / 10,
        len(words) / mil.PASSAGE, sum(n <= 2 for n in size) / len(size)], np.float32)


def test_scores_equal_a_plain_forward_pass(spark, documents):
    rows = [(i, " ".join(t.split()), y) for i, t, y in texts(60)]
    model = mil.train(
        documents([(i, t) for i, t, _ in rows]),
        spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), "quality",
        mil.Fit(steps=20))
    more = ["", "one", "aa bb aa aa " * 700 + "!! 12", "é 日本 😀 | x"]
    every = [t for _, t, _ in rows] + [" ".join(t.split()) for t in more]
    got = {r.doc_id: r.score for r in mil.score(documents(list(enumerate(every))), model).collect()}
    for i, text in enumerate(every):
        assert abs(got[i] - plain_score(text, model)) < 1e-5, text[:50]


def test_all_passages_of_a_long_text_are_learned(spark, documents):
    good = "some plain words of a long text and again others " * 7
    rows = [(i, (good * 60 + ("spam " * 64 if i % 2 else "") + good * 60)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    learn, mil.learn = mil.learn, lambda bags, y, fit: seen.extend(bags) or learn(bags, y, fit)
    try:
        mil.train(documents(rows), labels, "quality", mil.Fit(steps=1))
    finally:
        mil.learn = learn
    assert sorted(len(b) for b in seen) == sorted(-(-len(t.split()) // mil.PASSAGE) for _, t in rows)


def test_features_do_not_depend_on_the_batch(monkeypatch):
    some = [t.encode() for _, t, _ in texts(20)] + [b"", b" ", "é 日本 😀".encode(), b"x" * 3000, b"word " * 900]
    whole, owner = mil.passages(some)
    alone = [mil.passages([t])[0] for t in some]
    assert np.array_equal(whole, np.concatenate(alone))
    assert list(np.bincount(owner, minlength=len(some))) == [len(a) for a in alone]
    assert len(alone[-1]) == 15 and not alone[20].any()
    monkeypatch.setattr(mil, "BLOCK", 500)
    cut, owner = mil.passages(some)
    assert set(owner) == set(range(len(some)))
    assert np.array_equal(cut, np.concatenate([mil.passages([t])[0] for t in some]))


def test_odd_rows_and_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in mil.score(odd, mil.train(odd, none, "quality")).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in mil.score(odd, mil.train(odd, one, "quality")).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    model = mil.train(odd.withColumn("k", F.lit(1)).withColumn("y", F.lit(2)), both, "quality")
    rows = mil.score(odd.withColumn("s", F.lit(0)), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert mil.score(odd.limit(0), model).collect() == []


def test_score_takes_the_place_of_an_old_one(spark, odd):
    labels = odd.sparkSession.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    model = mil.train(odd, labels, "quality", mil.Fit())
    key = lambda r: str(tuple(r))
    got = mil.score(odd.selectExpr("doc_id", "text", "'old' AS Score"), model)
    assert got.columns == ["doc_id", "text", "score"]
    assert sorted(got.collect(), key=key) == sorted(
        mil.score(odd.select("doc_id", "text"), model).collect(), key=key)
