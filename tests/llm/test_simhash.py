import random
import re

import xxhash
from pyspark.sql import functions as F

from askframe.llm import simhash
from test_components import plain


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(values):
    values = sorted(set(values))
    edges = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    return {v: plain(edges).get(v, v) for v in values}


def groups(of):
    out = {}
    for value, root in of.items():
        out.setdefault(root, set()).add(value)
    return {frozenset(g) for g in out.values()}


def test_fingerprint_of_texts(monkeypatch):
    draw = random.Random(1)
    texts = ["", None, " \n", "One", "one TWO", "É é\x0bÀ x", "a b c " * 50] + [
        " ".join(draw.choice(["Alpha", "beta", "γ", "delta", "e"]) for _ in range(draw.randrange(40)))
        for _ in range(60)]
    for chunk in (65_536, 3):
        monkeypatch.setattr(simhash, "AT_ONCE", chunk)
        assert [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts] == [fingerprint(t) for t in texts]


def test_links_equal_brute_force(spark):
    draw = random.Random(2)
    values = [draw.getrandbits(64) for _ in range(80)] + [0, (1 << 64) - 1, 7, 1 << 63, 0b1111]
    for v in list(values):  # neighbours at every distance from 1 to 5, in every kind of segment
        for d in range(1, 6):
            flips = draw.sample(range(64), d)
            values.append(v ^ sum(1 << f for f in flips))
    dense = draw.getrandbits(64)
    values += [dense ^ sum(1 << f for f in draw.sample(range(64), draw.randrange(4))) for _ in range(150)]
    df = spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fp long").repartition(4)
    got = {r.fp & (1 << 64) - 1: r.root for r in simhash.linked_groups(df).collect()}
    assert groups(got) == groups(linked(values))


def test_documents(spark, documents):
    draw = random.Random(4)
    base = [" ".join(f"w{draw.randrange(500)}" for _ in range(120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("w1 ", "W1 ").upper()) for i, t in enumerate(base)]
    rows += [(200 + i, t + " end") for i, t in enumerate(base)]
    rows += [(300, ""), (301, None), (302, base[0]), (302, base[0])] + [(400 + i, base[3]) for i in range(60)]
    got = simhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    of = linked([fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        root = of[fingerprint(t)]
        least[root] = min(least.get(root, i), i)
    text = dict(rows)
    for r in got:
        assert r.fingerprint == f"{fingerprint(text[r.doc_id]):016x}"
        assert r.component_id == least[of[fingerprint(text[r.doc_id])]]
    kept = simhash.one_per_group(documents(rows).withColumn("component_id", F.lit("mine")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns[-1] == "component_id"


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd.withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
    kept = simhash.one_per_group(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 5, 6, 7]
    assert [r.text for r in kept if r.doc_id is None] == ["a row without an id"]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def test_one_row_of_each_component(spark, documents):
    """Repeated and null ids: rows are known by their component, not by their id."""
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(90)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[0]), (2, texts[0] + " end"),
            (None, texts[2]), (None, texts[2]), (3, texts[3]), (None, texts[3] + " end"), (4, texts[4])]
    of = linked([fingerprint(t) for _, t in rows])
    got = [(r.doc_id, r.text) for r in simhash.one_per_group(documents(rows)).collect()]
    assert len(got) == len({of[fingerprint(t)] for _, t in got}) == 5
    assert sorted(got, key=str) == sorted(
        [(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3]), (4, texts[4])], key=str)
