import random
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from askframe.llm import mixing


def test_targets():
    mix = mixing.Mix()
    assert mixing.targets({}, mix) == {}
    assert mixing.targets({"a": 0, None: 0}, mix) == {"a": 0.0, None: 0.0}
    got = mixing.targets({"b": 100, "a": 100, None: 100}, mix)
    # 450 words by weights 3, 1, 2: a would have 225, stops at 200, and 250 are shared as 1 to 2.
    assert got == {"a": 200.0, "b": 250 / 3, None: 500 / 3}
    sizes = {f"s{i}": n for i, n in enumerate([10, 500, 70, 3, 900, 40])}
    got = mixing.targets(sizes, mix)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes.items())


def cost(flow, distinct, repeats=2):
    """Words beyond the first, second ... taking of a pattern's distinct words, by step."""
    total = defaultdict(int)
    for (p, _), words in flow.items():
        total[p] += words
    return sum(max(0, words - distinct[p] * k) for p, words in total.items() for k in range(1, repeats + 1))


def test_route_is_cheapest():
    cells = {(0, "a"): 2, (1, "a"): 2, (1, "b"): 2, (2, "b"): 1}
    distinct, quota = {0: 2, 1: 2, 2: 1}, {"a": 4, "b": 3}
    flow = mixing.route(cells, distinct, quota, 2)
    for s, words in quota.items():
        assert sum(v for (_, t), v in flow.items() if t == s) == words
    best = min(
        cost(dict(zip(cells, given)), distinct)
        for given in product(*[range(2 * n + 1) for n in cells.values()])
        if all(sum(v for (_, t), v in zip(cells, given) if t == s) == w for s, w in quota.items()))
    assert cost(flow, distinct) == best


def mixed(documents, n=900):
    draw = random.Random(6)
    shared = ["shared passage number %d with words" % i for i in range(20)]
    rows = []
    for i in range(n):
        text = draw.choice(shared) if draw.random() < 0.3 else " ".join(
            f"w{draw.randrange(99)}" for _ in range(draw.randrange(0, 60)))
        source = "hot" if draw.random() < 0.34 else draw.choice(["a", "b", "c", None])
        rows.append((i, text, "en", source, len(text)))
    return documents(rows), rows


def test_mix_meets_targets_and_repeats(spark, documents):
    docs, rows = mixed(documents)
    got = mixing.mix_documents(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[3] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.size == len(text[r.doc_id].split())
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert len(got) == len(rows)
    want = mixing.targets(dict(sizes), mixing.Mix())
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60
    assert all(r.source_size == sizes[source[r.doc_id]] for r in got)
    again = mixing.mix_documents(docs.repartition(11)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def plain_mix(spark, rows, mix):
    """The mix by plain loops; only the hashes come from Spark. Rows: (doc_id, text, source)."""
    made = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    hashed = made.select(
        "*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("t2"),
    ).select("*", F.xxhash64("t1", "t2", F.lit(mix.seed)).alias("ht"),
             F.xxhash64("doc_id", F.lit(mix.seed)).alias("hd")).collect()

    def turn(h):
        return h % (1 << 64)

    name = {None: ""}
    texts, once, order = defaultdict(lambda: defaultdict(list)), {}, {}
    for r in hashed:
        t = r.text or ""
        texts[t][name.get(r.source, "=" + (r.source or ""))].append((turn(r.hd), r.doc_id))
        once[t], order[t] = len(t.split()), turn(r.ht)
    pattern = {t: tuple(sorted(by)) for t, by in texts.items()}
    ids = {p: made.select(F.xxhash64(F.array(*[F.lit(s) for s in p]))).first()[0] for p in set(pattern.values())}
    groups = defaultdict(list)
    for t, by in texts.items():
        for s, copies in by.items():
            groups[ids[pattern[t]], s].append((len(copies), t))
    cells = {c: sum(k * once[t] for k, t in g) for c, g in sorted(groups.items())}
    distinct = {p: sum(once[t] for _, t in groups[p, s]) for p, s in cells}
    sizes = defaultdict(int)
    for (_, s), words in cells.items():
        sizes[s] += words
    target = mixing.targets({s[1:] if s else None: n for s, n in sizes.items()}, mix)
    quota = {s: round(target[s[1:] if s else None]) for s in sizes}
    flow = mixing.route(cells, distinct, quota, mix.repeats)
    home = {s: max((c for c in cells if c[1] == s), key=lambda c: (cells[c], -c[0])) for s in sizes}
    ring, start = defaultdict(int), {}
    for p, s in cells:
        start[p, s] = ring[p]
        ring[p] += flow[p, s] if flow[p, s] < mix.repeats * distinct[p] else 0
    times, given = {}, defaultdict(int)
    for c in sorted(cells, key=lambda c: c == home[c[1]]):
        left, layer = flow[c], 0
        if c == home[c[1]]:
            left = max(0, min(mix.repeats * cells[c], quota[c[1]] - given[c[1]]))
        for _, t in groups[c]:
            times[t, c[1]] = 0
        while True:  # layer by layer
            layer += 1
            able = sorted((order[t], t) for k, t in groups[c] if mix.repeats * k >= layer)
            width = sum(once[t] for _, t in able)
            at = 0
            for _, t in able:
                at += once[t]
                if left >= width or (2 * at - once[t] - 2 * start[c]) % (2 * width) < 2 * left:
                    times[t, c[1]] += 1
            if left <= width or not able:
                break
            left -= width
        given[c[1]] += sum(times[t, c[1]] * once[t] for _, t in groups[c])
    out = []
    for t, by in texts.items():
        for s, copies in by.items():
            each, more = divmod(times[t, s], len(copies))
            out += [(i, once[t], once[t] * (each + (n < more))) for n, (_, i) in enumerate(sorted(copies))]
    return out


def test_layers():
    assert mixing.layers([(1, 10), (3, 4)], 0, 2) == (0, 1, 0, 14)
    assert mixing.layers([(1, 10), (3, 4)], 17, 2) == (1, 1, 3, 14)
    assert mixing.layers([(3, 4), (1, 10)], 28 + 9, 2) == (4, 3, 1, 4)
    assert mixing.layers([(1, 10), (3, 4)], 28 + 16, 2) == (6, 0, 0, 0)
    assert mixing.layers([(5, 0)], 0, 2) == (10, 0, 0, 0)


def test_equals_a_plain_mix(spark, documents):
    docs, rows = mixed(documents, 700)
    for mix in (mixing.Mix(), mixing.Mix(weights=(1, 5), share=0.7, repeats=3, seed=7)):
        got = sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_documents(docs, mix).collect())
        assert got == sorted(plain_mix(spark, [(r[0], r[1], r[3]) for r in rows], mix))


def test_no_text_comes_twice_before_all_came_once(documents):
    words = [f"{a} {a}{i} of it" for i, a in enumerate("xyz" * 200)]
    rows = [(2 * i + k, w, "en", s, 1) for i, w in enumerate(words) for k, s in enumerate("ab")]
    for share in (0.5, 1.0):
        times = defaultdict(int)
        got = mixing.mix_documents(documents(rows), mixing.Mix(weights=(1,), share=share))
        for r in got.collect():
            times[r.doc_id // 2] += r.taken // r.size
        assert sorted(times.values()) == [int(2 * share)] * 600


def test_copies_share_the_takings_of_their_text(documents):
    rows = [(i, "one text with copies", "en", "a", 1) for i in range(50)]
    rows += [(None, "one text with copies", "en", "a", 1)] * 30
    got = mixing.mix_documents(documents(rows), mixing.Mix(share=1.25)).collect()
    assert len(got) == 80 and sum(r.taken for r in got) == 100 * 4
    assert sorted(r.taken for r in got) == [4] * 60 + [8] * 20


def test_refuses_more_than_it_can_route(documents):
    docs, _ = mixed(documents, 60)
    for mix in (mixing.Mix(sources=2), mixing.Mix(cells=3)):
        try:
            mixing.mix_documents(docs, mix)
        except ValueError as error:
            assert "join sources first" in str(error)
        else:
            raise AssertionError("not refused")


def test_odd_rows(spark, odd):
    got = mixing.mix_documents(odd.withColumn("s", F.lit(1)).withColumn("p", F.lit(2))).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.taken for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix_documents(odd.limit(0)).collect() == []
    empty = mixing.mix_documents(odd.where("doc_id in (2, 3, 4)")).collect()
    assert {(r.size, r.target, r.taken) for r in empty} == {(0, 0.0, 0)}
