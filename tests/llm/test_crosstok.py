import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from askframe.llm import crosstok
from askframe.llm.bpe import byte_table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(a, b, text):
    """Groups of (A ids, B ids), position by position."""
    if not text:
        return []
    back = {c: i for i, c in enumerate(byte_table())}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        raw_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return []
    out, left, right, pa, pb = [], [], [], 0, 0
    rest_a, rest_b = list(zip(ids_a, raw_a)), list(zip(ids_b, raw_b))
    while rest_a or rest_b:
        if pa <= pb:
            i, r = rest_a.pop(0)
            left.append(i)
            pa += len(r)
        else:
            i, r = rest_b.pop(0)
            right.append(i)
            pb += len(r)
        if pa == pb:
            out.append((left, right))
            left, right = [], []
    return out


def plain(texts):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    groups = [plain_groups(a, b, t) for t in texts]
    links = [Counter((x, y) for l, r in g for x in l for y in r) for g in groups]
    count = Counter(p for own in links for p in own)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for g, own in zip(groups, links):
        text = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in g)
        out.append((
            sum(len(l) for l, _ in g), sum(len(r) for _, r in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def check(docs):
    rows = docs.collect()
    texts = [r.text for r in rows]
    found = crosstok.token_links(docs, A, B).collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain(texts)))
    assert Counter((r.doc_id, *[r[c] for c in COLUMNS]) for r in found) == want


ODD = ["", None, "x", "<|endoftext|> <s> </s>", "▁ under", "a ▁", "  two  spaces\n\n\n\ttabs ", "\x00\x01",
       "日本語のテキスト" * 30, "😀👍🏽" * 40, "é" * 50, "naïve café", " " * 300, "aaaa" * 700, "\U000132af" * 9,
       "don't we'll", "1234567890" * 20, "﷽" * 60]


def test_equals_plain_version(spark, documents):
    words = "the quick brown fox, jumps over 12 lazy dogs; l'été naïve größe".split()
    rows = [(i, " ".join(words[(i * j) % len(words)] for j in range(1, 5 + i % 50))) for i in range(150)]
    rows += [(1000 + i, "one text that is copied, again and again") for i in range(80)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD)]
    check(documents(rows, 4).withColumnRenamed("lang", "block").withColumnRenamed("source", "keys"))


def test_odd_rows(spark, odd):
    check(odd)
    assert crosstok.token_links(odd.limit(0), A, B).collect() == []


def test_many_blocks_and_rounds(spark, documents, monkeypatch):
    """Places for several merges and ways back are planned by the driver; a text per task is a block."""
    monkeypatch.setattr(crosstok, "FAN", 3)
    monkeypatch.setattr(crosstok, "BACK", 2)
    rows = [(i, f"some words, number {i % 7} and {i % 3}. Again: some words") for i in range(40)]
    check(documents(rows, 20))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(ODD),
                          st.text(st.characters(exclude_categories=["Cs"]), max_size=40)), max_size=5))
def test_groups_and_records(texts):
    own = crosstok.pair(A, B)
    found = crosstok.Aligned(own, own.encode(texts))
    a, b = own.a, own.b
    for i, text in enumerate(texts):
        groups = plain_groups(a, b, text)
        assert found.n_groups[i] == len(groups)
        assert found.n_links[i] == sum(len(l) * len(r) for l, r in groups)
    keys, times = found.records(0)
    assert times.sum() == found.n_links.sum()
    assert len(set(keys.tolist())) == len(keys)


def test_wide_groups_give_the_same_records(monkeypatch):
    own = crosstok.pair(A, B)
    found = crosstok.Aligned(own, own.encode(["日本語のテキスト😀 naïve" * 5, "and more 😀"]))
    keys, times = found.records(3)
    monkeypatch.setattr(crosstok, "WIDE", 0)
    again = found.records(3)
    assert keys.tolist() == again[0].tolist() and times.tolist() == again[1].tolist()


@pytest.mark.parametrize("frame", [1, 4, 1000])
def test_merge_and_maxima(monkeypatch, frame):
    monkeypatch.setattr(crosstok, "FRAME", frame)
    rnd = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(9):
        n = int(rnd.integers(0, 60))
        pairs = np.sort((rnd.integers(0, 5, n) << crosstok._ID) | rnd.integers(0, 6, n))
        docs = np.arange(n)
        want.update(pairs.tolist())
        frames = [f[0] for f in crosstok._frames(pairs, docs, docs + 1)] if n else []
        runs.append(map(crosstok.unpack_keys, frames))
    top = {}
    for k, c in want.items():
        top[k >> crosstok._ID] = max(top.get(k >> crosstok._ID, 0), c)
    got = [x for keys, counts, best in crosstok._with_best(crosstok._bundles(crosstok.merge(runs)))
           for x in zip(keys.tolist(), counts.tolist(), best.tolist())]
    assert got == [(k, c, int(c == top[k >> crosstok._ID])) for k, c in sorted(want.items())]


def test_latin_pieces_are_the_librarys_own():
    """Every character of the piece path beside letters, digits, spaces and itself."""
    own = crosstok.pair(A, B)
    assert own.by_pieces
    for c in map(chr, range(0x250)):
        text = f"a{c} b{c}{c}1 {c}  {c}'{c}\u00e9 \n{c}"
        assert own.encode_a([text]) == [own.a.encode(text, add_special_tokens=False).ids]


def test_numbers_come_back():
    for values in ([], [0], [255, 256], [1 << 40, 5], list(range(1000))):
        got, _ = crosstok.unpack(crosstok.pack(np.array(values, np.int64)))
        assert got.tolist() == values
