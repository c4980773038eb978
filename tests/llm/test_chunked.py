import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from askframe.llm import chunked, skew

PATH = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.json")
PARTS = ["word", "Wörter", " ", "  ", "\n", "　", "'", "'ve", "don't", "é", "́", "日本",
         "<|endoftext|>", "<|start", "oftext|>", "12", "?!", "😀", "ſ", "İ", "Å", "\x00", " ", "a"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def wanted(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.fixture
def small(monkeypatch):
    """Chunks of a few bytes, so that short texts have many joins."""
    monkeypatch.setattr(chunked, "LEAST", 3)
    monkeypatch.setattr(chunked, "MOST", 40)
    monkeypatch.setattr(chunked, "BITS", 3)


def by_chunks(coder, chunks):
    return coder.join(coder.codes(chunks))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.randoms(use_true_random=False))
def test_joins_equal_the_whole_text(plain, text, rnd):
    """Whatever the places of the cuts, and without ever giving up."""
    places = sorted(rnd.sample(range(len(text) + 1), min(len(text), rnd.randint(0, 6))))
    chunks = [text[a:b] for a, b in zip([0, *places], [*places, len(text)]) if a < b]
    coder = chunked.coder(PATH)
    ids = by_chunks(coder, chunks)
    assert ids is not None
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert coder.digests(ids) == wanted(plain, text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=120))
def test_any_text(plain, text):
    coder = chunked.coder(PATH)
    for n in (5, 17):
        chunks = [text[i:i + n] for i in range(0, len(text), n)]
        assert by_chunks(coder, chunks).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rnd = random.Random(1)
    words = [("w%04d" % rnd.randrange(9000)) for _ in range(3000)]
    passage = " ".join(words)
    a = chunked.chunks_of("one start " + passage)
    b = chunked.chunks_of("quite another start, much longer " * 9 + passage + " and an end")
    assert "".join(a) == "one start " + passage
    assert all(chunked.LEAST <= len(c.encode()) <= chunked.MOST + 3 for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert "".join(chunked.chunks_of("é日😀" * 5000)) == "é日😀" * 5000
    assert chunked.chunks_of("") == []


def test_blocks_do_not_move_cuts(monkeypatch):
    rnd = random.Random(2)
    text = "".join(chr(rnd.randrange(32, 500)) for _ in range(20_000))
    whole = chunked.chunks_of(text)
    monkeypatch.setattr(chunked, "BLOCK", 100)
    assert chunked.chunks_of(text) == whole


def test_shared_chunks_travel_and_the_rest_stays(spark):
    """Texts of their own are done where they are; chunks of several texts are sent once per task."""
    passage = " ".join(f"shared{i}" for i in range(900))
    texts = spark.createDataFrame(
        [(f"start {i} " * (i % 40) + passage,) for i in range(200)]
        + [(" ".join(f"own{i}w{j}" for j in range(200)),) for i in range(50)], "text string").repartition(4)
    repeated, total = skew.repeated_keys(chunked.chunk_places(texts), ["chunk"])
    rows = chunked.text_parts(texts, PATH, chunked.bit_table(repeated)).collect()
    done = [r for r in rows if r.n_tokens is not None]
    sent = [r for r in rows if r.text is not None]
    places = [r for r in rows if r.chunk is not None and r.seq is not None]
    assert 50 <= len(done) <= 52
    assert {r.chunk for r in sent} == {r.chunk for r in places} == {r.chunk for r in repeated.collect()}
    assert len(sent) <= 4 * repeated.count() and len(places) > 150 * 10
    assert total > len(places)


def test_full_bit_table_changes_no_result(spark, odd, plain, monkeypatch):
    """All chunks travel then."""
    monkeypatch.setattr(chunked, "bit_table", lambda repeated: b"\xff" * (1 << chunked.FILTER - 3))
    for r in chunked.token_digests(odd, PATH, keep=("doc_id", "text")).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(plain, r.text)


@pytest.mark.parametrize("shares", [4096, 4])
def test_columns_and_odd_rows(spark, odd, plain, small, monkeypatch, shares):
    monkeypatch.setattr(skew, "SHARES", shares)
    many = spark.createDataFrame(
        [(100 + i, ("Copied text's passage don't end " * 30 if i % 3 else f"own {i} text " * 20),
          "en", "s", 1) for i in range(120)], odd.schema).repartition(5)
    docs = odd.unionByName(many).withColumnRenamed("lang", "t1").withColumnRenamed("source", "salts")
    found = chunked.token_digests(docs, PATH, keep=("doc_id", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(plain, r.text)
    assert chunked.token_digests(docs.limit(0), PATH).collect() == []
    assert sorted(r.doc_id or -1 for r in found) == sorted(r.doc_id or -1 for r in docs.collect())


def test_latin_pieces_are_the_librarys_own(plain):
    """Every character of the piece path beside letters, digits, spaces and itself."""
    coder = chunked.coder(PATH)
    assert coder.pieces is not None
    for c in map(chr, range(0x250)):
        text = f"a{c} B{c}{c}1 {c}  {c}'{c}É \n{c}'S{c}"
        for t in (text, text + "<|endoftext|>", text + "日"):
            assert list(coder.encode_all([t])[0]) == plain.encode(t, add_special_tokens=False).ids


def test_whole_texts(spark, odd, plain):
    texts = odd.select("text").where("length(text) > 0")
    keyed = texts.select("text", *chunked.text_key(texts["text"])).distinct()
    want = {tuple(r[:2]): wanted(plain, r[2]) for r in keyed.select("t1", "t2", "text").collect()}
    assert {tuple(r[:2]): tuple(r[2:]) for r in chunked.whole_texts(keyed, PATH).collect()} == want


def test_another_tokenizer_with_a_decoder(spark, documents):
    """Tokens that begin with their space: no chunk has an end of its own, windows grow to the text."""
    other = Tokenizer.from_file(BYTES)
    text = " ".join(f"word{i} and so on" for i in range(400))
    df = documents([(1, text), (2, text + " end"), (3, "x")])
    assert all(code[1] for code in chunked.coder(BYTES).codes([text[:999], text[999:]]))
    for r in chunked.token_digests(df, BYTES, keep=("doc_id", "text")).collect():
        assert r.n_tokens == len(other.encode(r.text, add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
