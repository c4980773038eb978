import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from askframe.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_are_the_ranks_own(plain, text):
    codec = bpe.codec(PATH, P.PATTERN)
    ids, spans = codec.encode_offsets(text)
    assert ids == codec.encode(text) == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    assert all(0 <= a < b <= len(text) for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)


def test_long_texts_are_cut_between_pieces(plain, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    text = "Words, 123 numbers  and\n\n spaces　! " * 20
    assert bpe.codec(PATH, P.PATTERN).encode(text) == plain.encode_ordinary(text)


def test_columns_and_odd_rows(spark, odd, plain):
    done = bpe.encode(odd.withColumnRenamed("lang", "ids_"), PATH, P.PATTERN, offsets="spans")
    back = bpe.decode(done, PATH, P.PATTERN)
    rows = back.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == plain.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "")
        assert len(r.spans) == len(r.ids)
    for r in bpe.token_digests(odd, PATH, P.PATTERN, keep=("doc_id", "text")).collect():
        ids = plain.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.token_digests(odd.limit(0), PATH, P.PATTERN).collect() == []


def test_characters_cut_between_tokens(spark):
    codec = bpe.codec(PATH, P.PATTERN)
    ids, spans = codec.encode_offsets("\U000132af")  # a rare character of four bytes
    assert len(ids) > 1 and set(spans) == {(0, 1)}
    df = spark.createDataFrame([(ids,), (ids[:1],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH, P.PATTERN).collect()] == ["\U000132af", "�", ""]


def test_new_columns_take_the_place_of_old_ones(spark, odd, plain):
    given_ = odd.selectExpr("doc_id", "text", "1 AS IDS", "'x' AS spans", "2 AS decoded")
    done = bpe.encode(given_, PATH, P.PATTERN, offsets="spans")
    assert done.columns == ["doc_id", "text", "decoded", "ids", "spans"]
    back = bpe.decode(done, PATH, P.PATTERN)
    assert back.columns == ["doc_id", "text", "ids", "spans", "decoded"]
    for r in back.select("text", "ids", "decoded").collect():
        assert r.ids == plain.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    over = bpe.encode(odd.select("text"), PATH, P.PATTERN, ids="text")
    assert over.columns == ["text"] and over.count() == odd.count()
