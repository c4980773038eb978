"""Byte-level BPE: texts to ids and back, by the ranks of a public vocabulary file.

The merges are done by the ``tokenizers`` library. Its byte-level models work on characters, so
each byte stands as a printable character (the byte table); a piece's offsets count the characters
of the text, and decoding puts the byte table into reverse. A character of several bytes may be
split over tokens: ids are joined as bytes first and read as UTF-8 last.

Null and empty texts have no ids. Equal pieces are encoded once per worker and kept in a table of
at most ``KEPT_PIECES`` entries; beyond it the table starts anew, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from askframe.llm.common import arrow_columns

KEPT_PIECES = 150_000
#: Texts above this many code points are cut into pieces bit by bit, in bounded memory.
LONG_TEXT = 1_000_000
PIECES_AT_ONCE = 65_536


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of a token's bytes and its rank per line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Codec:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        ranks = read_ranks(path)
        table = byte_table()
        self.to_char = dict(enumerate(table))
        self.to_byte = {c: b for b, c in enumerate(table)}
        as_text = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        # A pair may merge wherever its bytes are a token: all cuts, in order of the result's rank.
        merges = [
            (as_text[token[:i]], as_text[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.model = models.BPE({as_text[t]: r for t, r in ranks.items()}, merges)
        self.bytes_of = {r: self.char_bytes(as_text[t]) for t, r in ranks.items()}
        self.number = {r: r for r in self.bytes_of}  # one object per id for all kept pieces
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, tuple[int, ...]] = {}

    def char_bytes(self, text: str) -> bytes:
        return bytes(map(self.to_byte.__getitem__, text))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length for long texts."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, PIECES_AT_ONCE)):
            yield some

    def merge(self, piece: str) -> tuple[int, ...]:
        mapped = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_char)
        return tuple(self.number[token.id] for token in self.model.tokenize(mapped))

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        seen = self.seen
        new = [p for p in set(pieces) if p not in seen]
        if len(seen) + len(new) > KEPT_PIECES:
            seen.clear()
            new = set(pieces)
        for piece in new:
            seen[piece] = self.merge(piece)
        return list(map(seen.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for pieces in self.pieces(text or ""):
            ids.extend(chain.from_iterable(self.ids_of(pieces)))
        return ids

    def encode_offsets(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the code points [from, to) of the text that each one touches.

        Tokens that share a character that is cut between them have it both.
        """
        ids, spans, start = [], [], 0
        for pieces in self.pieces(text or ""):
            for piece, own in zip(pieces, self.ids_of(pieces)):
                at = [i for i, c in enumerate(piece) for _ in c.encode("utf-8", "surrogatepass")]
                byte = 0
                for token in own:
                    end = byte + len(self.bytes_of[token])
                    spans.append((start + at[byte], start + at[end - 1] + 1))
                    byte = end
                ids += own
                start += len(piece)
        return ids, spans

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids. Ids outside the vocabulary raise ``KeyError``."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text",
           ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``df`` and the column ``ids`` (array<int>), on request ``offsets`` of code points.

    Null and empty texts give empty arrays; columns of ``df`` with the new names are replaced. A map without a shuffle; repeated rows stay.
    """
    where = df.columns.index(text)

    def make(batch: pa.RecordBatch) -> list:
        own = codec(path, pattern)
        texts = batch.column(where)
        if offsets is None:
            return [[own.encode(t.as_py()) for t in texts]]
        found = [own.encode_offsets(t.as_py()) for t in texts]
        return [[f[0] for f in found],
                [[{"start": a, "end": b} for a, b in f[1]] for f in found]]

    add = f"`{ids}` array<int>"
    if offsets is not None:
        add += f", `{offsets}` array<struct<start:int,end:int>>"
    return arrow_columns(df, df.columns, add, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids",
           text: str = "decoded", errors: str = "replace") -> DataFrame:
    """``df`` and the column ``text`` made of ``ids``; null ids give an empty text. A column of ``df`` named ``text`` is replaced.

    Ids are joined as bytes before they are read as UTF-8, so characters cut between tokens come
    out whole; bytes that are no UTF-8 become U+FFFD.
    """
    where = df.columns.index(ids)

    def make(batch: pa.RecordBatch) -> list:
        own = codec(path, pattern)
        return [[own.decode(i.as_py() or []).decode("utf-8", errors) for i in batch.column(where)]]

    return arrow_columns(df, df.columns, f"`{text}` string", make)


def token_digests(df: DataFrame, path: str, pattern: str, text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and, per row, the number of ids, the digest of the ids and of the decoded bytes.

    Encodes and decodes in the same task, so that the ids need not travel.
    """
    columns = [*keep, text] if text not in keep else list(keep)
    where = columns.index(text)

    def make(batch: pa.RecordBatch) -> list:
        own = codec(path, pattern)
        number = {i: str(i) for i in own.bytes_of}
        out: list[list] = [[], [], []]
        for t in batch.column(where):
            ids = own.encode(t.as_py())
            listed = ",".join(map(number.__getitem__, ids))
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(listed.encode()).hexdigest())
            out[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
        return out

    made = arrow_columns(df, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
    return made.select(*keep, "n_tokens", "ids_sha256", "decoded_sha256")
