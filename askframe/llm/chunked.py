"""BPE of texts by chunks that documents share.

A rolling hash over the bytes cuts every text where its content says so, so that equal passages in
different texts give equal chunks. A first pass counts the chunks. A chunk that comes more than
once is encoded once, and its ids go to the texts that hold it; what lies between such chunks is
encoded where the text is, and a text without any is done there. What the first and last words of a
chunk become depends on its neighbours, so at every join the last words of the one and the first of
the next are encoded again as one window. The window must agree with both in a whole word at its
ends; from there on their ids hold. A chunk without enough words belongs to the window as a whole,
which so grows until both ends agree. Texts with a join that finds no agreement are encoded whole.

Tasks know which chunks come more than once from a bit table of ``FILTER`` bits in all, broadcast: a
bound that does not grow. Where two chunks share a bit, one that comes once travels like a shared
one, which costs a shuffle of it and changes no result.

Texts are known by a hash of 128 bits, chunks by another; equal texts are encoded as one.
Null and empty texts have no ids. All rows come back, repeated rows and null ids as often as they are
there; other columns are not read. A chunk or a text that a third of all rows hold is spread over
salts: at most ``skew.SHARES`` such keys exist, which bounds the broadcast tables.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.bpe import byte_table
from askframe.llm.common import arrow_rows, col, kept
from askframe.llm.skew import hot_keys, repeated_keys

#: Bytes of a chunk: least, most, and the bits of the hash that must be zero (512 on average).
LEAST, MOST, BITS = 128, 4096, 9
#: Bytes hashed at once, and the bytes that the hash looks back.
BLOCK, WINDOW = 1 << 22, 32
#: Texts and chunks that a task remembers having sent. Beyond it the memory starts anew and some
#: are sent again, which changes no result.
REMEMBERED = 200_000

#: A word's first character after plain white space: nothing is merged or normalised across it.
_WORD = re.compile(r"(?<=[ \t\n\r])\S")
#: Different pieces that a worker keeps the ids of.
KEPT_PIECES = 150_000
_OTHER = regex.compile("[^\x00-\u024f]")
#: Steps of a tokenizer file that go piece by piece.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"}]}
_TO_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], np.uint32)

#: Bits of the table of chunks that come more than once, as a power of two (16 MB).
FILTER = 27
#: Texts that are encoded at once, and their characters.
SLICE, CHARACTERS = 256, 1 << 20

_REFS = "chunk binary, t1 long, t2 long, seq int"
_CODES = ("t1 long, t2 long, seq int, ids binary, whole boolean, head string, head_n int, "
          "head_own int, tail string, tail_n int, tail_own int")
_PARTS = ("chunk binary, text string, " + _CODES
          + ", n_tokens long, ids_sha256 string, decoded_sha256 string")
_DONE = "t1 long, t2 long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions after which the last ``WINDOW`` bytes hash to zero in the highest bits."""
    found = []
    for start in range(0, len(data), BLOCK):
        low = max(0, start - WINDOW + 1)
        h = _GEAR[data[low:start + BLOCK]]
        step = 1
        while step < WINDOW:  # sums over 1, 2, 4 ... bytes, each shifted by its distance
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h, step = longer, 2 * step
        at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + low + 1
        found.append(at[at > start])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def spans(data: np.ndarray, places: list[int], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The chunks of the text at [start, end), cut between characters."""
    while start < end:
        i = bisect_left(places, start + LEAST)
        to = min(places[i] if i < len(places) else end, start + MOST, end)
        while to < end and data[to] & 0xC0 == 0x80:
            to += 1
        yield start, to
        start = to


def chunks_of(text: str) -> list[str]:
    """The chunks of one text."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    places = cut_places(data).tolist()
    return [raw[a:b].decode() for a, b in spans(data, places, 0, len(raw))]


class Coder:
    """A tokenizer, the chunks' codes and their joins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.number = [str(i) for i in range(size)]
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]

        made = json.loads(self.tokenizer.to_str())
        #: The pieces of lower-cased texts, if that is how the file cuts them.
        self.pieces = None
        split = made["pre_tokenizer"] or {}
        if made["normalizer"] == _NORMALIZER and split.get("pretokenizers", [{}])[1:] == [_TO_BYTES]:
            first = split["pretokenizers"][0]
            if (first["type"], first["behavior"], first["invert"]) == ("Split", "Removed", True):
                self.pieces = regex.compile(first["pattern"]["Regex"])
        self.added = [t["content"] for t in made["added_tokens"]]
        self.seen: dict[str, tuple[int, ...]] = {}
        self.to_char = dict(enumerate(byte_table()))

    def ids_of(self, pieces: list[str]) -> list[int]:
        """The ids of pieces; each different one is merged once."""
        seen = self.seen
        try:
            return list(chain.from_iterable(map(seen.__getitem__, pieces)))
        except KeyError:
            pass
        new = [p for p in set(pieces) if p not in seen]
        if len(seen) + len(new) > KEPT_PIECES:
            seen.clear()
            new = set(pieces)
        for piece in new:
            mapped = piece.encode().decode("latin-1").translate(self.to_char)
            seen[piece] = tuple([t.id for t in self.tokenizer.model.tokenize(mapped)])
        return list(chain.from_iterable(map(seen.__getitem__, pieces)))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts. Texts of Latin letters alone, without special tokens, go piece
        by piece: these letters are in normal form, and which of them are letters is fixed."""
        rest = [i for i, t in enumerate(texts)
                if self.pieces is None or _OTHER.search(t) or any(a in t for a in self.added)]
        found = dict(zip(rest, self.tokenizer.encode_batch(
            [texts[i] for i in rest], add_special_tokens=False)))
        return [found[i].ids if i in found else self.ids_of(self.pieces.findall(t.lower()))
                for i, t in enumerate(texts)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def codes(self, texts: list[str]) -> list[tuple]:
        """Of each chunk: ids, whether it is all edge, and its first and last words.

        ``head`` ends and ``tail`` starts between words. Of their ``head_n`` and ``tail_n`` ids the
        innermost ``head_own`` and ``tail_own`` are those of a word that lies in this chunk alone.
        """
        out = []
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        for text, one in zip(texts, found):
            ids = np.array(one.ids, self.type)
            words = [m.start() for m in _WORD.finditer(text)]
            ends = [*words[:2], *words[-2:]] if len(words) >= 3 else []
            at = [one.char_to_token(p) for p in ends]
            if not at or any(t is None or one.token_to_chars(t)[0] != p for t, p in zip(at, ends)):
                out.append((ids.tobytes(), True, text, 0, 0, "", 0, 0))
                continue
            out.append((
                ids.tobytes(), False, text[:ends[1]], at[1], at[1] - at[0],
                text[ends[2]:], len(ids) - at[2], at[3] - at[2]))
        return out

    def join(self, codes: list[tuple]) -> np.ndarray | None:
        """The ids of the text whose chunks have these codes, or None without agreement."""
        done: list[np.ndarray] = []
        window: list[str] = []  # text since the last agreement
        left = tail = None  # ids that the window must start with; ids of a lone tail
        for i, (raw, whole, head, head_n, head_own, end, end_n, end_own) in enumerate(codes):
            if whole:
                window.append(head)
                tail = None
                continue
            ids = np.frombuffer(raw, self.type)
            if i == 0:
                head_n = 0
            else:
                seam = self.encode("".join([*window, head]))
                if not _starts(seam, left) or not _ends(seam, ids[head_n - head_own:head_n]):
                    return None
                done.append(seam)
            cut = len(ids) - end_n
            done.append(ids[head_n:cut])
            tail, left, window = ids[cut:], ids[cut:cut + end_own], [end]
        if tail is not None:
            done.append(tail)
        elif window:
            seam = self.encode("".join(window))
            if not _starts(seam, left):
                return None
            done.append(seam)
        return np.concatenate(done) if done else np.empty(0, self.type)

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer.decoder is None:  # without a decoder tokens are joined by spaces
            return " ".join(map(self.token.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def digests(self, ids: np.ndarray | list[int]) -> tuple[int, str, str]:
        listed = ids if isinstance(ids, list) else ids.tolist()
        joined = " ".join(map(self.number.__getitem__, listed))
        return (len(listed), hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(self.decode(listed).encode()).hexdigest())


def _starts(ids: np.ndarray, wanted: np.ndarray | None) -> bool:
    return wanted is None or np.array_equal(ids[:len(wanted)], wanted)


def _ends(ids: np.ndarray, wanted: np.ndarray) -> bool:
    return np.array_equal(ids[len(ids) - len(wanted):], wanted)


@cache
def coder(path: str) -> Coder:
    """One coder per worker process."""
    return Coder(path)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text; null is the empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The bytes of all texts of a column, null as empty, and where each starts and ends."""
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[:at[-1] if len(at) else 0], at.tolist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, memoryview]]]]:
    """(t1, t2, chunks as key and bytes) of the texts of a task, equal texts once if they are near."""
    sent: set = set()
    for batch in batches:
        data, at = _bytes_of(batch.column(2))
        places, view = cut_places(data).tolist(), memoryview(data)
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for (t1, t2), start, end in zip(keys, at, at[1:]):
            if (t1, t2) in sent:
                continue
            if len(sent) >= REMEMBERED:
                sent.clear()
            sent.add((t1, t2))
            own = [view[a:b] for a, b in spans(data, places, start, end)]
            yield t1, t2, [(xxhash.xxh3_128_digest(c), c) for c in own]


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.select(*text_key(col("text")), col("text").alias("text"))


def chunk_places(texts: DataFrame) -> DataFrame:
    """Chunk ``chunk`` is number ``seq`` of the text (t1, t2) of the column ``text``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        out = []
        for t1, t2, chunks in _cut(batches):
            out += [(key, t1, t2, seq) for seq, (key, _) in enumerate(chunks)]
            if len(out) >= 20_000:
                yield out
                out = []
        yield out

    return arrow_rows(_keyed(texts), make, _REFS)


def bit_table(repeated: DataFrame) -> bytes:
    """One bit for the first ``FILTER`` bits of every key ``chunk``."""
    place = F.shiftright(F.conv(F.hex(F.substring("chunk", 1, 4)), 16, 10).cast("long"), 32 - FILTER)
    words = repeated.select(place.alias("place")).groupBy(
        F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")).toArrow()
    table = np.zeros(1 << FILTER - 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def text_parts(texts: DataFrame, path: str, bits: bytes) -> DataFrame:
    """What the tasks make of their texts (t1, t2), one of four kinds of rows:

    the digests of a text without repeated chunks; ``ids`` and the edges of what lies between
    repeated chunks, as part ``seq``; which repeated ``chunk`` is part ``seq``; its ``text``.
    """
    known = texts.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own, sent, table = coder(path), set(), known.value

        def repeated(key: bytes) -> bool:
            place = int.from_bytes(key[:4], "big") >> 32 - FILTER
            return table[place >> 3] >> (place & 7) & 1 == 1

        def coded(plain: list[tuple], between: list[tuple]) -> list[tuple]:
            found = own.encode_all([t for *_, t in plain])
            out = [(None, None, t1, t2, *[None] * 9, *own.digests(ids))
                   for (t1, t2, _), ids in zip(plain, found)]
            codes = own.codes([t for *_, t in between])
            return out + [(None, None, t1, t2, seq, *code, None, None, None)
                          for (t1, t2, seq, _), code in zip(between, codes)]

        plain, between, size, out = [], [], 0, []
        for t1, t2, chunks in _cut(batches):
            size += sum(len(c) for _, c in chunks)
            flags = [repeated(key) for key, _ in chunks]
            if not any(flags):
                plain.append((t1, t2, b"".join(c for _, c in chunks).decode()))
            else:
                rows = zip(flags, chunks)
                for seq, (shared, some) in enumerate(groupby(rows, itemgetter(0))):
                    some = [c for _, c in some]
                    if not shared:
                        between.append((t1, t2, seq << 16, b"".join(c for _, c in some).decode()))
                        continue
                    for i, (key, raw) in enumerate(some):
                        out.append((key, None, t1, t2, (seq << 16) + i, *[None] * 11))
                        if key not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(key)
                            out.append((key, bytes(raw).decode(), *[None] * 14))
            if len(plain) + len(between) >= SLICE or size >= CHARACTERS or len(out) >= 4096:
                yield out + coded(plain, between)
                plain, between, size, out = [], [], 0, []
        yield out + coded(plain, between)

    return arrow_rows(_keyed(texts), make, _PARTS)


def chunk_codes(refs: DataFrame, path: str) -> DataFrame:
    """One row per place of a chunk, with the code of the chunk, which is made once."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = coder(path)
        last, code = None, None  # the chunk at the end of the batch before
        for batch in batches:
            rows = batch.to_pydict()
            new: dict[bytes, str] = {}
            for key, text in zip(rows["chunk"], rows["text"]):
                if text is not None and key != last:
                    new.setdefault(key, text)
            known = dict(zip(new, own.codes(list(new.values()))))
            if last is not None:
                known[last] = code
            out = [
                (t1, t2, seq, *known[key])
                for key, t1, t2, seq in zip(rows["chunk"], rows["t1"], rows["t2"], rows["seq"])
                if seq is not None
            ]
            if rows["chunk"]:
                last = rows["chunk"][-1]
                code = known[last]
            for i in range(0, len(out), 4096):
                yield out[i:i + 4096]

    return arrow_rows(refs.select("chunk", "t1", "t2", "seq", "text"), make, _CODES)


def joined(codes: DataFrame, path: str) -> DataFrame:
    """Digests per text from its codes, which come in order; -1 tokens without agreement."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = coder(path)
        key, seq, parts = None, -1, []

        def finish() -> list[tuple]:
            if key is None:
                return []
            ids = own.join(parts)
            return [(*key, *(own.digests(ids) if ids is not None else (-1, "", "")))]

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for t1, t2, number, *code in zip(*columns):
                if (t1, t2) != key:
                    out += finish()
                    key, seq, parts = (t1, t2), -1, []
                if number != seq:  # tasks that saw the same text sent the same rows
                    seq = number
                    parts.append(tuple(code))
            yield out
        yield finish()

    return arrow_rows(codes, make, _DONE)


def whole_texts(texts: DataFrame, path: str) -> DataFrame:
    """Digests of texts that are encoded as they are."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = coder(path)
        for batch in batches:
            yield [(t1, t2, *own.digests(own.encode(text or "")))
                   for t1, t2, text in zip(*[c.to_pylist() for c in batch.columns])]

    return arrow_rows(texts.select("t1", "t2", "text"), make, _DONE)


def text_digests(texts: DataFrame, path: str) -> DataFrame:
    """Digests per distinct text of the column ``text``, without the empty one."""
    repeated, total = repeated_keys(chunk_places(texts), ["chunk"])
    hot = hot_keys(repeated, total)
    parts = kept(text_parts(texts, path, bit_table(repeated)), "chunked-parts")
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    one = F.array(F.coalesce(F.expr("pmod(xxhash64(t1, t2), salts)").cast("int"), F.lit(0)))
    refs = (
        parts.where("chunk IS NOT NULL").select("chunk", "t1", "t2", "seq", "text")
        .join(F.broadcast(hot), "chunk", "left")
        .withColumn("salt", F.explode(F.when(F.col("text").isNull(), one).otherwise(every)))
        .repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", F.col("text").isNull())
    )
    shared = chunk_codes(refs, path)
    codes = parts.where("ids IS NOT NULL").select(*shared.columns).unionByName(shared)
    dealt = codes.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "seq")
    columns = ["t1", "t2", "n_tokens", "ids_sha256", "decoded_sha256"]
    joins = kept(joined(dealt, path), "chunked-joins")
    # A text that several tasks saw is done as often.
    done = parts.where("n_tokens IS NOT NULL").select(*columns).unionByName(
        joins.where("n_tokens >= 0")).dropDuplicates(["t1", "t2"])
    lost = joins.where("n_tokens < 0").select("t1", "t2")
    if lost.isEmpty():
        return done
    again = _keyed(texts).join(lost, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    return done.unionByName(whole_texts(again, path))


def token_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and, per row, the number of ids, the digest of the ids and of the decoded text.

    ``path`` is the file of a tokenizer that never merges across white space between words.
    """
    done = text_digests(docs.where(F.length(col("text")) > 0), path)
    rows = docs.select(*[col(c) for c in keep], *text_key(col("text")))
    hot = hot_keys(*repeated_keys(rows, ["t1", "t2"]))
    order = [F.col(c) for c in keep[:1]] or [F.col("t1")]
    spread = (
        rows.join(F.broadcast(hot), ["t1", "t2"], "left")
        .withColumn("salt", F.coalesce(
            F.pmod(F.xxhash64(*order), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    )
    each = (
        done.join(F.broadcast(hot), ["t1", "t2"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return spread.join(each, ["t1", "t2", "salt"], "left").select(
        *[col(c) for c in keep], F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        F.coalesce("ids_sha256", nothing).alias("ids_sha256"),
        F.coalesce("decoded_sha256", nothing).alias("decoded_sha256"))
