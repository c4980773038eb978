"""Two tokenizers side by side: which tokens cover the same bytes, and how often in the corpus.

Both tokenizers' tokens are cut into groups where a token of each ends at the same byte. All pairs of
a token of A and one of B in a group are linked. How many documents hold a linked pair of ids is
counted by external sorting:

1. A task encodes documents up to a bounded block, makes (pair, document) records, sorts them by A
   id, B id and document, and writes them as zstd runs, one per radix of the A id.
2. The runs of a radix are merged, ``FAN`` at a time, through a heap of their current frames; equal
   pairs add up. Rounds go on until one run per radix is left. It is in the order of the A ids, so the
   highest count of an A id is known when its last pair has passed.
3. The counts of a radix stream past the runs of up to ``BACK`` blocks once more, in the same order;
   every block gets back two sums per document and radix. Those of all radixes are added up.

No task holds more than its runs (compressed), one frame of each, and the sums of their blocks: an
A id that a third of all records have makes its runs longer, never a task's number of runs larger.
Tables between the steps are written to the shared folder.

Null, empty and not losslessly encoded texts have no tokens: zeros and an empty digest. Rows with a
null or a repeated id are documents of their own. An empty table gives no rows. Columns other than
text and id are not read. Vocabularies may have up to 2^20 ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.bpe import byte_table
from askframe.llm.common import arrow_rows, col, kept

#: Radixes; records and documents of a block; keys or records of a frame.
RADIX, RECORDS, DOCUMENTS, FRAME = 64, 1 << 20, 8192, 4096
#: Runs that are merged at once, and blocks that get their counts back at once.
FAN, BACK = 256, 1024
#: How byte-level models split texts (a fixed value), and characters outside Latin script.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHER = regex.compile("[^\x00-\u024f]")
#: Different pieces that a worker keeps the ids of.
KEPT_PIECES = 150_000
#: Documents and characters that are encoded at once.
SLICE, CHARACTERS = 256, 1 << 20
#: Groups with more links than this are reduced to distinct ids before they are paired.
WIDE = 4096
_ID = 20  # bits of an id
_DOC = 64 - 6 - 2 * _ID  # what is left of 64 bits beside radix and pair


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes that compress well: narrow, lowest bytes first."""
    high = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if high < 1 << 8 * w)
    flat = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return struct.pack("<BI", width, len(values)) + flat.tobytes()


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    width, n = struct.unpack_from("<BI", data, at)
    at += 5
    flat = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
    return np.ascontiguousarray(flat).view(f"<u{width}").ravel().astype(np.int64), at + width * n


def pack_all(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(map(pack, columns)), 3)


def unpack_all(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        values, at = unpack(raw, at)
        out.append(values)
    return out


def pack_keys(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as steps, and columns beside them."""
    return pack_all(np.diff(keys, prepend=0), *columns)


def unpack_keys(data: bytes) -> list[np.ndarray]:
    steps, *columns = unpack_all(data)
    return [np.cumsum(steps), *columns]


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        #: Whether A is a byte-level model whose pieces are those of ``PIECES``, one by one.
        self.by_pieces = (
            made["normalizer"] is None and split.get("type") == "ByteLevel"
            and split["use_regex"] and not split["add_prefix_space"])
        self.seen: dict[str, tuple[int, ...]] = {}
        self.to_char = dict(enumerate(byte_table()))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = {c: bytes([i]) for i, c in enumerate(byte_table())}
        self.a_bytes = []
        for i in range(self.a.get_vocab_size()):
            token = self.a.id_to_token(i) or ""
            self.a_bytes.append(b"".join(to_byte.get(c, c.encode()) for c in token))
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i in range(self.b.get_piece_size()) for piece in [self.b.id_to_piece(i)]
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _ID:
            raise ValueError("vocabularies of more than 2^20 ids are not supported")
        self.a_len = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_len = np.array([len(b) for b in self.b_bytes], np.int64)
        # Texts of the digest: an id and what follows it inside and at the end of its side.
        self.texts = [f"{i}{end}" for size, ends in (
            (len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(size)]

    def ids_of(self, pieces: list[str]) -> list[int]:
        """The ids of A for its pieces; each different one is merged once."""
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
            seen[piece] = tuple([t.id for t in self.a.model.tokenize(mapped)])
        return list(chain.from_iterable(map(seen.__getitem__, pieces)))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """The ids of A. Texts of Latin letters alone go piece by piece; which characters are
        letters, digits or spaces is fixed there, elsewhere the library's own tables decide."""
        rest = [i for i, t in enumerate(texts) if not self.by_pieces or _OTHER.search(t)]
        found = dict(zip(rest, self.a.encode_batch_fast(
            [texts[i] for i in rest], add_special_tokens=False)))
        return [found[i].ids if i in found else self.ids_of(PIECES.findall(t))
                for i, t in enumerate(texts)]

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides per text; none where a side does not give the text back."""
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        first = self.encode_a(spaced)
        second = self.b.encode([texts[i] for i in some], num_threads=1)
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for i, text, a, b in zip(some, spaced, first, second):
            raw = text.encode()
            if (b"".join(map(self.a_bytes.__getitem__, a)) == raw
                    and b"".join(map(self.b_bytes.__getitem__, b)) == raw):
                out[i] = (a, b)
        return out


@cache
def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers per worker process."""
    return Pair(a_path, b_path)


class Aligned:
    """Texts of one slice, their groups and their links."""

    def __init__(self, own: Pair, encoded: list[tuple[list[int], list[int]]]):
        self.own = own
        self.n_a = np.array([len(a) for a, _ in encoded], np.int64)
        self.n_b = np.array([len(b) for _, b in encoded], np.int64)
        self.a = np.array(list(chain.from_iterable(a for a, _ in encoded)), np.int64)
        self.b = np.array(list(chain.from_iterable(b for _, b in encoded)), np.int64)
        # Both sides of every text have the same bytes, so positions may run through all texts.
        a_end, b_end = np.cumsum(own.a_len[self.a]), np.cumsum(own.b_len[self.b])
        common = a_end[b_end[np.searchsorted(b_end, a_end)] == a_end] if len(a_end) else a_end
        self.a_group = np.searchsorted(common, a_end)
        self.b_group = np.searchsorted(common, b_end)
        self.a_in = np.bincount(self.a_group, minlength=len(common))
        self.b_in = np.bincount(self.b_group, minlength=len(common))
        docs = np.arange(len(encoded))
        self.doc = np.empty(len(common), np.int64)
        self.doc[self.a_group] = np.repeat(docs, self.n_a)
        self.n_groups = np.bincount(self.doc, minlength=len(docs))
        self.n_links = _sums(self.doc, self.a_in * self.b_in, len(docs))

    def digests(self) -> list[str]:
        """Of each text its groups, as ids of A and B in order."""
        size_a, size_b = len(self.own.a_bytes), len(self.own.b_bytes)
        a_last = np.append(self.a_group[1:] != self.a_group[:-1], True)[:len(self.a)]
        b_last = np.append(self.b_group[1:] != self.b_group[:-1], True)[:len(self.b)]
        texts = np.concatenate([self.a + size_a * a_last, 2 * size_a + self.b + size_b * b_last])
        order = np.argsort(
            np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        listed, out, at = texts[order].tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            joined = "".join(map(self.own.texts.__getitem__, listed[at:at + n]))[:-1]
            out.append(hashlib.sha256(joined.encode()).hexdigest() if n else "")
            at += n
        return out

    def records(self, first_doc: int) -> tuple[np.ndarray, np.ndarray]:
        """(radix, A id, B id, document) in one number each, sorted, and how often they are linked."""
        narrow = self.a_in * self.b_in <= WIDE
        each = np.where(narrow, self.b_in, 0)[self.a_group]
        b_first = np.cumsum(self.b_in) - self.b_in
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        b = self.b[np.repeat(b_first[self.a_group], each) + inside]
        doc = np.repeat(self.doc[self.a_group], each) + first_doc
        keys, times = np.unique(_key(np.repeat(self.a, each), b, doc), return_counts=True)
        wide = np.flatnonzero(~narrow)
        if len(wide) == 0:
            return keys, times
        keys, times = [keys], [times]
        a_first = np.cumsum(self.a_in) - self.a_in
        for g in wide.tolist():
            a, a_times = np.unique(self.a[a_first[g]:a_first[g] + self.a_in[g]], return_counts=True)
            b, b_times = np.unique(self.b[b_first[g]:b_first[g] + self.b_in[g]], return_counts=True)
            keys.append(_key(np.repeat(a, len(b)), np.tile(b, len(a)),
                             np.full(len(a) * len(b), self.doc[g] + first_doc)))
            times.append(np.outer(a_times, b_times).ravel())
        return _summed(np.concatenate(keys), np.concatenate(times))


def _key(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    whole = [x.astype(np.uint64) for x in (a % RADIX, a, b, doc)]
    return ((whole[0] << np.uint64(2 * _ID + _DOC)) | (whole[1] << np.uint64(_ID + _DOC))
            | (whole[2] << np.uint64(_DOC)) | whole[3])


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(values, first) if len(first) else values


_BLOCKS = ("kind int, block binary, radix int, n_docs long, keys array<binary>, docs array<binary>, "
           "id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
           "n_links array<long>, groups_sha256 array<string>")


class Block:
    """Documents and records until they are written as runs."""

    def __init__(self):
        self.rows: list[list] = [[] for _ in range(6)]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, aligned: Aligned) -> None:
        self.parts.append(aligned.records(len(self.rows[0])))
        self.size += len(self.parts[-1][0])
        columns = (ids, aligned.n_a.tolist(), aligned.n_b.tolist(), aligned.n_groups.tolist(),
                   aligned.n_links.tolist(), aligned.digests())
        for have, new in zip(self.rows, columns):
            have += new

    def full(self) -> bool:
        return self.size >= RECORDS or len(self.rows[0]) + SLICE > DOCUMENTS

    def written(self) -> Iterator[tuple]:
        """The row of the documents and the rows of the runs."""
        name, n = uuid.uuid4().bytes, len(self.rows[0])
        if n == 0:
            return
        yield (0, name, None, n, None, None, *self.rows)
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.concatenate([t for _, t in self.parts])[order]
        radix = (keys >> np.uint64(2 * _ID + _DOC)).astype(np.int64)
        ends = np.searchsorted(radix, np.arange(RADIX), "right").tolist()
        pairs = ((keys >> np.uint64(_DOC)) & np.uint64((1 << 2 * _ID) - 1)).astype(np.int64)
        docs = (keys & np.uint64((1 << _DOC) - 1)).astype(np.int64)
        start = 0
        for r, end in enumerate(ends):
            if start < end:
                frames = list(_frames(pairs[start:end], docs[start:end], times[start:end]))
                yield (1, name, r, n, [f[0] for f in frames], [f[1] for f in frames], *[None] * 6)
            start = end


def _frames(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Runs in pieces of about ``FRAME`` records; the records of a pair stay together."""
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    ends = np.append(first[1:], len(pairs))
    cut = [0, *(np.flatnonzero(np.diff(ends // FRAME)) + 1).tolist(), len(first)]
    for lo, hi in zip(cut, cut[1:]):
        if lo < hi:
            at = slice(first[lo], ends[hi - 1])
            yield (pack_keys(pairs[first[lo:hi]], ends[lo:hi] - first[lo:hi]),
                   pack_all(docs[at], times[at]))


def blocks(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """Aligned documents by blocks (kind 0), and the runs of their records (kind 1)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own, block = pair(a_path, b_path), Block()
        for batch in batches:
            ids, texts = [c.to_pylist() for c in batch.columns]
            start = 0
            while start < len(ids):
                end, size = start, 0
                while end < len(ids) and end - start < SLICE and (end == start or size < CHARACTERS):
                    size += len(texts[end] or "")
                    end += 1
                block.add(ids[start:end], Aligned(own, own.encode(texts[start:end])))
                start = end
                if block.full():
                    yield from ([row] for row in block.written())
                    block = Block()
        yield from ([row] for row in block.written())

    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    return arrow_rows(docs.select(col(key), col("text")), make, _BLOCKS.format(id=kind))


def merge(runs: list[Iterator[list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) of sorted runs, whose frames are (keys, counts): a k-way merge.

    The heap knows how far the current frame of each run reaches. Up to the nearest of these ends
    every run has all it holds in its frame, so that these parts add up and leave.
    """
    heap, frame = [], {}

    def load(i: int) -> None:
        got = next(runs[i], None)
        if got is None:
            frame.pop(i, None)
        else:
            frame[i] = got
            heapq.heappush(heap, (int(got[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        reach = heap[0][0]
        keys, counts = [], []
        for i, (k, c) in frame.items():
            n = int(np.searchsorted(k, reach, "right"))
            if n:
                keys.append(k[:n])
                counts.append(c[:n])
                frame[i] = [k[n:], c[n:]]
        yield _summed(np.concatenate(keys), np.concatenate(counts))
        while heap and heap[0][0] == reach:
            load(heapq.heappop(heap)[1])


def _grouped(batches: Iterator[pa.RecordBatch], *by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches, grouped by the columns ``by``."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, itemgetter(*by))


def _bundles(
    merged: Iterator[tuple[np.ndarray, np.ndarray]]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a merge as frames of at least ``FRAME`` keys, but for the last."""
    keys, counts, size = [], [], 0
    for k, c in merged:
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size >= FRAME:
            yield np.concatenate(keys), np.concatenate(counts)
            keys, counts, size = [], [], 0
    if size:
        yield np.concatenate(keys), np.concatenate(counts)


def _with_best(
    merged: Iterator[tuple[np.ndarray, np.ndarray]]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marks the pairs that have the highest count of their A id; the last A id waits for its rest."""
    def marked(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = keys >> _ID
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(a))))
        return keys, counts, (counts == top).astype(np.int64)

    rest = (np.empty(0, np.int64), np.empty(0, np.int64))
    for keys, counts in merged:
        keys, counts = np.concatenate([rest[0], keys]), np.concatenate([rest[1], counts])
        open_at = int(np.searchsorted(keys, (keys[-1] >> _ID) << _ID))
        if open_at:
            yield marked(keys[:open_at], counts[:open_at])
        rest = keys[open_at:], counts[open_at:]
    if len(rest[0]):
        yield marked(*rest)


def _merged(runs: DataFrame, last: bool) -> DataFrame:
    """One run per (radix, place) of the runs (radix, place, run, no, keys); at last with maxima."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for (radix, place), rows in _grouped(batches, 0, 1):
            held = [[f for row in run for f in row[4]] for _, run in groupby(rows, itemgetter(2))]
            found = _bundles(merge([map(unpack_keys, frames) for frames in held]))
            for no, frame in enumerate(_with_best(found) if last else found):
                yield [(radix, place, no, [pack_keys(*frame)])]

    dealt = runs.select("radix", "place", "run", "no", "keys").repartition("radix", "place")
    return arrow_rows(
        dealt.sortWithinPartitions("radix", "place", "run", "no"), make,
        "radix int, place long, no int, keys array<binary>")


def pair_counts(runs: DataFrame, n_blocks: int) -> DataFrame:
    """(radix, no, keys): frames of all pairs with the number of documents and whether it is the
    highest of their A id, in order of the ids. ``runs`` are those of ``blocks``."""
    places = -(-n_blocks // FAN) or 1
    place = F.pmod(F.xxhash64("block"), F.lit(places))
    now = _merged(runs.select(
        "radix", place.alias("place"), F.col("block").alias("run"), F.lit(0).alias("no"), "keys"),
        places == 1)
    while places > 1:
        now = kept(now, "crosstok-counts")
        places = -(-places // FAN)
        now = _merged(now.select(
            "radix", F.pmod("place", F.lit(places)).alias("place"), F.col("place").alias("run"), "no",
            "keys"), places == 1)
    return kept(now.select("radix", "no", "keys"), "crosstok-pairs")


class _Run:
    """A run of one block that counts stream past."""

    def __init__(self, block: bytes, n_docs: int, keys: list[bytes], docs: list[bytes]):
        self.block, self.frames = block, zip(keys, docs)
        self.best, self.sum = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        self.next()

    def next(self) -> None:
        frame = next(self.frames, None)
        self.keys = self.n = self.docs = self.times = None
        if frame is not None:
            self.keys, self.n = unpack_keys(frame[0])
            self.docs, self.times = unpack_all(frame[1])

    def take(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        """Adds up what the pairs up to the last of ``keys`` give to the documents."""
        while self.keys is not None:
            n = int(np.searchsorted(self.keys, keys[-1], "right"))
            if n:
                at = np.searchsorted(keys, self.keys[:n])
                records = int(self.n[:n].sum())
                docs, times = self.docs[:records], self.times[:records]
                np.add.at(self.sum, docs, times * np.repeat(counts[at], self.n[:n]))
                np.add.at(self.best, docs, times * np.repeat(best[at], self.n[:n]))
                self.keys, self.n = self.keys[n:], self.n[n:]
                self.docs, self.times = self.docs[records:], self.times[records:]
            if len(self.keys):
                return
            self.next()


def contributions(runs: DataFrame, counts: DataFrame, n_blocks: int) -> DataFrame:
    """(block, sums): per radix what its pairs give to each document of the block."""
    places = -(-n_blocks // BACK) or 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for _, rows in _grouped(batches, 0, 1):
            held: list[_Run] = []
            for _, _, no, block, n_docs, keys, docs in rows:
                if no < 0:
                    held.append(_Run(block, n_docs, keys, docs))
                    continue
                for frame in map(unpack_keys, keys):
                    for run in held:
                        run.take(*frame)
            for run in held:
                yield [(run.block, pack_all(run.best, run.sum))]

    own = runs.select(
        "radix", F.pmod(F.xxhash64("block"), F.lit(places)).alias("place"), F.lit(-1).alias("no"),
        "block", "n_docs", "keys", "docs")
    passing = counts.select(
        "radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(places - 1).cast("long"))).alias("place"),
        "no", F.lit(None).cast("binary").alias("block"), F.lit(None).cast("long").alias("n_docs"),
        "keys", F.lit(None).cast("array<binary>").alias("docs"))
    dealt = own.unionByName(passing).repartition("radix", "place")
    return arrow_rows(
        dealt.sortWithinPartitions("radix", "place", "no"), make, "block binary, sums binary")


def token_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """Per row its ``key``, the numbers of its tokens, groups and links, how its links stand in the
    corpus, and the digest of its groups.

    ``n_best`` are the links whose pair is in as many documents as any pair of its A id is, and
    ``count_sum`` adds up the documents of all links. The jobs of the steps run when this is called.
    """
    made = kept(blocks(docs, a_path, b_path, key), "crosstok-blocks")
    documents, runs = made.where("kind = 0"), made.where("kind = 1")
    n_blocks = documents.count()
    counts = pair_counts(runs, n_blocks)
    given = contributions(runs, counts, n_blocks)
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = docs.select(col(key)).schema[0].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for _, rows in _grouped(batches, 0):
            listed, best, total = None, 0, 0
            for _, sums, *own in rows:
                if sums is None:
                    listed = own
                else:
                    more = unpack_all(sums)
                    best, total = best + more[0], total + more[1]
            n = len(listed[0])
            whole = [x.tolist() if isinstance(x, np.ndarray) else [0] * n for x in (best, total)]
            yield list(zip(*listed, *whole))

    none = [F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in columns]
    both = documents.select("block", F.lit(None).cast("binary").alias("sums"), *columns).unionByName(
        given.select("block", "sums", *none))
    return arrow_rows(
        both.repartition("block").sortWithinPartitions("block"), make,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long",
    ).select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
             "groups_sha256")
