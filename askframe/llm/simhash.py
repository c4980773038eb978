"""SimHash near-duplicates by a range join of segment bit counts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Two fingerprints
differ in at least as many bits as the Manhattan distance of their embeddings, so a join by that
distance loses no link, and the exact bit distance is only tested on what it leaves.

Of two fingerprints within 3 bits, one half differs in at most one bit, so the embeddings of that
half are at most one apart. The embedding is written in unary (count 0, 1, 2 as bits 00, 01, 11):
its Manhattan distance is then a bit count of an XOR, and one step up sets one bit. Each half is a
grid with a cell per embedding; a fingerprint lies in one cell per half and also looks into the
cells one step up, so every pair meets in a cell where one of the two is at home.

Dense groups are contracted first: all fingerprints at home in a cell are compared with the
smallest one there. After that only pairs of different groups count as links, so a large group of
near copies costs a few links per member, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import arrow_columns, col, fresh, kept
from askframe.llm.components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 3
#: Shingles hashed at once; longer texts are counted piece by piece.
AT_ONCE = 65_536

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: The low bit of each two-bit segment.
_LOW_BITS = 0x5555555555555555
_HALF = 0xFFFFFFFF


def fingerprint(text: str | None) -> int:
    """The SimHash of the 3-word shingles (repeats included) of a text; 0 without words.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than three are one shingle.
    """
    import xxhash

    # bytes.split() cuts at exactly the white space of the word rule.
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(SHINGLE, len(found)) - 1:].tolist()
    total, digest = len(last), xxhash.xxh64_intdigest
    on = np.zeros(64, dtype=np.int64)
    for at in range(0, total, AT_ONCE):
        hashes = np.array(
            [digest(joined[a:b], SEED)
             for a, b in zip(starts[at:at + AT_ONCE], last[at:at + AT_ONCE])], dtype=">u8")
        on += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > total).view(">i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every row; a map without a shuffle."""
    return _fingerprints(df, key, text).select("doc_id", "fp")


def _fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    picked = df.select(col(key).alias("doc_id"), col(text).alias("text"))

    def make(batch: pa.RecordBatch) -> list:
        return [[fingerprint(t.as_py()) for t in batch.column(1)]]

    return arrow_columns(picked, ["doc_id", "text"], "fp long", make)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments in unary, packed: both bits, then either bit."""
    next_bit = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_LOW_BITS))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW_BITS))
    return either.bitwiseOR(F.shiftleft(both, 1))


def cells(points: DataFrame) -> DataFrame:
    """Each point (fp, emb and more) at home in its cell of both halves: adds ``half``, ``cell``."""
    return points.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("emb").bitwiseAND(F.lit(_HALF)).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("emb", 32).alias("cell")),
    )).alias("at")).select(*points.columns, "at.half", "at.cell")


def one_step_up(home: DataFrame) -> DataFrame:
    """Points at home in a cell, in every cell where one segment counts one bit more."""
    up = F.expr(
        "transform(filter(sequence(0, 15), i -> (shiftright(cell, 2 * i) & 3) < 3),"
        " i -> cell | shiftleft(1L, 2 * i + bit_count(shiftright(cell, 2 * i) & 3)))")
    return home.withColumn("cell", F.explode(up))


def linked_groups(distinct: DataFrame) -> DataFrame:
    """``fp`` and ``root`` (the same for all that links connect) of distinct fingerprints ``fp``."""
    points = distinct.select("fp", embedding(F.col("fp")).alias("emb"))

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS

    home = cells(points)
    pivot = home.groupBy("half", "cell").agg(F.min("fp").alias("first"), F.count("*").alias("n"))
    hubs = (
        home.join(pivot.where("n > 1"), ["half", "cell"])
        .where(near("fp", "first") & (F.col("fp") != F.col("first")))
        .select(F.col("fp").alias("a"), F.col("first").alias("b"))
    )
    groups = components(hubs).select(F.col("node").alias("fp"), "root")
    points = kept(
        points.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "simhash-groups")

    home = cells(points)
    right = home.select(
        F.col("half").alias("other_half"), F.col("cell").alias("other_cell"),
        F.col("fp").alias("other"), F.col("emb").alias("other_emb"),
        F.col("root").alias("other_root"))
    left = home.withColumn("up", F.lit(False)).unionByName(
        one_step_up(home).withColumn("up", F.lit(True)))
    pair = (
        (F.col("half") == F.col("other_half")) & (F.col("cell") == F.col("other_cell"))
        & (F.col("up") | (F.col("fp") < F.col("other")))
        & (F.col("root") != F.col("other_root"))
        & near("emb", "other_emb")  # the lower bound
        & near("fp", "other")
    )
    links = left.join(right, pair).select(
        F.col("root").alias("a"), F.col("other_root").alias("b"))
    merged = components(links).select(
        F.col("node").alias("root"), F.col("root").alias("top"))
    return points.join(merged, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest
    doc_id that links of at most 3 differing bits reach.

    One row per row of ``df``. Null and empty texts have fingerprint 0 and link like any other;
    repeated rows get the same component; rows without a doc_id take part, and count only where
    their whole component has none (component_id null). An empty table gives no rows.
    """
    own = kept(fingerprints(df, key, text), "simhash")
    return own.join(_components(own).drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(own: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``own``."""
    distinct = kept(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = kept(linked_groups(distinct), "simhash-linked").join(distinct, "fp")
    # Stored, so that the join below deals out both sides anew and a hot root can be split.
    ids = kept(groups.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return kept(groups.join(ids, "root").select("fp", "root", "component_id"), "simhash-ids")


def one_per_group(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with exactly one row of each component: that of the smallest doc_id.

    Rows without a doc_id come last. Of rows with one doc_id that with the smallest hash of its text
    stays, and of rows equal in both any one. Rows that share a doc_id, but belong to different
    components, are different documents.
    """
    hashed, first_id, first_hash = fresh(df, "text_hash", "first_id", "first_hash")
    own_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = kept(_fingerprints(df, key, text).select("doc_id", "fp", own_hash.alias("hash")), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = kept(
        own.join(_components(own), "fp").groupBy("root").agg(F.min(order).alias("first"))
        .select(F.col("first.doc_id").alias(first_id), F.col("first.hash").alias(first_hash)),
        "simhash-first")
    rows = df.withColumn(hashed, F.xxhash64(F.coalesce(col(text), F.lit(""))))
    same = col(key).eqNullSafe(col(first_id)) & (col(hashed) == col(first_hash))
    return rows.join(first, same, "left_semi").dropDuplicates([key, hashed]).drop(hashed)
