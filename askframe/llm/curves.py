"""Nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random orthogonal directions, shifts them, lays a grid and
takes the Hilbert index. Neighbours in space tend to lie near each other on some curve. A curve is
cut into blocks of equal counts; a query looks through the blocks around its own on every curve,
and what the curves find is merged and ranked by exact distances on the original vectors.

Equal vectors count once, with the smallest ids that have them. A tight group may lie in one cell
of the grid that fills more blocks than a query looks through; queries in such a cell look through
all its blocks, on the curve where it fills the most.

Vectors of different length have no distance: each length is searched on its own. A length with
fewer than ``blocks`` times (k + 1) different vectors cannot fill its blocks with k candidates; all
of it is one block, so its search is exact. Every other length has the same number of blocks.

Directions are drawn from a seed; centre, scale and block limits come from a sample of about
``Curves.sample`` vectors, shared by the lengths. Every vector is indexed. Blocks are a share of the
curve, so recall does not fall as the table grows; a block is cut further into tasks of bounded rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import arrow_columns, col, kept
from askframe.llm.hilbert import hilbert_index
from askframe.sources.session import ship_package


@dataclass(frozen=True)
class Curves:
    """Parameters of the index. ``window`` of ``blocks`` blocks are searched on each curve."""

    curves: int = 16
    dimensions: int = 12
    bits: int = 3
    blocks: int = 64
    window: int = 5
    sample: int = 20_000
    rows_per_task: int = 20_000
    seed: int = 42


#: Bits of a hash below the curve index, which spread equal places over several blocks.
_TIE_BITS = 16


class Index:
    """Projections and block limits of all curves, for the vectors of one length.

    ``rows`` is how many different vectors have the length, ``vectors`` a sample of them.
    """

    def __init__(self, vectors: np.ndarray, rows: int, given: Curves):
        draw = np.random.default_rng(given.seed)
        size = vectors.shape[1]
        self.given = given
        self.blocks = given.blocks
        self.window = min(given.window, self.blocks)
        # A block is cut so that a task holds rows_per_task of it at most, about.
        self.row_cuts = max(1, ceil(rows / (given.rows_per_task * self.blocks)))
        m = min(given.dimensions, size)
        self.parts = []
        ties = draw.integers(0, 1 << _TIE_BITS, len(vectors))
        for _ in range(given.curves):
            turn = np.linalg.qr(draw.normal(size=(size, m)))[0]
            shift = draw.uniform(-1, 1, m)
            flat = vectors @ turn
            self.parts.append([turn, flat.mean(axis=0), flat.std(axis=0) + 1e-12, shift, None])
        for part in self.parts:
            places = np.sort(self._place(vectors, part) << _TIE_BITS | ties)
            cuts = np.linspace(0, len(places), self.blocks + 1)[1:-1].astype(int)
            part[4] = places[cuts]

    def _place(self, vectors: np.ndarray, part: list) -> np.ndarray:
        turn, centre, scale, shift, _ = part
        cells = 1 << self.given.bits
        # Five standard deviations over the grid, shifted by up to one cell.
        at = ((vectors @ turn - centre) / scale / 5 + 0.5) * cells + shift
        grid = np.clip(at, 0, cells - 1).astype(np.int64)
        return hilbert_index(list(grid.T), self.given.bits)

    def block_of(self, vectors: np.ndarray, ties: np.ndarray) -> list[np.ndarray]:
        """The block of each vector (rows) on each curve (columns); first and last block to search."""
        own, low, high = [], [], []
        top = (1 << _TIE_BITS) - 1
        for i, part in enumerate(self.parts):
            cell = self._place(vectors, part) << _TIE_BITS
            # Every curve orders the rows of a cell in its own way.
            turned = (ties * (2 * (7919 * i + 1) + 1) + 977 * i) & top
            own.append(np.searchsorted(part[4], cell | turned, side="right"))
            low.append(np.searchsorted(part[4], cell, side="right"))
            high.append(np.searchsorted(part[4], cell | top, side="right"))
        own, low, high = (np.column_stack(c).astype(np.int32) for c in (own, low, high))
        first = np.clip(own - self.window // 2, 0, self.blocks - self.window)
        last = first + self.window - 1
        rows, widest = np.arange(len(own)), np.argmax(high - low, axis=1)
        first[rows, widest] = np.minimum(first, low)[rows, widest]
        last[rows, widest] = np.maximum(last, high)[rows, widest]
        return [own, first, last]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unfold(lists: pa.Array, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the picked lists, and for each the place in ``picked`` that it comes from."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    start, count = ends[picked], ends[picked + 1] - ends[picked]
    place = np.repeat(np.arange(len(picked)), count)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    return lists.values.to_numpy()[start[place] + inside], place


#: Distances of one matrix product.
_PRODUCT = 2_000_000


def nearest(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """For each query the k nearest ids of ``rows`` by exact distance, ties to the smaller id.

    A row is a vector and the ids that have it. The matrix product only preselects, with a margin
    above its rounding error.
    """
    q, r = matrix(queries["v"]), matrix(rows["v"])
    own = queries["vec"].to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(q) and len(r):
        r2 = (r ** 2).sum(axis=1)
        step = max(1, _PRODUCT // len(r))
        todo = [(np.arange(i, min(i + step, len(q))), k) for i in range(0, len(q), step)]
    else:
        todo = []
    while todo:
        asked, wanted = todo.pop()
        part = q[asked]
        rough = r2 - 2 * (part @ r.T)
        if len(r) > wanted:
            edge = np.partition(rough, wanted - 1, axis=1)[:, wanted - 1]
            slack = 1e-9 * (np.abs(edge) + r2.max() + (part ** 2).sum(axis=1))
            which, some = np.nonzero(rough <= (edge + slack)[:, None])
        else:
            which, some = (i.ravel() for i in np.indices(rough.shape))
        exact = np.sqrt(((r[some] - part[which]) ** 2).sum(axis=1))
        ids, place = _unfold(rows["ids"], some)
        which, score = which[place], exact[place]
        # Each id once, with its nearest vector; then the first k of each query.
        order = np.lexsort((score, ids, which))
        which, ids, score = which[order], ids[order], score[order]
        new = np.ones(len(ids), bool)
        new[1:] = (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])
        which, ids, score = which[new], ids[new], score[new]
        order = np.lexsort((ids, score, which))
        which, ids, score = which[order], ids[order], score[order]
        count = np.bincount(which, minlength=len(asked))
        # Ids may have several vectors: then more of them are needed for k ids.
        short = (count < k) & (len(r) > wanted)
        place = np.arange(len(which)) - (np.cumsum(count) - count)[which]
        good = (place < k) & ~short[which]
        found.append((own[asked[which[good]]], ids[good], score[good]))
        if short.any():
            todo.append((asked[short], wanted * 4))
    vec, ids, score = (np.concatenate(c) for c in zip(*found))
    return pa.table({
        "query": pa.array(vec, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
        "score": pa.array(score, pa.float64()),
    })


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty or zero, all components finite."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def _smallest_ids(rows: DataFrame, need: int, rows_per_task: int) -> DataFrame:
    """Each vector ``v`` once, with the ``need`` smallest ``ids`` that have it.

    A vector that many rows share is cut by a salt, in as many steps as keep each part near
    ``rows_per_task`` rows.
    """
    cuts = ceil(rows.count() / rows_per_task)
    left = rows.select("id", "v")
    while cuts > 1:
        inside = Window.partitionBy("v", "salt").orderBy("id")
        left = (
            left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(cuts)))
            .withColumn("n", F.row_number().over(inside)).where(F.col("n") <= need)
            .select("id", "v"))
        cuts = min(cuts - 1, ceil(cuts * need / rows_per_task))
    first = Window.partitionBy("v").orderBy("id")
    return (
        left.withColumn("n", F.row_number().over(first)).where(F.col("n") <= need)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))


def _indexes(vectors: DataFrame, given: Curves, need: int) -> dict[int, Index]:
    """The index of every length that has at least ``need`` different vectors a block."""
    filled = {
        r["size"]: r["count"] for r in vectors.groupBy("size").count()
        .where(F.col("count") >= given.blocks * need).collect()}
    out = {}
    for size, rows in sorted(filled.items()):
        share = min(1.0, given.sample / len(filled) / rows)
        drawn = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(given.seed)), F.lit(1 << 30)) < share * (1 << 30)
        # Drawn by their smallest id; in its order, so that a rerun makes the same index.
        sample = vectors.where((F.col("size") == size) & drawn).orderBy(F.col("ids")[0], "v").select("v")
        picked = sample.collect()
        if picked:
            out[size] = Index(np.array([r.v for r in picked], dtype=np.float64), rows, given)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, given: Curves = Curves(),
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the Euclidean distance.

    Queries are the rows where ``is_query`` holds, candidates all rows with another id and a
    vector of the query's length. Vectors that are null, empty, zero or not finite take no part,
    nor do null ids. Rows that repeat an id count once, with the nearest of their vectors. Fewer
    candidates than k give them all; an empty table gives no rows. Lengths that fill their blocks
    have an index each, of some hundred KB, in the tasks; the driver gets these lengths and the
    sample.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = vectors.where(usable(col(vector)) & col(key).isNotNull()).select(
        col(key).cast("long").alias("id"), col(vector).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    alike = kept(good.groupBy("id", "v").agg(F.max("asks").alias("asks")), "curve-rows")
    # A query needs k ids besides its own.
    need = k + 1
    numbered = kept(
        _smallest_ids(alike, need, given.rows_per_task)
        .withColumn("vec", F.monotonically_increasing_id()).withColumn("size", F.size("v")),
        "curve-vectors")
    queries = kept(
        alike.where("asks").select("id", "v").join(numbered.select("v", "vec"), "v")
        .select(F.col("id").alias("query_id"), F.col("vec").alias("query")), "curve-queries")
    asking = queries.select(F.col("query").alias("vec")).distinct().withColumn("asks", F.lit(True))
    good = numbered.join(asking, "vec", "left").select(
        "vec", "v", "ids", "size", F.coalesce("asks", F.lit(False)).alias("asks"))
    indexes = _indexes(numbered, given, need)
    tie = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << _TIE_BITS)).cast("long")

    def make(batch: pa.RecordBatch) -> list:
        sizes, ties = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        out = [[None] * len(sizes) for _ in range(4)]
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            index = indexes.get(int(size))
            if index is None:  # one block on one curve
                found, cuts = [np.zeros((len(here), 1), np.int32)] * 3, 1
            else:
                found = index.block_of(matrix(batch.column(1).take(pa.array(here))), ties[here])
                cuts = index.row_cuts
            for column, values in zip(out, found):
                for i, value in zip(here, values.tolist()):
                    column[i] = value
            for i in here:
                out[3][i] = cuts
        return out

    placed = kept(
        arrow_columns(good.withColumn("tie", tie), ["vec", "v", "ids", "size", "asks", "tie"],
                      "blocks array<int>, first array<int>, last array<int>, row_cuts int", make),
        "curve-blocks")
    asks = placed.where("asks").select(
        "vec", "v", "size", "row_cuts", F.posexplode(F.arrays_zip("first", "last")).alias("curve", "range")
    ).select("vec", "v", "size", "row_cuts", "curve",
             F.explode(F.sequence("range.first", "range.last")).alias("block"))
    most_asking = asks.groupBy("size", "curve", "block").count().agg(F.max("count")).first()[0] or 0
    query_cuts = max(1, ceil(most_asking / given.rows_per_task))
    rows = placed.select(
        "vec", "v", "ids", "size", F.posexplode("blocks").alias("curve", "block"),
        F.pmod(F.xxhash64("vec", F.lit(1)), F.col("row_cuts")).cast("int").alias("row_cut"),
    ).withColumn("query_cut", F.explode(F.sequence(F.lit(0), F.lit(query_cuts - 1))))
    asks = asks.withColumn(
        "query_cut", F.pmod(F.xxhash64("vec", F.lit(2)), F.lit(query_cuts)).cast("int")
    ).withColumn("row_cut", F.explode(F.sequence(F.lit(0), F.col("row_cuts") - 1)))
    keys = ["size", "curve", "block", "row_cut", "query_cut"]
    found = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(
        lambda a, b: nearest(a, b, need), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    merged = (
        found.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= need)
    )
    # An id with several query vectors gets the nearest over all of them.
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        queries.join(merged, "query").where("vec_id != query_id")
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
