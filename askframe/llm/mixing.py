"""Mixing sources to target weights by a min-cost flow over membership patterns.

A text may lie in several sources. Documents are aggregated by the set of sources that hold their
text (the membership pattern); the few numbers per pattern and source form a network from the
sources' targets over (pattern, source) cells to the patterns, where taking a pattern's distinct
words once is free and every further repetition costs more. The flow says how many words each
cell gives.

The selection follows the flow. The texts of a pattern lie on a ring in a seeded order, and its
sources take consecutive stretches of that ring as long as their flows: a text is taken again only
after every other one was taken as often. Of several copies of a text in a source the first takings
go to different copies. What whole documents leave of a source's target is settled in its largest
cell.

Only the cells reach the driver, by number of copies: at most ``Mix.cells`` rows, else the mix is
refused. Their number follows from the sets of sources, not from the documents.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.llm.common import col, kept, n_words

#: Bits of each of the two histogram levels below which running sums are taken row by row.
LEVEL_BITS = 7


@dataclass(frozen=True)
class Mix:
    """Parameters: weights in turn over the sources in order, share of all words that the mix
    has, most repetitions of a document, seed of the selection, most sources, and most groups of
    texts by pattern, source and copies that the driver routes."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    seed: int = 42
    sources: int = 64
    cells: int = 500_000


def targets(sizes: dict[str | None, int], mix: Mix) -> dict[str | None, float]:
    """Words per source: by weight, at most ``repeats`` times its size, the excess shared again.

    Sources count in code point order with null last. Without words all targets are 0.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    left, out, free = mix.share * sum(sizes.values()), {}, list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > mix.repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(mix.repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


class Network:
    """Maximum flow by shortest augmenting paths in layers; capacities may be raised in between."""

    def __init__(self) -> None:
        self.out: dict = defaultdict(list)
        self.to: list = []
        self.room: list[int] = []

    def add(self, a, b, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [capacity, 0]
        return len(self.to) - 2

    def levels(self, start, end) -> dict:
        level, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for e in self.out[at]:
                if self.room[e] and self.to[e] not in level:
                    level[self.to[e]] = level[at] + 1
                    queue.append(self.to[e])
        return level if end in level else {}

    def push(self, start, end) -> None:
        while level := self.levels(start, end):
            turn = {node: 0 for node in level}
            path: list[int] = []
            at = start
            while True:
                if at == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, at = [], start
                    continue
                edges = self.out[at]
                while turn[at] < len(edges):
                    e = edges[turn[at]]
                    if self.room[e] and level.get(self.to[e]) == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(edges):
                    path.append(edges[turn[at]])
                    at = self.to[edges[turn[at]]]
                elif path:
                    turn[at] = len(edges)
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def route(cells: dict[tuple[int, str], int], distinct: dict[int, int],
          quota: dict[str, int], repeats: int) -> dict[tuple[int, str], int]:
    """Words that each (pattern, source) cell gives: least total cost at full quotas.

    A pattern's words cost nothing up to its distinct words and more with every further
    repetition. All costs lie on the last edges, where serving the cheap steps first and letting
    later ones only augment is optimal: augmenting never takes flow from a last edge.
    Steps are single repetitions up to ``repeats``, then double in width.
    """
    net = Network()
    for s, words in sorted(quota.items()):
        net.add("start", ("source", s), words)
    edge = {}
    for (p, s), words in sorted(cells.items()):
        edge[p, s] = net.add(("source", s), ("pattern", p), repeats * words)
    most = defaultdict(int)
    for (p, _), words in cells.items():
        most[p] += repeats * words
    last = {p: net.add(("pattern", p), "end", 0) for p in sorted(most)}
    given, step = dict.fromkeys(last, 0), 0
    while any(given[p] < most[p] for p in last):
        step = step + 1 if step < repeats else 2 * step
        for p, e in last.items():
            upto = min(most[p], max(1, distinct[p]) * step)
            net.room[e] += upto - given[p]
            given[p] = upto
        net.push("start", "end")
    return {c: net.room[e ^ 1] for c, e in edge.items()}


def _name(source: Column) -> Column:
    """The source as a string that is never null: null becomes '', others get a mark."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def layers(held: list[tuple[int, int]], flow: int, repeats: int) -> tuple[int, int, int, int]:
    """How a cell gives ``flow`` words: layers taken whole, and of the next one the least copies of
    its texts, the words to take and its width.

    ``held``: (copies, words of the texts that have so many, counted once). The k-th layer is the
    k-th taking of every text that can be taken so often.
    """
    done, width = 0, sum(words for _, words in held)
    for copies, words in sorted(held):
        height = repeats * copies - done
        if flow < height * width:
            return done + flow // width, copies, flow % width, width
        flow -= height * width
        done, width = repeats * copies, width - words
    return done, 0, 0, 0


def _running(rows: DataFrame, keys: list[str], amount: str, ties: list[str]) -> DataFrame:
    """``rows`` and ``upto``, the running sum of ``amount`` per ``keys`` in the order of the hash
    ``h``. Two histograms give the sums below a bin, so a window only holds the rows of one bin."""
    low = F.lit((1 << LEVEL_BITS) - 1)
    rows = rows.withColumns({
        "coarse": F.shiftrightunsigned("h", 64 - LEVEL_BITS).cast("int"),
        "fine": F.shiftrightunsigned("h", 64 - 2 * LEVEL_BITS).bitwiseAND(low).cast("int"),
    })
    bins = rows.groupBy(*keys, "coarse", "fine").agg(F.sum(amount).alias("words"))
    earlier = (Window.unboundedPreceding, -1)
    upper = bins.groupBy(*keys, "coarse").agg(F.sum("words").alias("words")).select(
        *keys, "coarse",
        F.sum("words").over(Window.partitionBy(*keys).orderBy("coarse").rowsBetween(*earlier)).alias("above"))
    lower = bins.withColumn(
        "below", F.sum("words").over(Window.partitionBy(*keys, "coarse").orderBy("fine").rowsBetween(*earlier)))
    before = lower.join(upper, [*keys, "coarse"]).select(
        *keys, "coarse", "fine",
        (F.coalesce("above", F.lit(0)) + F.coalesce("below", F.lit(0))).alias("before"))
    inside = Window.partitionBy(*keys, "coarse", "fine").orderBy("h", *ties).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.join(before, [*keys, "coarse", "fine"])
        .withColumn("upto", F.col("before") + F.sum(amount).over(inside))
        .drop("coarse", "fine", "before")
    )


def _takings(texts: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """``times``: how often each text is taken from a source, for the cells of ``plan``.

    A text belongs to the stretch of the ring that holds its middle."""
    cells = texts.join(F.broadcast(plan), ["p", "s"])  # at most mix.cells rows
    whole = cells.where("rest = 0 or copies < part_copies").withColumn(
        "times", F.least(F.col("copies") * mix.repeats, "full"))
    parted = _running(cells.where("rest > 0 and copies >= part_copies"), ["p", "s"], "once", ["t1", "t2"])
    inside = F.expr("pmod(2 * upto - once - 2 * start, 2 * width) < 2 * rest")
    parted = parted.withColumn("times", F.col("full") + inside.cast("long")).drop("upto")
    return whole.unionByName(parted).select(
        "t1", "t2", "s", "once", "copies", "times", "source_size", "target")


def mix_documents(df: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text",
                  source: str = "source") -> DataFrame:
    """``doc_id``, ``size`` (words), ``source_size``, ``target`` (both of its source) and ``taken``.

    One row per row of ``df``: a document is taken whole, 0 to ``mix.repeats`` times. A source's
    taken words differ from its target by about half a document, or by one per pattern where its
    largest cell has no room to settle that. Null texts have no words and are taken as 0; a null
    source is a source; rows equal in key, text and source count each and share what their text
    gives. All orders are hashes of text or key and the seed, so reruns agree. An empty table gives
    no rows. More than ``mix.sources`` sources or ``mix.cells`` cells raise ``ValueError``.
    """
    rows = df.select(
        col(key).alias("doc_id"), _name(col(source)).alias("s"), n_words(col(text)).alias("size"),
        F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("t1"),
        F.crc32(F.coalesce(col(text), F.lit(""))).alias("t2"))
    # Equal rows meet on the map side already, however many there are.
    entries = kept(
        rows.groupBy("doc_id", "s", "t1", "t2", "size").agg(F.count(F.lit(1)).alias("n")), "mix-entries")
    held = (
        entries.groupBy("t1", "t2", "s").agg(F.sum("n").alias("copies"), F.max("size").alias("once"))
        .groupBy("t1", "t2").agg(
            F.sort_array(F.collect_list(F.struct("s", "copies"))).alias("held"), F.max("once").alias("once"))
    )
    texts = kept(
        held.select("t1", "t2", "once", F.xxhash64("held.s").alias("p"), F.inline("held"))
        .withColumn("h", F.xxhash64("t1", "t2", F.lit(mix.seed))), "mix-texts")

    counted = texts.groupBy("p", "s", "copies").agg(F.sum("once").alias("words")).limit(mix.cells + 1).collect()
    if len(counted) > mix.cells:
        raise ValueError(f"more than {mix.cells} cells of pattern, source and copies: join sources first")
    groups: dict[tuple[int, str], list] = defaultdict(list)
    for r in counted:
        groups[r.p, r.s].append((r.copies, r.words))
    cells = {c: sum(copies * words for copies, words in g) for c, g in sorted(groups.items())}
    distinct = {p: sum(words for _, words in g) for (p, _), g in groups.items()}
    sizes: dict[str, int] = defaultdict(int)
    home: dict[str, tuple[int, str]] = {}
    for c, words in cells.items():
        sizes[c[1]] += words
        if c[1] not in home or words > cells[home[c[1]]]:
            home[c[1]] = c
    if len(sizes) > mix.sources:
        raise ValueError(f"{len(sizes)} sources, more than {mix.sources}: join sources first")
    plain = {s: (s[1:] if s else None) for s in sizes}
    target = targets({plain[s]: n for s, n in sizes.items()}, mix)
    quota = {s: round(target[plain[s]]) for s in sizes}
    flow = route(cells, distinct, quota, mix.repeats)

    start, ring = {}, dict.fromkeys(distinct, 0)
    for p, s in cells:
        start[p, s] = ring[p]
        if flow[p, s] < mix.repeats * distinct[p]:
            ring[p] = (ring[p] + flow[p, s]) % distinct[p]

    def planned(some: list[tuple[int, str]]) -> DataFrame:
        return df.sparkSession.createDataFrame(
            [(*c, sizes[c[1]], float(target[plain[c[1]]]), start[c], *layers(groups[c], flow[c], mix.repeats))
             for c in some],
            "p long, s string, source_size long, target double, start long, full long, part_copies long, "
            "rest long, width long")

    settled = set(home.values())
    first = kept(_takings(texts, planned([c for c in cells if c not in settled]), mix), "mix-first")
    given = {r.s: r.words for r in first.groupBy("s").agg(F.sum(F.expr("times * once")).alias("words")).collect()}
    for s, c in home.items():
        flow[c] = max(0, min(mix.repeats * cells[c], quota[s] - given.get(s, 0)))
    times = first.unionByName(_takings(texts, planned(sorted(settled)), mix))

    shared = kept(
        entries.join(times.drop("once"), ["t1", "t2", "s"])
        .withColumn("h", F.xxhash64("doc_id", F.lit(mix.seed))), "mix-shared")
    odd = F.col("times") % F.col("copies")
    even = shared.where(odd == 0).withColumn("more", F.lit(0).cast("long"))
    parted = _running(shared.where(odd != 0), ["t1", "t2", "s"], "n", ["doc_id"])
    parted = parted.withColumn(
        "more", F.greatest(F.lit(0), F.least("n", odd - (F.col("upto") - F.col("n"))))).drop("upto")
    each = even.unionByName(parted).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    taken = F.col("size") * (F.expr("times div copies") + (F.col("i") <= F.col("more")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
