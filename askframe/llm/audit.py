"""Filter interaction audit: what each filter removes, in every order of the filters.

Every row gets one bit per filter that it fails. The filters on the text alone are SQL conditions;
the duplicate filter is an existential self-join: a left-semi join on the hash, the exact text and
a smaller doc_id. Its ids are put together with those of the other failures, bits are or-ed per
row, and only the combinations of bits per part (at most 2^filters) go on to the report.

A group of copies may hold a third of all rows. Hashes with more than 1/4096 of the rows (so at most
4,096 of them, which is the bound of the one broadcast) are spread by a salt of the doc_id; the
smallest rows of the salts meet in a second, narrow step. Texts are shuffled once: both sides of
the join read the same exchange.

Null texts count as empty. A null doc_id is neither smaller than another nor has it a smaller one,
and it has no label. Of rows with one doc_id none is the smaller one; each counts. A doc_id that
is labelled more than once is good (toxic) if any of its labels says so. An empty table gives no
rows. Other columns are not read, and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions.plan import seal
from askframe.llm.common import col, kept, words

#: Hashes above this share of the rows are salted.
SHARES = 4096


def _few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 100


def _repeated_words(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def _capitals(text: Column, words: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text)


def _symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Conditions on (text, its words) under which a document fails, by the filter's letter.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": _few_words, "B": _repeated_words, "C": _capitals, "D": _symbols,
}
DUPLICATES = "E"


def hashed(docs: DataFrame, part: str = "lang") -> DataFrame:
    """The columns that the audit reads: id, part, text and the text's hash ``h``."""
    text = F.coalesce(col("text"), F.lit(""))
    return docs.select(
        col("doc_id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.xxhash64(text).alias("h"))


def duplicates(rows: DataFrame) -> DataFrame:
    """(doc_id, part, h) of the ``rows`` whose text a smaller doc_id has as well."""
    total = rows.count()
    heavy = kept(
        rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SHARES > total)
        .select("h", F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))).alias("salts")), "audit-heavy")
    salt = F.coalesce(F.expr("pmod(xxhash64(doc_id), salts)"), F.lit(0))
    dealt = (
        rows.where("doc_id IS NOT NULL").join(F.broadcast(heavy), "h", "left")
        .select("doc_id", "part", "h", "text", salt.alias("salt"))
        .repartition("h", "salt", "text")
    )
    # The smallest doc_id, with its part beside it: so this side has the columns, and thereby the
    # exchange, of the other one.
    smallest = dealt.groupBy("h", "salt", "text").agg(
        F.min(F.struct("doc_id", "part"))["doc_id"].alias("first"))
    # Numbered rows: directly under a join the optimizer would replace the exchange by one of its own.
    numbered = dealt.withColumn("place", F.monotonically_increasing_id()).where("place >= 0")
    x, y = numbered.alias("x"), smallest.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("h", "salt", "text")]
    later = x.join(y, [*same, F.col("y.first") < F.col("x.doc_id")], "left_semi").select(
        "doc_id", "part", "h")
    # The smallest rows of a salt, where another salt of the same text has a smaller one.
    heads = smallest.join(F.broadcast(heavy.select("h")), "h")
    least = heads.groupBy("h", "text").agg(
        F.min("first").alias("least"), F.collect_set("first").alias("heads"))
    beaten = least.select("h", "least", F.explode("heads").alias("doc_id")).where("least < doc_id")
    return later.unionByName(
        rows.select("doc_id", "part", "h").join(beaten.select("doc_id", "h"), ["doc_id", "h"], "left_semi"))


def failures(docs: DataFrame, filters: dict[str, Callable] = FILTERS, part: str = "lang") -> DataFrame:
    """(doc_id, part, h, mask, n): the failure bits of the ``n`` rows equal in id, part and text.

    Bit i is that of the i-th filter, and the highest one that of the duplicates.
    """
    rows = hashed(docs, part)
    cut = seal(rows.withColumn("words", words(F.col("text"))), "words")
    bits = [
        F.when(fails(F.col("text"), F.col("words")), F.lit(1 << i)).otherwise(F.lit(0))
        for i, fails in enumerate(filters.values())
    ]
    own = F.lit(0)
    for bit in bits:
        own = own.bitwiseOR(bit)
    alone = cut.select("doc_id", "part", "h", own.alias("mask"), F.lit(1).cast("long").alias("n"))
    again = duplicates(rows).select(
        "doc_id", "part", "h", F.lit(1 << len(filters)).alias("mask"), F.lit(0).cast("long").alias("n"))
    return alone.unionByName(again).groupBy("doc_id", "part", "h").agg(
        F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def combinations(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good rows and toxic rows per part and combination of bits."""
    told = labels.groupBy("doc_id").agg(
        F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"),
        F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    none = F.lit(0).cast("long")
    counted = marks.select("part", "mask", "n", none.alias("good"), none.alias("toxic")).unionByName(
        marks.join(told, "doc_id").select(
            "part", "mask", none.alias("n"), (F.col("n") * F.col("good")).alias("good"),
            (F.col("n") * F.col("toxic")).alias("toxic")))
    return counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def report(combos: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from the combinations of bits.

    ``names`` are the letters of the filters in the order of their bits. A document that fails k
    filters is removed by each of them in 1/k of the orders, which gives ``shapley``.
    """
    orders = ["".join(p) for p in permutations(names)]

    def total(where: str, value: str) -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (s, c) -> s + {value})")

    cells = combos.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    bit = f"shiftleft(1, instr('{names}', %s) - 1)"
    steps = (
        cells.select("*", F.explode(F.lit(orders)).alias("filter_order"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
        .select("*", F.expr(bit % "substring(filter_order, step, 1)").alias("own"), F.expr(
            "aggregate(filter(split(substring(filter_order, 1, step - 1), ''), f -> f <> ''), 0, "
            f"(m, f) -> m | {bit % 'f'})").alias("before"))
    )
    removed = "c.mask & own <> 0 AND c.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("c.mask & (before | own) = 0", "c.n").alias("kept"),
        total(removed, "c.n").alias("removed"),
        total("c.mask & own <> 0 AND c.mask & before <> 0", "c.n").alias("redundant"),
        total("c.mask = own", "c.n").alias("unique_fails"),
        total(removed, "c.good").alias("good_lost"),
        total(removed, "c.toxic").alias("toxic_lost"),
        total("c.mask & own <> 0", f"c.n * {len(orders)}L div bit_count(c.mask)").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS,
          duplicate: str = DUPLICATES, part: str = "lang") -> DataFrame:
    """The report on ``filters`` and the duplicates, over all ``docs``, for every value of ``part``.

    Names of filters are single letters, at most seven with the duplicates, as the report has a
    row for every step of every order.
    """
    names = "".join(filters) + duplicate
    if any(len(n) != 1 for n in [*filters, duplicate]) or len(set(names)) != len(names) or len(names) > 7:
        raise ValueError("filters need different names of one letter, at most seven in all")
    marks = kept(failures(docs, filters, part), "audit-marks")
    return report(combinations(marks, labels), names)
