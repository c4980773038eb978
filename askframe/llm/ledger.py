"""Quality rules as a ledger: every rule is evaluated once per text, policies come afterwards.

``ledger`` stores what was measured and one bit per failed rule. A policy is a version and a mask
of the rules that reject; applying it, or taking a rule out again, is arithmetic on the stored
bits and never reads a text. All of it is Spark SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import SPACES, col, fresh, words

SYMBOLS = "#*$%&|<>"

#: The rules in the order of their bits: a name and the condition under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "shouting": "100 * n_shouts > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
}

#: Versioned policies: which rules reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2": tuple(RULES),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def covered(starts: Column, width: int) -> Column:
    """How many places windows of ``width`` cover that begin at the sorted ``starts``."""
    steps = F.transform(
        starts,
        lambda p, i: F.coalesce(F.least(F.lit(width), F.get(starts, i + 1) - p), F.lit(width)),
    )
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def repeated_words(ws: Column) -> Column:
    """The words that lie in a 3-word window found twice or more, each word once.

    Windows are compared by a 64-bit hash. Most texts repeat none, which the number of distinct
    hashes tells; else the windows are sorted by hash, and equal neighbours give their places.
    """
    def places(hashes: Column) -> Column:
        return let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda rows: F.transform(
                F.filter(
                    rows,
                    lambda r, j: F.coalesce(r.h == F.get(rows, j - 1).h, F.lit(False))
                    | F.coalesce(r.h == F.get(rows, j + 1).h, F.lit(False)),
                ),
                lambda r: r.i,
            ),
        )

    windows = F.slice(
        F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))),
        1, F.size(ws) - 2,
    )
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(
        let(windows, lambda hs: F.when(
            F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0),
        ).otherwise(let(F.sort_array(places(hs)), lambda at: covered(at, 3))))
    )


def measured(text: Column) -> Column:
    """Struct of all measurements of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    by_word = let(words(whole), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeated_words(ws).cast("long").alias("n_repeat_words"),
    ))
    by_line = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    ))
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long").alias("n_shouts"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_shouts")


def _flat(m: Column) -> dict[str, Column]:
    """The columns of the ledger from the struct of ``measured``."""
    return {
        "n_words": m.w.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols,
        "n_dup_lines": m.l.n_dup_lines, "n_repeat_words": m.w.n_repeat_words,
        "n_lines": m.l.n_lines, "n_shouts": m.n_shouts,
    }


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements, and ``failures``: bit i is set where rule i fails.

    One row per row of ``df``, in one pass without a shuffle. Null and empty texts measure 0
    everywhere and fail ``few_words``. Columns of ``df`` that are not in ``keep`` are left out;
    a kept one under the name of a measurement is refused.
    """
    clash = {*MEASURES, "failures"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are measurements; rename them")
    m, = fresh(df, "measured")
    rows = df.select(
        *[col(c) for c in keep], F.inline(F.array(F.struct(measured(col(text)).alias(m)))))
    found = rows.select(
        *[col(c) for c in keep], *[c.alias(name) for name, c in _flat(col(m)).items()])
    bits = [f"if({rule}, {1 << i}L, 0L)" for i, rule in enumerate(RULES.values())]
    return found.withColumn("failures", F.expr(" | ".join(bits)))


def verdicts(rows: DataFrame, policy: str = "2") -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` under ``policy``, and the policy's name."""
    failures = F.col("failures")
    return rows.withColumns({
        "base_failed": failures.bitwiseAND(F.lit(mask("base"))) != 0,
        "kept": failures.bitwiseAND(F.lit(mask("base") | mask(policy))) == 0,
        "policy": F.lit(policy),
    })


def ablations(rows: DataFrame, policy: str = "2") -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it rejects, and rows rejected without it.

    One aggregation over the stored bits; an empty ledger gives zeros. ``also`` is the mask of the
    rules that ever fail together with the rule.
    """
    whole = mask(policy)
    failures = F.col("failures").bitwiseAND(F.lit(whole))
    names = [r for r in RULES if r in POLICIES[policy]]
    bit = {name: 1 << list(RULES).index(name) for name in names}

    def hits(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")

    return rows.agg(F.array(*[
        F.struct(
            F.lit(name).alias("rule"),
            hits(failures.bitwiseAND(F.lit(bit[name])) != 0).alias("failed"),
            hits(failures == bit[name]).alias("only"),
            hits(failures.bitwiseAND(F.lit(whole & ~bit[name])) != 0).alias("rejected_without"),
            F.coalesce(F.bit_or(F.when(
                failures.bitwiseAND(F.lit(bit[name])) != 0, failures)), F.lit(0)).alias("also"),
        ) for name in names
    ]).alias("rules")).select(F.inline("rules"))


def kept_documents(df: DataFrame, policy: str = "2", text: str = "text") -> DataFrame:
    """The rows of ``df`` that a policy keeps, with their columns as they are.

    The ledger is made beside the row and dropped after the verdict: no shuffle, and no column of
    ``df`` can clash with a measurement.
    """
    row, = fresh(df, "row")
    whole = df.select(F.struct(*[col(c) for c in df.columns]).alias(row), col(text).alias("text"))
    judged = verdicts(ledger(whole, "text", (row,)), policy)
    return judged.where("kept").select(f"`{row}`.*")
