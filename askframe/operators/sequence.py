"""Model input: option and head budgets, sequence assembly, padding, token counts.

The part of a sequence ahead of the context depends on the question and the checkpoint only.
``question_prefix`` therefore runs over the small table of questions x checkpoints, and the
context is tokenised once per request, not once per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.text import col
from askframe.sources.tables import stored


def option_rows(options: Column | str, mask_id: Column) -> Column:
    """Every option as mask id + at most 48 ids."""
    return F.transform(
        col(options), lambda o: F.concat(F.array(mask_id), F.slice(o, 1, fixed.OPTION_TOKENS))
    )


def total_size(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda a, o: a + F.size(o))


def with_budget(
    df: DataFrame, options: Column | str, mask_id: Column | str, head_max_len: Column | str
) -> DataFrame:
    """Add ``option_ids`` (cut to fit) and ``head_budget``."""
    limit = col(head_max_len)
    rows = F.col("_rows")
    share = F.greatest(
        F.lit(fixed.MIN_OPTION_TOKENS),
        F.floor(
            (limit - fixed.MIN_HEAD_ROOM) / F.greatest(F.lit(1), F.size(rows))
        ).cast("int"),
    )
    return (
        df.withColumn("_rows", option_rows(options, col(mask_id)))
        .withColumn("_tight", limit - total_size(rows) < fixed.MIN_HEAD_ROOM)
        .withColumn("_share", share)
        .withColumn(
            "option_ids",
            F.when(
                F.col("_tight"), F.transform(rows, lambda o: F.slice(o, F.lit(1), F.col("_share")))
            ).otherwise(rows),
        )
        .withColumn(
            "head_budget",
            F.greatest(F.lit(fixed.MIN_HEAD_TOKENS), limit - total_size(F.col("option_ids"))),
        )
        .drop("_rows", "_tight", "_share")
    )


def question_prefix(
    df: DataFrame,
    head: Column | str,
    options: Column | str,
    cls_id: Column | str,
    sep_id: Column | str,
    mask_id: Column | str,
    head_max_len: Column | str,
) -> DataFrame:
    """Add ``prefix`` (ids up to the context) and ``markers`` (0-based mask positions)."""
    df = with_budget(df, options, mask_id, head_max_len)
    df = df.withColumn("_head", F.slice(col(head), F.lit(1), F.col("head_budget")))
    first = (F.size("_head") + 2).alias("next")
    none = F.array().cast("array<int>").alias("found")
    # The accumulator carries the next free position along with the markers so far.
    markers = F.aggregate(
        F.transform("option_ids", F.size),
        F.struct(none, first),
        lambda acc, n: F.struct(
            F.concat(acc["found"], F.array(acc["next"])).alias("found"),
            (acc["next"] + n).alias("next"),
        ),
        lambda acc: acc["found"],
    )
    prefix = F.concat(
        F.array(col(cls_id)),
        F.col("_head"),
        F.array(col(sep_id)),
        F.flatten("option_ids"),
        F.array(col(sep_id)),
    )
    return df.withColumn("prefix", prefix).withColumn("markers", markers).drop("_head")


def context_room(prefix: Column, max_len: Column) -> Column:
    """Ids of the context that fit behind a prefix."""
    return F.greatest(F.lit(0), max_len - F.size(prefix) - 1)


def full_sequence(prefix: Column, state: Column, sep_id: Column, max_len: Column) -> Column:
    body = F.slice(state, F.lit(1), context_room(prefix, max_len))
    return F.slice(F.concat(prefix, body, F.array(sep_id)), F.lit(1), max_len)


def kept_markers(markers: Column, max_len: Column) -> Column:
    return F.filter(markers, lambda m: m < max_len)


def assemble(
    df: DataFrame, state: Column | str, sep_id: Column | str, max_len: Column | str
) -> DataFrame:
    """Add ``ids`` and ``error`` to rows with ``prefix`` and ``markers`` (one per question)."""
    limit = col(max_len)
    n_options = F.size("markers")
    return (
        df.withColumn("ids", full_sequence(F.col("prefix"), col(state), col(sep_id), limit))
        .withColumn("_kept", kept_markers(F.col("markers"), limit))
        .withColumn(
            "error",
            F.when(
                F.size("_kept") != n_options,
                F.concat(
                    F.lit('question "'),
                    F.col("qid"),
                    F.lit('" options exceed head_max_len='),
                    F.col("head_max_len").cast("string"),
                ),
            ),
        )
        .withColumn("markers", F.col("_kept"))
        .drop("_kept")
    )


def sequences(
    prefixes: Column | str, state: Column | str, sep_id: Column, max_len: Column
) -> Column:
    """ARRAY<STRUCT<qid, qcode, k, ids, markers>> of one request's questions."""
    return F.transform(
        col(prefixes),
        lambda p: F.struct(
            p["qid"].alias("qid"),
            p["qcode"].alias("qcode"),
            F.size(p["markers"]).alias("k"),
            full_sequence(p["prefix"], col(state), sep_id, max_len).alias("ids"),
            kept_markers(p["markers"], max_len).alias("markers"),
        ),
    )


def pad(ids: Column, length: Column, value: Column) -> Column:
    return F.concat(ids, F.array_repeat(value, length - F.size(ids)))


def longest(rows: Column, field: str) -> Column:
    return F.array_max(F.transform(rows, lambda s: F.size(s[field])))


def collate(df: DataFrame, seqs: Column | str, pad_id: Column | str) -> DataFrame:
    """Pad the sequences of a request to one block: add ``batch`` and its dimensions.

    A request is a batch, so the longest row is found inside the row and nothing is shuffled.
    """
    rows = col(seqs)
    length, width = F.col("max_ids"), F.col("max_options")
    return (
        df.withColumn("n_rows", F.size(rows))
        .withColumn("max_ids", longest(rows, "ids"))
        .withColumn("max_options", longest(rows, "markers"))
        .withColumn(
            "batch",
            F.transform(
                rows,
                lambda s: F.struct(
                    s["qid"].alias("qid"),
                    s["qcode"].alias("qcode"),
                    pad(s["ids"], length, col(pad_id)).alias("input_ids"),
                    pad(F.transform(s["ids"], lambda _: F.lit(1)), length, F.lit(0)).alias(
                        "attention_mask"
                    ),
                    pad(s["markers"], width, F.lit(0)).alias("marker_pos"),
                    pad(F.transform(s["markers"], lambda _: F.lit(1)), width, F.lit(0)).alias(
                        "marker_mask"
                    ),
                ),
            ),
        )
    )


def input_tokens(seqs: Column | str) -> Column:
    """Token usage of a request: the summed lengths of its sequences."""
    return F.aggregate(col(seqs), F.lit(0), lambda a, s: a + F.size(s["ids"]))


def dropped_tokens(state: Column, prefix: Column, max_len: Column) -> Column:
    """Context ids that do not fit into the window."""
    return F.greatest(F.lit(0), F.size(state) - context_room(prefix, max_len))


def truncation_report(df: DataFrame, *by: str) -> DataFrame:
    """How often and how much context is cut, per ``by``; needs a ``dropped`` column."""
    cut = F.when(F.col("dropped") > 0, 1).otherwise(0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cut).alias("n_cut"),
        F.sum("dropped").alias("tokens_dropped"),
        F.max("dropped").alias("max_dropped"),
    ).withColumn("share_cut", F.col("n_cut").cast("double") / F.col("n").cast("double"))


#: Size of a quantile sketch: exact up to about as many rows, then within 0.1 % of the rank.
SKETCH = 4096


def truncation_sketches(df: DataFrame, *by: str) -> DataFrame:
    """Per ``by``: rows and a mergeable sketch of ``dropped``, to be rolled up later."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"kll_sketch_agg_bigint(cast(dropped AS bigint), {SKETCH})").alias("sketch"))


def truncation_percentiles(sketches: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Percentiles of dropped ids for every prefix of ``by``, totals included, from sketches.

    The sketches are merged, the rows are not read again. Per level: ``by`` (null where summed up),
    ``n`` and one column ``p<share>`` per share: the smallest value that so many rows do not exceed.
    """
    merged = sketches.rollup(*by).agg(
        F.sum("n").alias("n"), F.expr(f"kll_merge_agg_bigint(sketch, {SKETCH})").alias("sketch"))
    return merged.select(*by, "n", *[
        F.expr(f"kll_sketch_get_quantile_bigint(sketch, {share}D)").alias(f"p{round(share * 100)}")
        for share in shares])


# --- batches across requests ------------------------------------------------------------------


def length_batches(
    rows: DataFrame, length: str, order: list[str], budget: int, folder: str, step: int = 32
) -> DataFrame:
    """Add ``batch_id``: sequences of about the same length, ``budget`` padded ids a batch.

    Lengths fall into classes of ``step`` ids. A batch holds rows of one class, as many as fit if
    each is padded to the class's upper end (at least one), in order of length and ``order``, which
    must identify a row. Batches are numbered without gaps from 0, shortest first. Lengths are
    those of a token window, so there are few classes.

    Places are exact without a window over rows: the table is range-partitioned and sorted, written
    to ``folder`` with the place of each row in its partition, and places are moved by the row
    counts of the partitions before (a table of partitions and classes).
    """
    keys = ["_class", length, *order]
    laid = (
        rows.withColumn("_class", F.expr(f"cast((greatest(`{length}`, 1) - 1) div {step} as int)"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    laid = stored(laid, folder)
    counts = laid.groupBy("_class", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    a_batch = F.expr(f"greatest(1L, {budget}L div ((_class + 1) * {step}))")
    classes = counts.groupBy("_class").agg(F.sum("n").alias("n")).withColumn("a_batch", a_batch)
    lower = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)  # a row per class
    batches = F.expr("(n + a_batch - 1) div a_batch")
    classes = classes.select(
        "_class", "a_batch", F.coalesce(F.sum(batches).over(lower), F.lit(0)).alias("start"))
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        F.broadcast(classes), "_class")
    return (
        laid.join(F.broadcast(cells.drop("n")), ["_class", "_part"])
        .withColumn("batch_id", F.expr("start + (before + _place - first) div a_batch"))
        .drop("_class", "_part", "_place", "first", "before", "a_batch", "start")
    )


def batch_report(batches: DataFrame, length: str, width: str) -> DataFrame:
    """Per batch of ``length_batches``: rows, longest row, most options, ids before and after padding."""
    return batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(length).alias("max_ids"),
        F.max(width).alias("max_options"), F.sum(length).alias("ids"),
    ).withColumn("padded_ids", F.col("n_rows") * F.col("max_ids"))
