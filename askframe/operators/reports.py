"""Reports over decision tables: summaries, graph drift, parity of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.text import col
from askframe.sources.raw_json import json_fields


def decision_summary(decisions: DataFrame, *by: str) -> DataFrame:
    """Counts and means per question and choice; map-side aggregates absorb hot questions."""
    return decisions.groupBy(*by, "qid", "choice").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg("noul").alias("mean_noul"),
        F.avg("confidence").alias("mean_confidence"),
    )


def largest_difference(a: Column | str, b: Column | str) -> Column:
    """Largest absolute difference of two float arrays."""
    return F.array_max(
        F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    )


def logit_drift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: largest difference of logits and act logits of two graph variants, and whether
    it is within the gate. ``keys`` identify a question of a request in both tables."""
    other = right.select(*keys, F.col("logits").alias("_z"), F.col("act_logits").alias("_a"))
    both = left.join(other, keys)
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(largest_difference("logits", "_z")).alias("max_logit_diff"),
        F.max(largest_difference("act_logits", "_a")).alias("max_act_diff"),
    ).withColumn(
        "within_gate",
        F.greatest("max_logit_diff", "max_act_diff") <= F.lit(fixed.DRIFT_GATE),
    )


def probability_movement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How far probabilities move between two graph variants, per question type.

    Both sides carry ``qtype`` and the calibrated probabilities ``p``; ``keys`` identify a question
    of a request. Per type: questions, largest and mean movement of a probability, the question
    that moved most (ties to the smallest key), and how many have another most likely option.
    """
    other = right.select(*keys, F.col("p").alias("_p"))
    top = lambda p: F.array_position(p, F.array_max(p))
    moved = left.join(other, keys).select(
        *keys, "qtype", largest_difference("p", "_p").alias("by"), (top("p") != top("_p")).alias("flips"))
    most = F.struct((-F.col("by")).alias("by"), *keys)
    return moved.groupBy("qtype").agg(
        F.count(F.lit(1)).alias("n"), F.max("by").alias("max_movement"),
        F.avg("by").alias("mean_movement"), F.min(most).alias("most"),
        F.sum(F.col("flips").cast("int")).alias("n_flips"),
    ).select("qtype", "n", "max_movement", "mean_movement", *[F.col("most")[k].alias(k) for k in keys], "n_flips")


def answer_fields(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Flat form of decisions: keys, field, number, text; one row per filled field."""
    def entry(name, number=None, text=None):
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("field"),
            (F.lit(None).cast("double") if number is None else number).alias("number"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    plain = F.array(
        entry("type", text=F.col("qtype")),
        entry("choice", text=F.col("choice")),
        *[entry(n, F.col(n)) for n in ("score", "noul", "confidence", "act_probability")],
    )
    shares = F.zip_with(
        "prob_keys",
        "probabilities",
        lambda k, p: entry(F.concat(F.lit("probabilities."), k), p),
    )
    levels = F.transform(
        "legend",
        lambda text, i: entry(F.concat(F.lit("legend."), i.cast("string")), text=text),
    )
    none = F.slice(plain, 1, 0)
    rows = F.concat(plain, F.coalesce(shares, none), F.coalesce(levels, none))
    filled = F.filter(rows, lambda r: r["number"].isNotNull() | r["text"].isNotNull())
    return decisions.select(*keys, F.explode(filled).alias("r")).select(*keys, "r.*")


def answer_parity(
    got: DataFrame, want: DataFrame, keys: list[str], tolerance: float = fixed.SCORE_TOLERANCE
) -> DataFrame:
    """Compare two runs field by field: keys, field, got, want, verdict.

    Numbers agree within the tolerance, texts if equal; a field of one side only is
    ``missing`` (wanted, not there) or ``extra``. The join key names a single field, so no
    key is hot however large a case is.
    """
    on = [*keys, "field"]
    a = answer_fields(got, keys).select(
        *on, F.col("number").alias("got"), F.col("text").alias("got_text"), F.lit(1).alias("_a")
    )
    b = answer_fields(want, keys).select(
        *on, F.col("number").alias("want"), F.col("text").alias("want_text"), F.lit(1).alias("_b")
    )
    same = F.when(
        F.col("got").isNotNull() & F.col("want").isNotNull(),
        F.abs(F.col("got") - F.col("want")) <= F.lit(tolerance),
    ).otherwise(F.col("got_text").eqNullSafe(F.col("want_text")))
    return a.join(b, on, "full_outer").select(
        *on,
        "got",
        "want",
        "got_text",
        "want_text",
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_b").isNull(), "extra")
        .when(same, "ok")
        .otherwise("differs")
        .alias("verdict"),
    )


def document_fields(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Long form of a JSON column: keys, path, kind, size, number, text. Rows without a document,
    or with a text that is no JSON, have one row of kind ``invalid``."""
    none = F.array(F.struct(
        F.lit("").alias("path"), F.lit("invalid").alias("kind"), F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("double").alias("number"), col(document).alias("text")))
    fields = F.coalesce(json_fields(col(document)), none)
    return df.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.*")


def document_parity(
    got: DataFrame, want: DataFrame, keys: list[str], document: str,
    tolerance: float = fixed.SCORE_TOLERANCE,
) -> DataFrame:
    """Structural difference of two tables of JSON documents: keys, path, got, want, verdict.

    Objects are compared field by field at any depth and must have as many fields, numbers within
    the tolerance, anything else (arrays as a whole) as equal text. A null counts as 0 beside a
    number and as an object without fields beside an object. A path of one side only is ``missing``
    (wanted, not there) or ``extra``. The join key names one value, so no key is hot however
    large a document is; ``keys`` must identify a document on each side.
    """
    on = [*keys, "path"]
    sides = []
    for df, mark in ((got, "g"), (want, "w")):
        fields = document_fields(df, keys, document)
        sides.append(fields.select(*on, F.struct("kind", "size", "number", "text").alias(mark)))
    g, w = F.col("g"), F.col("w")
    same = (
        F.when(g["number"].isNotNull() & w["number"].isNotNull(),
               F.abs(g["number"] - w["number"]) <= F.lit(tolerance))
        .when(g["size"].isNotNull() & w["size"].isNotNull(), g["size"] == w["size"])
        .otherwise((g["kind"] == w["kind"]) & g["text"].eqNullSafe(w["text"]))
    )

    def shown(side: Column) -> Column:
        return F.coalesce(side["text"], side["number"].cast("string"), side["kind"])

    return sides[0].join(sides[1], on, "full_outer").select(
        *on, shown(g).alias("got"), shown(w).alias("want"),
        F.when(g.isNull(), "missing").when(w.isNull(), "extra")
        .when(same, "ok").otherwise("differs").alias("verdict"))


def equal_documents(parity: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: values compared, how many do not agree, and whether all do."""
    bad = F.when(F.col("verdict") != "ok", 1).otherwise(0)
    return parity.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(bad).alias("n_bad")
    ).withColumn("equal", F.col("n_bad") == 0)
