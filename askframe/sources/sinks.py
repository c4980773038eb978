"""Answers as tables and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions.pyjson import quote
from askframe.functions.text import col


def round4_text(x: Column) -> Column:
    """JSON text of a number with 4 decimals at most: ``1.0``, ``0.856``."""
    return F.regexp_replace(x.cast("decimal(20,4)").cast("string"), r"0{1,3}$", "")


def _object(pairs: Column) -> Column:
    """JSON object of ARRAY<STRUCT<k: text, v: JSON text>>."""
    body = F.array_join(
        F.transform(pairs, lambda p: F.concat(quote(p["k"]), F.lit(": "), p["v"])), ", "
    )
    return F.concat(F.lit("{"), body, F.lit("}"))


def answer_json(a) -> Column:
    """JSON object of one answer; ``a`` is an answer struct."""
    shares = _object(
        F.zip_with(
            a["prob_keys"],
            a["probabilities"],
            lambda k, p: F.struct(k.alias("k"), round4_text(p).alias("v")),
        )
    )
    legend = _object(
        F.transform(
            a["legend"],
            lambda text, i: F.struct(i.cast("string").alias("k"), text.alias("v")),
        )
    )
    value = (
        F.when(
            a["qtype"] == "choice",
            F.concat(F.lit('"choice": '), quote(a["choice"]), F.lit(', "probabilities": '), shares),
        )
        .when(
            a["qtype"] == "score",
            F.concat(
                F.lit('"score": '),
                round4_text(a["score"]),
                F.lit(', "legend": '),
                legend,
                F.lit(', "probabilities": '),
                shares,
            ),
        )
        .otherwise(F.concat(F.lit('"noul": '), round4_text(a["noul"])))
    )
    return F.concat(
        F.lit('{"type": '),
        quote(a["qtype"]),
        F.lit(", "),
        value,
        F.lit(', "confidence": '),
        round4_text(a["confidence"]),
        F.lit(', "action": {"act_probability": '),
        round4_text(a["act_probability"]),
        F.lit("}}"),
    )


def answers_json(answers: Column | str) -> Column:
    """JSON object of the answers of a request, keyed by question id in request order."""
    return _object(
        F.transform(
            col(answers), lambda a: F.struct(a["qid"].alias("k"), answer_json(a).alias("v"))
        )
    )


def routing_json(route: Column | str) -> Column:
    """JSON of a routing decision; what is unknown is written as null."""
    r = col(route)
    fields = F.struct(*[r[f].alias(f) for f in ("model", "repo", "reason", "detection", "workflow")])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def result_json(df: DataFrame, out: str = "result") -> DataFrame:
    """Add the whole result of a request as JSON: model, answers, usage and, where the rows
    carry a ``route``, the routing decision. Rows with an error get null."""
    routing = F.lit("")
    if "route" in df.columns:
        routing = F.concat(F.lit(', "routing": '), routing_json("route"))
    return df.withColumn(
        out,
        F.concat(
            F.lit('{"model": '),
            quote(F.col("model")),
            F.lit(', "answers": '),
            answers_json("answers"),
            F.lit(', "usage": {"input_tokens": '),
            F.col("input_tokens").cast("string"),
            F.lit(', "output_tokens": 0}'),
            routing,
            F.lit("}"),
        ),
    )


def regroup(decisions: DataFrame, key: str = "request_id") -> DataFrame:
    """Ordered answers per request from the long form.

    A group is one request's questions, so its size is that of a spec. Pipelines that still
    have the array per request do not need this shuffle.
    """
    fields = [c for c in decisions.columns if c != key]
    ordered = F.sort_array(F.collect_list(F.struct("q_pos", *[f for f in fields if f != "q_pos"])))
    return decisions.groupBy(key).agg(ordered.alias("answers"))


def write_results(df: DataFrame, path: str, batch: str = "0") -> DataFrame:
    """Parquet by batch and model under ``path``; the manifest of what the batch wrote.

    Rows of a model are brought together and cut to the session's target file size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): adaptive execution splits a model that a
    third of the rows have and joins small ones, so files follow bytes, not tasks. A batch that is
    written again replaces its own files and leaves those of other batches. The manifest has a row
    per model: files, rows.
    """
    own = f"{path.rstrip('/')}/batch={batch}"
    df.hint("rebalance", "model").write.mode("overwrite").partitionBy("model").parquet(own)
    written = df.sparkSession.read.schema(df.schema).parquet(own)
    return written.groupBy("model").agg(
        F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("rows"))
