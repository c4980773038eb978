"""End-to-end plans: requests and specs in, routed, scored and calibrated answers out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.calibrate import ANSWER_TYPE, answers, temperature_for
from askframe.functions.plan import seal
from askframe.operators.route import RouterOptions, route
from askframe.operators.score import score, token_ids
from askframe.operators.sequence import input_tokens, question_prefix, sequences
from askframe.operators.specs import (
    QUESTION_TYPE,
    head_text,
    option_count,
    option_texts,
    question_ids,
    question_rows,
    strip_mask,
    type_code,
    workflow_of,
)
from askframe.sources.catalog import effective_max_len, max_len_error, with_checkpoint
from askframe.sources.requests import BAD_REQUEST, UNAVAILABLE, failure_class
from askframe.sources.tables import lookup_join, stored


QUESTIONS_TYPE = f"array<{QUESTION_TYPE}>"


def keyed_by_spec(df: DataFrame) -> DataFrame:
    """Requests with ``spec_id``, the hash of their questions, and ``questions`` as the text that
    is hashed, so that later passes over kept requests need not write it again."""
    return df.withColumn("questions", F.to_json(F.struct("questions"))).withColumn(
        "spec_id", F.sha2("questions", 256))


def specs_of(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with spec_id, distinct specs) of ``keyed_by_spec``.

    Equal specs meet in the map-side hash aggregate already, however many requests share one;
    they are grouped by their text and read from it again, and ``n`` counts their requests.
    """
    specs = (
        keyed.filter(F.col("questions") != "{}")  # what a request without questions gives
        .groupBy("spec_id", "questions").agg(F.count(F.lit(1)).alias("n"))
        .select("spec_id", F.from_json("questions", f"questions {QUESTIONS_TYPE}")["questions"]
                .alias("questions"), "n")
    )
    return keyed.drop("questions"), specs


def intern_specs(df: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests that bring their own questions: (requests with spec_id, distinct specs).

    With ``store`` the distinct specs are written there.
    """
    rows, specs = specs_of(keyed_by_spec(df))
    return rows, stored(specs, store) if store else specs


def spec_prefixes(
    specs: DataFrame, catalog: DataFrame, encode: Callable[[Column, Column], Column]
) -> DataFrame:
    """spec_id, model, ``prefixes``: the question prefixes of a spec for each checkpoint.

    Runs once per question and checkpoint, independent of the number of requests.
    """
    q = F.struct("qid", "qtype", "instructions", "keys", "descs", "levels",
                 "noul_false", "noul_true")
    checkpoints = catalog.select("model", "head_max_len", "cls_id", "sep_id", "mask_id", "mask")
    per_model = (
        question_rows(specs)
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in fixed.MODEL_NAMES])))
        .join(F.broadcast(checkpoints.dropDuplicates(["model"])), "model")  # a row per known model
        .withColumn("_head", head_text(q, F.col("mask")))
        .withColumn(
            "_options",
            F.transform(
                option_texts(q), lambda o: F.concat(F.lit(" "), strip_mask(o, F.col("mask")))
            ),
        )
    )
    keys = ["spec_id", "model", "q_pos"]
    # One UDF call per text: the head as option -1, then the options in order.
    texts = F.concat(F.array("_head"), F.col("_options"))
    ids = (
        per_model.select(*keys, F.posexplode(texts).alias("pos", "text"))
        .withColumn("ids", encode(F.col("text"), F.col("model")))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("_ids"))
        .withColumn("_ids", F.col("_ids")["ids"])
    )
    rows = (
        per_model.drop("_head", "_options")
        .join(ids, keys)
        .withColumn("_head_ids", F.element_at("_ids", 1))
        .withColumn("_option_ids", F.slice("_ids", F.lit(2), F.size("_ids")))
    )
    rows = question_prefix(
        rows, "_head_ids", "_option_ids", "cls_id", "sep_id", "mask_id", "head_max_len"
    )
    entry = F.struct(
        "q_pos", "qid", type_code("qtype").alias("qcode"), "prefix", "markers"
    )
    return rows.groupBy("spec_id", "model").agg(
        F.sort_array(F.collect_list(entry)).alias("prefixes")
    )


def _hint(df: DataFrame, name: str, dtype: str = "string") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def admit(
    requests: DataFrame,
    specs: DataFrame,
    catalog: DataFrame,
    options: RouterOptions = RouterOptions(),
    max_len: int = 0,
    bounded_specs: bool = False,
) -> DataFrame:
    """Route every request and find what keeps it from being answered; nothing is scored.

    ``requests`` may carry ``error`` and ``error_class`` of an earlier step (``parse_requests``);
    they stay, and come before anything found here. Adds ``workflow``, ``route``, ``model``,
    ``checkpoint``, ``window``, ``asked``, ``error`` and ``error_class``.
    """
    for name in ("model", "task", "lang", "error", "error_class"):
        requests = _hint(requests, name)
    requests = _hint(requests, "max_len", "int").withColumnsRenamed(
        {"error": "given_error", "error_class": "given_class", "max_len": "asked"})
    known = specs.select(
        "spec_id", workflow_of(question_ids("questions")).alias("workflow"),
        F.col("questions").isNotNull().alias("has_spec"))
    df = lookup_join(
        requests, known, "spec_id", bounded=bounded_specs,
        row_id="request_id" if "request_id" in requests.columns else None)
    df = route(df, "context_text", "model", "task", "lang", "workflow", options=options)
    df = df.drop("model", "task", "lang")
    df = with_checkpoint(df.withColumn("model", F.col("route.model")), catalog)
    here = F.col("checkpoint")
    no_spec = ~F.coalesce("has_spec", F.lit(False))
    found = F.coalesce(
        F.when(no_spec, 'missing "spec" (object of typed questions)'),
        F.col("route.error"),
        F.when(
            here.isNull(), F.concat(F.lit("load "), F.col("model"), F.lit(": no checkpoint"))
        ),
        max_len_error(F.col("asked"), here["head_max_len"]),
    )
    fresh_class = (
        F.when(no_spec, BAD_REQUEST)
        .when(here.isNull() & F.col("model").isNotNull(), UNAVAILABLE)
        .otherwise(failure_class(found))
    )
    given = F.col("given_error").isNotNull()
    return seal(
        df.withColumn("window", effective_max_len(F.col("asked"), F.lit(max_len), here["max_len"]))
        .withColumn("error", F.coalesce("given_error", found))
        .withColumn(
            "error_class",
            F.when(given, F.coalesce("given_class", F.lit(BAD_REQUEST))).otherwise(fresh_class)),
        "window", "error", "error_class", drop=("given_error", "given_class", "has_spec"))


def route_requests(requests: DataFrame, options: RouterOptions = RouterOptions()) -> DataFrame:
    """Parsed requests with ``route``, null for those that came with an error, which they keep; a
    routing error is added."""
    own = question_ids(F.coalesce("questions", F.expr("array()").cast(QUESTIONS_TYPE)))
    df = requests.withColumn("workflow", workflow_of(own))
    df = route(df, "context_text", "model", "task", "lang", "workflow", options=options)
    found = F.col("route.error")
    return df.withColumn(
        "route", F.when(F.col("error").isNull(), F.col("route"))
    ).withColumn(
        "error_class", F.coalesce("error_class", F.when(F.col("error").isNull(), failure_class(found)))
    ).withColumn("error", F.coalesce("error", found)).drop("workflow")


def predict(
    requests: DataFrame,
    specs: DataFrame,
    catalog: DataFrame,
    load_encoder,
    load_scorer,
    options: RouterOptions = RouterOptions(),
    max_len: int = 0,
    max_tokens: int = 16384,
    bounded_specs: bool = False,
) -> DataFrame:
    """Answer every question of every request.

    ``requests``: request_id, spec_id, context_text, state_text and optional model, task, lang,
    max_len, error, error_class. ``specs``: spec_id, questions. ``catalog``: see ``read_catalog``.
    Result: one row per request with route, answers (in question order), input_tokens, error
    and error_class; a request that came with an error keeps it and has no answers. Requests are
    routed first, and only then meet the prefixes of their spec for their own checkpoint.
    """
    encode = token_ids(load_encoder)
    df = admit(requests, specs, catalog, options, max_len, bounded_specs)
    df = df.drop("workflow")
    prepared = spec_prefixes(specs, catalog, encode).withColumnRenamed("prefixes", "_prefixes")
    # The questions come with them: both are read only for rows without an error.
    wanted = prepared.join(specs.select("spec_id", "questions"), "spec_id")
    df = df.withColumn("_served", F.when(F.col("error").isNull(), F.col("model")))
    wanted = wanted.withColumnRenamed("model", "_served")
    df = lookup_join(
        df, wanted, ["spec_id", "_served"], bounded=bounded_specs, row_id="request_id",
        hot_by="spec_id").drop("_served")
    here = F.col("checkpoint")
    df = (
        df.withColumn("pad_id", here["pad_id"])
        .withColumn(
            "_state",
            encode(
                F.when(F.col("error").isNull(), strip_mask(F.col("state_text"), here["mask"])),
                F.col("model"),
            ),
        )
        .withColumn(
            "sequences", sequences("_prefixes", "_state", here["sep_id"], F.col("window"))
        )
    )
    lost = F.filter(
        F.arrays_zip("sequences", "_prefixes"),
        lambda z: F.size(z["sequences"]["markers"]) != F.size(z["_prefixes"]["markers"]),
    )
    overflow = F.concat(
        F.lit('question "'),
        F.try_element_at(lost, F.lit(1))["sequences"]["qid"],
        F.lit('" options exceed head_max_len='),
        here["head_max_len"].cast("string"),
    )
    df = (
        seal(df, "sequences")
        .withColumn(
            "error_class",
            F.coalesce("error_class", F.when(F.col("error").isNull(), failure_class(overflow))))
        .withColumn("error", F.coalesce("error", overflow))
        .withColumn("input_tokens", input_tokens("sequences"))
        .withColumn("sequences", F.when(F.col("error").isNull(), F.col("sequences")))
    )
    temperatures = F.transform(
        "questions",
        lambda q: temperature_for(
            q["qtype"], option_count(q), here["temperature"], here["temperature_by_options"]
        ),
    )
    kept = df.withColumn("temperatures", temperatures).drop(
        "_prefixes", "_state", "asked", "window", "checkpoint",
        "context_text", "state_text",
    )
    scored = score(kept, load_scorer, max_tokens=max_tokens)
    answered = answers("questions", "logits", "act_logits", F.col("temperatures"))
    return scored.withColumn(
        "answers",
        F.when(F.col("error").isNull(), answered).cast(f"array<{ANSWER_TYPE}>"),
    ).drop("questions", "logits", "act_logits", "temperatures", "pad_id")


def decisions(results: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per request and question."""
    keep = keep or ("request_id",)
    return results.select(
        *keep, F.posexplode("answers").alias("q_pos", "a"), "model", "input_tokens"
    ).select(*keep, "q_pos", "a.*", "model", "input_tokens")
