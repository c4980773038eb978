"""Raw requests: JSON bodies to typed request columns, with ordered validation.

``parse_requests`` never drops a row. Each row carries ``error`` and ``error_class``; the
first failed check in request order decides. ``split_valid`` separates the dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.calibrate import let
from askframe.functions.plan import aside, seal
from askframe.functions.pyjson import ascii_escape, context_text, quote, state_text
from askframe.functions.text import col, quoted_name
from askframe.operators.specs import QUESTION_TYPE, with_categories
from askframe.sources.raw_json import (
    child,
    children,
    flatten_text,
    node_json,
    node_text,
    parse_json,
)

BAD_REQUEST, NOT_FOUND = "bad_request", "not_found"
UNAVAILABLE, INTERNAL = "unavailable", "internal"

_EXPECTED = (
    "(expected context, spec, model, lang, task, max_len; "
    "state/questions/categories are also accepted)"
)


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def _last_field(fields: Column, names: list[str]) -> Column:
    return F.try_element_at(F.filter(fields, lambda f: f["key"].isin(names)), F.lit(-1))


def whole_number(node: Column) -> Column:
    """Value of a number written as an integer, else null."""
    is_int = (node["kind"] == "number") & node["text"].rlike(r"^-?[0-9]+$")
    return F.when(is_int, node["text"].try_cast("bigint"))


def _field_error(f: Column) -> Column:
    name = quoted_name(f["key"])
    limit = F.coalesce(whole_number(f), F.lit(-1))
    return (
        F.when(
            f["key"].isin(fixed.HINT_FIELDS) & ~f["kind"].isin("null", "string"),
            F.concat(F.lit("field "), name, F.lit(" must be a string")),
        )
        .when(
            (f["key"] == "max_len")
            & (f["kind"] != "null")
            & ((limit < 0) | (limit > fixed.MAX_CONTEXT)),
            f'field "max_len" must be an integer between 1 and {fixed.MAX_CONTEXT} (tokens), '
            "e.g. 2048 or 4096",
        )
        .when(
            ~f["key"].isin(fixed.REQUEST_FIELDS),
            F.concat(F.lit("unknown field "), name, F.lit(" " + _EXPECTED)),
        )
    )


def body_error(body: Column, invalid: Column, kind: Column, fields: Column) -> Column:
    """First problem of a request body, in the order of its fields."""
    return (
        F.when(
            F.coalesce(body, F.lit("")) == "",
            'empty request body; send JSON with "context" and "spec"',
        )
        .when(invalid.isNotNull(), F.concat(F.lit("invalid JSON: "), invalid))
        .when(kind != "object", "request body must be a JSON object")
        .otherwise(
            F.coalesce(
                _first(F.transform(fields, _field_error)),
                F.when(
                    _last_field(fields, fixed.CONTEXT_FIELDS).isNull(),
                    'missing "context" (a string, object or array describing the state)',
                ),
            )
        )
    )


# --- specs ------------------------------------------------------------------------------------


def _question_error(q: Column, parts: Column) -> Column:
    name = F.concat(F.lit("question "), quoted_name(q["key"]), F.lit(": "))
    qtype, criteria, items = parts["type"], parts["criteria"], parts["items"]
    has_criteria = criteria.isNotNull()
    kind = criteria["kind"]
    choice = qtype["text"] == "choice"
    score = qtype["text"] == "score"
    problem = (
        F.when(q["kind"] != "object", "definition must be an object")
        .when(
            qtype.isNull() | (qtype["kind"] != "string"),
            'missing string field "type" (choice|score|noul)',
        )
        .when(
            ~qtype["text"].isin(fixed.QTYPES),
            F.concat(F.lit("unknown type "), quoted_name(qtype["text"]), F.lit(" (choice|score|noul)")),
        )
        .when(parts["instructions"].isNull(), 'missing field "instructions"')
        .when(
            choice & (~has_criteria | (kind == "null")),
            'choice questions need "criteria" (object or array of labels)',
        )
        .when(
            choice & (kind == "array") & F.exists(items, lambda i: i["kind"] != "string"),
            "criteria list items must be strings",
        )
        .when(
            choice & ~kind.isin("array", "object"),
            F.concat(F.lit("criteria must be an object or array, got "), kind),
        )
        .when(choice & (F.size(items) == 0), "choice questions need at least one option")
        .when(
            score & (~has_criteria | (kind != "array")),
            'score questions need "criteria" as an array of rubric levels',
        )
        .when(
            score & (F.size(items) < 2), "score questions need at least two rubric levels"
        )
    )
    return let(problem, lambda p: F.when(p.isNotNull(), F.concat(name, p)))


def _described(canonical: Column, node: Column) -> Column:
    """Text of a criterion; null stays null."""
    return F.when(node["kind"] != "null", node_text(canonical, node))


def _question(canonical: Column, q: Column, parts: Column) -> Column:
    qtype, criteria, items = parts["type"]["text"], parts["criteria"], parts["items"]
    instructions = parts["instructions"]
    none = F.array().cast("array<string>")
    listed = criteria["kind"] == "array"
    labels = F.array_distinct(items["text"])
    is_noul = (qtype == "noul") & (criteria["kind"] == "object")
    legend = F.transform(
        items,
        lambda i: F.when(i["kind"] == "string", quote(i["text"])).otherwise(
            node_json(canonical, i)
        ),
    )
    return F.struct(
        q["key"].alias("qid"),
        qtype.alias("qtype"),
        F.when(instructions["kind"] == "string", instructions["text"])
        .otherwise(ascii_escape(node_json(canonical, instructions)))
        .alias("instructions"),
        F.when(qtype != "choice", none)
        .when(listed, labels)
        .otherwise(items["key"])
        .alias("keys"),
        F.when(qtype != "choice", none)
        .when(listed, F.transform(labels, lambda _: F.lit(None).cast("string")))
        .otherwise(F.transform(items, lambda i: _described(canonical, i)))
        .alias("descs"),
        F.when(qtype == "score", F.transform(items, lambda i: node_text(canonical, i)))
        .otherwise(none)
        .alias("levels"),
        F.when(qtype == "score", legend).otherwise(none).alias("legend"),
        F.when(is_noul, _described(canonical, child(items, "false"))).alias("noul_false"),
        F.when(is_noul, _described(canonical, child(items, "true"))).alias("noul_true"),
    )


def parsed_questions(nodes: Column, canonical: Column, spec: Column) -> Column:
    """ARRAY<STRUCT<error, question>> of a spec node, in order."""

    names = ("type", "criteria", "instructions")

    def one(q: Column) -> Column:
        # Each step is bound once, as lambdas are evaluated again wherever they are named.
        def found(kids: Column) -> Column:
            return F.struct(*[child(kids, name).alias(name) for name in names])

        def with_items(known: Column) -> Column:
            items = F.coalesce(
                children(nodes, known["criteria"]), F.slice(nodes, F.lit(1), F.lit(0))
            )
            return F.struct(*[known[name].alias(name) for name in names], items.alias("items"))

        def result(parts: Column) -> Column:
            return F.struct(
                _question_error(q, parts).alias("error"),
                _question(canonical, q, parts).alias("question"),
            )

        return let(let(let(children(nodes, q), found), with_items), result)

    return F.transform(children(nodes, spec), one)


def spec_error(spec: Column, parsed: Column) -> Column:
    return (
        F.when(
            spec["kind"] != "object",
            F.concat(
                F.lit("spec must be a JSON object mapping question ids to definitions, got "),
                spec["kind"],
            ),
        )
        .when(F.size(parsed) == 0, "spec has no questions")
        .otherwise(_first(parsed["error"]))
    )


def with_spec(df: DataFrame) -> DataFrame:
    """Add ``questions`` and ``spec_error`` to rows with ``nodes``, ``canonical``, ``spec_node``."""
    nodes, canonical, spec = (F.col(c) for c in ("nodes", "canonical", "spec_node"))
    parsed = F.when(spec.isNotNull(), parsed_questions(nodes, canonical, spec))
    return (
        df.withColumn("_parsed", parsed)
        .withColumn("spec_error", F.when(spec.isNotNull(), spec_error(spec, F.col("_parsed"))))
        .withColumn(
            "questions",
            F.when(
                F.col("spec_error").isNull(), F.col("_parsed")["question"]
            ).cast(f"array<{QUESTION_TYPE}>"),
        )
        .drop("_parsed")
    )


# --- requests ---------------------------------------------------------------------------------


def typed_requests(df: DataFrame, context: str = "context") -> DataFrame:
    """Request columns of a table whose context is typed: adds context_text and state_text.

    The context may be a string, struct, array or map column; nothing is parsed.
    """
    dtype = df.schema[context].dataType
    return df.withColumn("context_text", context_text(context, dtype)).withColumn(
        "state_text", state_text(context, dtype)
    )


#: Columns that ``parse_requests`` makes for itself.
HELPERS = ("invalid", "kind", "canonical", "nodes", "_fields", "_context", "_body_error", "spec_node",
           "_parsed", "spec_error", "_cats", "_preset")


def parse_requests(
    df: DataFrame,
    body: str = "body",
    endpoint: str = "predict",
    preset: str | None = None,
    presets: DataFrame | None = None,
) -> DataFrame:
    """Typed columns of raw request bodies; all other columns are kept, whatever their names
    (those added here take the place of columns of the same name).

    ``endpoint`` is ``predict`` (a spec is required), ``route`` (a spec is optional) or
    ``preset``: then ``preset`` names the column with the preset's name and ``presets`` is the
    presets table. Adds: state_text, context_text, questions, model, task, lang, max_len,
    error, error_class.
    """
    nodes, canonical, fields = (F.col(c) for c in ("nodes", "canonical", "_fields"))
    context = F.col("_context")
    df, (body, asked), back = aside(
        df, HELPERS, col(body), F.lit(None) if preset is None else col(preset))
    df = parse_json(df, body)
    root = F.try_element_at(nodes, F.lit(1))
    empty = F.slice(nodes, F.lit(1), F.lit(0))
    df = (
        df.withColumn("_fields", F.when(F.col("kind") == "object", children(nodes, root)))
        .withColumn("_fields", F.coalesce(fields, empty))
        .withColumn("_context", _last_field(fields, fixed.CONTEXT_FIELDS))
        .withColumn("spec_node", _last_field(fields, fixed.SPEC_FIELDS))
        .withColumn("_body_error", body_error(body, F.col("invalid"), F.col("kind"), fields))
        .withColumn("state_text", node_text(canonical, context))
        .withColumn("context_text", flatten_text(nodes, context))
    )
    for name in fixed.HINT_FIELDS:
        df = df.withColumn(name, child(fields, name)["text"])
    df = df.withColumn("max_len", whole_number(child(fields, "max_len")).try_cast("int"))

    has_spec = F.col("spec_node").isNotNull()
    if endpoint == "preset":
        categories = child(fields, "categories")
        pairs = F.transform(
            F.when(categories["kind"] == "object", children(nodes, categories)),
            lambda n: F.struct(
                n["key"].alias("key"), _described(canonical, n).alias("val")
            ),
        )
        # One row per known preset at most, whatever the table holds.
        known = presets.where(F.col("spec_id").isin(*fixed.PRESETS)).dropDuplicates(["spec_id"])
        df = (
            df.drop("questions").withColumn("_cats", pairs).withColumn("_preset", asked)
            .join(F.broadcast(known.withColumnRenamed("spec_id", "_preset")), "_preset", "left")
        )
        df = with_categories(df, "_preset", "_cats")
        error = F.coalesce(
            F.col("_body_error"),
            F.when(has_spec, "presets define their own spec; use /v1/predict to pass one"),
        )
        names = " ".join(sorted(fixed.PRESETS))
        missing = F.when(
            F.col("questions").isNull(),
            F.concat(
                F.lit("unknown preset "), quoted_name(asked), F.lit(f"; available: [{names}]")
            ),
        )
        df = df.withColumn("error", F.coalesce(error, missing)).withColumn(
            "error_class",
            F.when(error.isNotNull(), BAD_REQUEST).when(missing.isNotNull(), NOT_FOUND),
        )
        df = df.drop("_cats", "_preset")
    else:
        df = with_spec(df)
        required = F.when(~has_spec, 'missing "spec" (object of typed questions)')
        if endpoint == "route":
            required = F.lit(None).cast("string")
        df = df.withColumn(
            "error", F.coalesce(F.col("_body_error"), required, F.col("spec_error"))
        ).withColumn("error_class", F.when(F.col("error").isNotNull(), BAD_REQUEST))
        df = df.drop("spec_error")
    df = df.drop(
        "invalid", "kind", "canonical", "nodes", "_fields", "_context", "_body_error", "spec_node"
    )
    return back(seal(
        df, "state_text", "context_text", "questions", *fixed.HINT_FIELDS, "max_len", "error",
        "error_class",
    ))


def failure_class(message: Column) -> Column:
    """Class of an error that comes up after validation."""
    bad = ["unknown model", "exceed head_max_len", "max_len"]
    hits = F.lit(False)
    for part in bad:
        hits = hits | F.contains(message, F.lit(part))
    return (
        F.when(message.isNull(), None)
        .when(hits, BAD_REQUEST)
        .when(F.contains(message, F.lit("load ")), UNAVAILABLE)
        .otherwise(INTERNAL)
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.filter(F.col("error").isNull()), df.filter(F.col("error").isNotNull())
