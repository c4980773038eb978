"""Typed questions: presets, normalised questions, option texts, heads, workflows.

A spec is one row with ``questions ARRAY<STRUCT>`` in request order. Contexts meet it in one
lookup join, and everything that concerns a single question runs over that array, so a
request never has to be exploded and grouped again. ``question_rows`` gives the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.pyjson import quote
from askframe.functions.text import col
from askframe.sources.tables import small_table

QUESTION_TYPE = (
    "struct<qid:string,qtype:string,instructions:string,keys:array<string>,"
    "descs:array<string>,levels:array<string>,legend:array<string>,"
    "noul_false:string,noul_true:string>"
)
SPEC_SCHEMA = f"spec_id string, questions array<{QUESTION_TYPE}>"


def question_row(qid: str, qtype: str, instructions: str, criteria=None) -> tuple:
    """One question of a spec that is written down in code, as a row of QUESTION_TYPE."""
    keys, descs, levels, no, yes = [], [], [], None, None
    if qtype == "choice":
        pairs = criteria if isinstance(criteria, dict) else dict.fromkeys(criteria)
        keys, descs = list(pairs), list(pairs.values())
    elif qtype == "score":
        levels = list(criteria)
    elif criteria:
        no, yes = criteria.get("false"), criteria.get("true")
    return (qid, qtype, instructions, keys, descs, levels, None, no, yes)


def specs_from(spark: SparkSession, specs: dict[str, dict[str, tuple]]) -> DataFrame:
    """Specs table from {spec id: {question id: (type, instructions, criteria)}}."""
    rows = [
        (name, [question_row(qid, *definition) for qid, definition in questions.items()])
        for name, questions in specs.items()
    ]
    return small_table(spark, rows, SPEC_SCHEMA).withColumn(
        "questions", F.transform("questions", with_legend)
    )


def with_legend(q: Column) -> Column:
    """Fill the JSON texts of the rubric levels from the level texts."""
    return q.withField("legend", F.transform(q["levels"], quote))


def presets(spark: SparkSession) -> DataFrame:
    """The ready-made specs: spec_id, questions. Five rows by construction."""
    return specs_from(spark, fixed.PRESETS)


def preset_listing(spark: SparkSession) -> DataFrame:
    rows = [
        (name, text, f"/v1/presets/{name}")
        for name, text in sorted(fixed.PRESET_DESCRIPTIONS.items())
    ]
    return small_table(spark, rows, "name string, description string, endpoint string")


def question_rows(df: DataFrame, questions: str = "questions") -> DataFrame:
    """Long form: one row per question with ``q_pos`` from 0 and the question's fields."""
    rest = [c for c in df.columns if c != questions]
    return df.select(*rest, F.posexplode(questions).alias("q_pos", "q")).select(
        *rest, "q_pos", "q.*"
    )


def with_categories(df: DataFrame, preset: Column | str, categories: Column | str) -> DataFrame:
    """Replace the labels of the email preset's ``category`` question.

    ``categories`` is ARRAY<STRUCT<key, val>>; null or empty keeps the standard labels.
    """
    cats = col(categories)
    custom = (col(preset) == "email") & (F.size(cats) > 0)

    def replaced(q: Column) -> Column:
        changed = q.withField("keys", cats["key"]).withField("descs", cats["val"])
        return F.when(q["qid"] == "category", changed).otherwise(q)

    return df.withColumn(
        "questions",
        F.when(custom, F.transform("questions", replaced)).otherwise(F.col("questions")),
    )


def option_texts(q) -> Column:
    """Option texts in label order. ``q`` is a question struct or anything indexable by name."""
    described = F.zip_with(
        q["keys"],
        q["descs"],
        lambda k, d: F.when(F.coalesce(d, F.lit("")) == "", k).otherwise(
            F.concat(k, F.lit(": "), d)
        ),
    )
    levels = F.transform(
        q["levels"],
        lambda text, i: F.concat(
            F.lit("level "), i.cast("string"), F.lit(": "), F.coalesce(text, F.lit("null"))
        ),
    )
    sides = F.array(
        F.concat(F.lit("false: "), _or_default(q["noul_false"], fixed.NOUL_FALSE)),
        F.concat(F.lit("true: "), _or_default(q["noul_true"], fixed.NOUL_TRUE)),
    )
    return (
        F.when(q["qtype"] == "choice", described)
        .when(q["qtype"] == "score", levels)
        .otherwise(sides)
    )


def _or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def option_count(q) -> Column:
    return (
        F.when(q["qtype"] == "choice", F.size(q["keys"]))
        .when(q["qtype"] == "score", F.size(q["levels"]))
        .otherwise(F.lit(2))
    )


def type_code(qtype: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in fixed.QTYPES]), col(qtype)).cast("int") - 1


def strip_mask(text: Column, mask: Column | str = fixed.DEFAULT_MASK) -> Column:
    """The mask token never reaches the model from outside."""
    mask = F.lit(mask) if isinstance(mask, str) else mask
    return F.replace(text, mask, F.lit(" "))


def head_text(q, mask: Column | str = fixed.DEFAULT_MASK) -> Column:
    return F.concat(q["qtype"], F.lit(" question: "), strip_mask(q["instructions"], mask))


def _json_object(keys: Column, values: Column) -> Column:
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(quote(k), F.lit(": "), v))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def spec_json(questions: Column | str) -> Column:
    """The spec object of ARRAY<question> as JSON text, questions and labels in order.

    Labels without a description are written as null; a yes/no question only has criteria
    where it describes a side.
    """

    def described(text: Column) -> Column:
        return F.coalesce(quote(text), F.lit("null"))

    def definition(q: Column) -> Column:
        sides = F.map_filter(
            F.create_map(
                F.lit("true"), quote(q["noul_true"]), F.lit("false"), quote(q["noul_false"])
            ),
            lambda _, v: v.isNotNull(),
        )
        criteria = (
            F.when(
                q["qtype"] == "choice",
                _json_object(q["keys"], F.transform(q["descs"], described)),
            )
            .when(
                q["qtype"] == "score",
                F.concat(F.lit("["), F.array_join(q["legend"], ", "), F.lit("]")),
            )
            .when(F.size(sides) > 0, _json_object(F.map_keys(sides), F.map_values(sides)))
        )
        return F.concat(
            F.lit('{"type": '),
            quote(q["qtype"]),
            F.lit(', "instructions": '),
            quote(q["instructions"]),
            F.coalesce(F.concat(F.lit(', "criteria": '), criteria), F.lit("")),
            F.lit("}"),
        )

    rows = col(questions)
    return _json_object(rows["qid"], F.transform(rows, definition))


def question_ids(questions: Column | str) -> Column:
    return col(questions)["qid"]


def workflow_of(qids: Column) -> Column:
    """Workflow whose question-id set equals these ids exactly, or null."""
    ids = F.array_sort(F.array_distinct(qids))
    found = F.lit(None).cast("string")
    for name, signature in sorted(fixed.WORKFLOWS.items(), reverse=True):
        ids_of = F.array(*[F.lit(x) for x in sorted(signature)])
        found = F.when(ids == ids_of, F.lit(name)).otherwise(found)
    return found
