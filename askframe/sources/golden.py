"""Golden files: recorded cases with their sequences and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.pyjson import canonical_jsons, quote
from askframe.operators.reports import answer_parity
from askframe.sources.sinks import answers_json

GOLDEN_SCHEMA = (
    "model string, cases map<string, struct<state:string, questions:string, "
    "sequences:map<string, struct<ids:array<bigint>, markers:array<int>, "
    "options:array<string>>>, "
    "result:struct<answers:map<string, struct<type:string, choice:string, score:double, "
    "noul:double, legend:map<string,variant>, probabilities:map<string,double>, "
    "confidence:double, action:struct<act_probability:double>>>, "
    "usage:struct<input_tokens:int, output_tokens:int>>>>"
)


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per model and case: state and questions as JSON text, sequences, result.

    Files hold one document each, or with ``lines`` one per line, which can be split.
    """
    files = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", not lines).json(path)
    return files.select("model", F.explode("cases").alias("case", "c")).select(
        "model", "case", "c.*"
    )


def golden_sequences(golden: DataFrame) -> DataFrame:
    return golden.select("model", "case", F.explode("sequences").alias("qid", "s")).select(
        "model", "case", "qid", "s.*"
    )


def golden_answers(golden: DataFrame) -> DataFrame:
    """Recorded answers in the decisions layout, ready for ``answer_parity``; levels are JSON texts."""
    rows = golden.select("model", "case", F.explode("result.answers").alias("qid", "a"))
    shares = F.map_entries("a.probabilities")
    # Levels are keyed by their number as text: "10" comes after "2".
    legend = F.array_sort(
        F.transform(
            F.map_entries("a.legend"),
            lambda e: F.struct(e["key"].cast("int").alias("level"), F.to_json(e["value"]).alias("value")),
        )
    )
    return rows.select(
        "model",
        "case",
        "qid",
        F.col("a.type").alias("qtype"),
        "a.choice",
        "a.score",
        "a.noul",
        canonical_jsons(legend["value"]).alias("legend"),
        shares["key"].alias("prob_keys"),
        shares["value"].alias("probabilities"),
        "a.confidence",
        F.col("a.action.act_probability").alias("act_probability"),
    )


def write_golden(cases: DataFrame, path: str) -> None:
    """Record cases: ``read_golden`` with ``lines`` reads them back.

    ``cases``: model, case, state and questions (JSON texts), ``sequences`` (array of qid, ids,
    markers), ``answers`` (array of answer structs) and input_tokens. A line is the document of one
    case; lines of a model are written where its rows are, without a shuffle.
    """
    def keyed(array: str, value) -> Column:
        pairs = F.transform(array, lambda x: F.concat(quote(x["qid"]), F.lit(": "), value(x)))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    def numbers(array: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(array.cast("array<string>"), ", "), F.lit("]"))

    sequences = keyed("sequences", lambda s: F.concat(
        F.lit('{"ids": '), numbers(s["ids"]), F.lit(', "markers": '), numbers(s["markers"]), F.lit("}")))
    document = F.concat(
        F.lit('{"model": '), quote(F.col("model")), F.lit(', "cases": {'), quote(F.col("case").cast("string")),
        F.lit(': {"state": '), F.col("state"), F.lit(', "questions": '), F.col("questions"),
        F.lit(', "sequences": '), sequences, F.lit(', "result": {"answers": '), answers_json("answers"),
        F.lit(', "usage": {"input_tokens": '), F.col("input_tokens").cast("string"),
        F.lit(', "output_tokens": 0}}}}}'))
    cases.select(document.alias("value")).write.text(path)


def golden_parity(got: DataFrame, golden: DataFrame, tolerance: float = fixed.SCORE_TOLERANCE) -> DataFrame:
    """Recorded cases against cases run again: model, case, field, verdict.

    ``got`` has model, case, sequences, answers and input_tokens as ``write_golden`` takes them.
    Answers are compared field by field as in ``answer_parity`` (``answers.<qid>.<field>``), ids and
    markers of each sequence and the token usage as a whole.
    """
    keys = ["model", "case"]
    long = got.select(*keys, F.explode("answers").alias("a")).select(*keys, "a.*")
    answers = answer_parity(long, golden_answers(golden), [*keys, "qid"], tolerance).select(
        *keys, F.concat_ws(".", F.lit("answers"), "qid", "field").alias("field"), "verdict")

    def wholes(df: DataFrame, sequences: DataFrame, tokens: Column, mark: str) -> DataFrame:
        rows = sequences.select(
            *keys, F.concat(F.lit("sequences."), "qid").alias("field"),
            F.concat_ws("|", F.concat_ws(",", F.col("ids").cast("array<string>")),
                        F.concat_ws(",", F.col("markers").cast("array<string>"))).alias(mark))
        usage = df.select(*keys, F.lit("usage.input_tokens").alias("field"), tokens.cast("string").alias(mark))
        return rows.unionByName(usage)

    own = got.select(*keys, F.explode("sequences").alias("s")).select(*keys, "s.*")
    a = wholes(got, own, F.col("input_tokens"), "got")
    b = wholes(golden, golden_sequences(golden), F.col("result.usage.input_tokens"), "want")
    verdict = (
        F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra")
        .when(F.col("got") == F.col("want"), "ok").otherwise("differs"))
    rest = a.join(b, [*keys, "field"], "full_outer").select(*keys, "field", verdict.alias("verdict"))
    return answers.unionByName(rest)
