"""Inputs of the registered queries, derived from the given tables by Spark.

The tables hold Latin-script prose without emails or requests, so the queries derive mixed
scripts, email threads, hints, logits and request bodies from whole rows of them. Every row
of a table is used; the remainder of a key only picks which form a row takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.sources.tables import read_table

LOWER = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщ"
HAN = "一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丢两严丧丨"
KANA = "あいうえおかきくけこさしすせそ"
HEBREW = "אבגדהו"
ARMENIAN = "աբգդե"
PRESET_ORDER = sorted(fixed.PRESETS)


def pick(key: Column | str, *values: Column) -> Column:
    """``values[key mod n]``."""
    key = F.col(key) if isinstance(key, str) else key
    chosen = values[-1]
    for i, value in reversed(list(enumerate(values[:-1]))):
        chosen = F.when(F.pmod(key, F.lit(len(values))) == i, value).otherwise(chosen)
    return chosen


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id", *columns)


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as contexts. A turn is a request of its own, however long a conversation is."""
    return read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")


def events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, sf, "events", "event_id", *columns)


def mixed_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, t: every document, most of them moved to other scripts letter by letter."""
    text = F.col("text")
    return documents(spark, sf, "text").select(
        "doc_id",
        pick(
            "doc_id",
            F.translate(text, LOWER, CYRILLIC),
            F.translate(text, "aeiou", "αειου"),
            F.translate(text, "etaoin", HEBREW),
            F.translate(text, LOWER, HAN),
            F.translate(text, LOWER[:15], KANA),
            F.regexp_replace(text, r"\p{L}", "7"),
            F.translate(text, "aeiou", ARMENIAN),
            text,
        ).alias("t"),
    )


def hinted(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, lang and routing hints of all kinds, many of them empty or null."""
    none = F.lit(None).cast("string")
    lang = F.col("lang")
    return documents(spark, sf, "text", "lang").select(
        "doc_id",
        "text",
        "lang",
        pick(
            "doc_id", F.lit(" ML "), F.lit("Typed"), F.lit("nope"), F.lit(""), none, none, none,
            none, none, none, none, none, F.lit("typed-decisions"),
        ).alias("model_hint"),
        pick(
            "doc_id", lang, none, none, none, F.lit("Typed-Decisions"), F.lit("decisions"),
            F.lit("what's this"), F.lit(""), none, none, none, none, none,
        ).alias("task_hint"),
        pick(
            "doc_id", none, none, none, none, none, none, none, F.concat(lang, F.lit("-AT")),
            F.lit("EN-us"), F.lit("en_US"), F.concat(F.lit("l'"), lang), F.lit(""), none,
        ).alias("lang_hint"),
    )


def email_threads(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, lang, body: documents as the newest message of a mail thread."""
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")

    def c(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def lines(prefix: str, newline: str = "\n") -> Column:
        return F.replace(text, F.lit("\n"), F.lit(newline + prefix))

    body = pick(
        "doc_id",
        c(text, "\r\n\r\nThanks,\r\n", source, "\r\n\r\nOn Mon, ", lang, " wrote:\r\n> ",
          lines("> ", "\r\n"), "\r\n\r\nThis email is confidential."),
        c(lines("", "\\n"), "\\n \\n--\\n", source, "\\nSent from my iPhone"),
        c("From: ", source, "\n", text, "\t\t end  \n\n-- Original Message ---\n", text),
        c("  > ", source, "\n", text, "\n\n\n\t\nIf you have received this MESSAGE in error, ",
          lang, "\n\n  tail\t", source, "\n", text, "\n__________\n", text),
        c(text, "\n\nBest regards, ", source, "\n\n \nFROM: ", lang, "\nx"),
        c("\n\n", text, "\n\nintended solely for the use of the named recipient ", source,
          "\n\n", text, "\rKind words to all of you from me and from everybody else, ok?\r", lang),
        text,
    )
    return documents(spark, sf, "text", "source", "lang").select(
        "doc_id", "source", "lang", body.alias("body")
    )


def preset_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, role, text, spec_id: every turn with one of the presets."""
    return conversations(spark, sf).withColumn(
        "spec_id",
        pick(F.col("conv_id") + F.col("turn"), *[F.lit(n) for n in PRESET_ORDER]),
    )


def word_ids(text: Column) -> Column:
    """Stand-in for a tokenizer: one id per blank-separated word, 100 + its length."""
    return F.transform(F.split(text, " "), lambda w: F.length(w) + 100)


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, qtype, k, logits, act_logits: whole embeddings as stand-in logits.

    A vector is cut into questions of 1 to 13 options, by its number; every value is an option of
    one question, and a last question of one option is a choice. ``vec_id`` numbers the questions:
    64 times that of the vector (which has 64 values) plus the place of the question in it.
    """
    df = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    qtype = pick("vec_id", *[F.lit(t) for t in fixed.QTYPES])
    width = (F.pmod("vec_id", F.lit(13)) + 1).cast("int")
    width = F.when(qtype == "noul", 2).when(qtype == "score", F.greatest(width, F.lit(2))).otherwise(width)
    cut = df.withColumn("qtype", qtype).withColumn("width", width).withColumn(
        "part", F.explode(F.expr(
            "sequence(0, cast((size(embedding) + width - 1) div width as int) - 1)")))
    values = F.slice("embedding", F.col("part") * F.col("width") + 1, F.col("width"))
    k = F.least(F.col("width"), F.size("embedding") - F.col("part") * F.col("width"))
    eight = F.lit(8.0).cast("float")
    return cut.select(
        (F.col("vec_id") * 64 + F.col("part")).alias("vec_id"),
        "label",
        F.when(k < 2, "choice").otherwise(F.col("qtype")).alias("qtype"),
        k.alias("k"),
        F.transform(values, lambda x: (x * eight).cast("float")).alias("logits"),
        F.array(
            F.element_at("embedding", F.col("part") + 1),
            F.element_at("embedding", F.size("embedding") - F.col("part")),
        ).alias("act_logits"),
    )


def checkpoint_settings(df: DataFrame) -> DataFrame:
    """Add temperatures by type and by number of options."""
    by_options = {"choice:2": 1.3, "choice:3-5": 0.8, "choice:11+": 1.75, "score:6-10": 0.55}
    pairs = [F.lit(x) for kv in by_options.items() for x in kv]
    return df.withColumn(
        "temperature", F.array(F.lit(1.1), F.lit(0.9), F.lit(0.0001))
    ).withColumn("temperature_by_options", F.create_map(*pairs))


def label_keys(k: Column | str) -> Column:
    """o0 ... o(k-1)."""
    k = F.col(k) if isinstance(k, str) else k
    return F.transform(
        F.sequence(F.lit(0), k - 1), lambda i: F.concat(F.lit("o"), i.cast("string"))
    )
