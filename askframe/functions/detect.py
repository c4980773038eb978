"""Script and language detection as staged projections over a text column.

Each ``withColumn`` whose result is used more than once stays its own projection, so the
regex passes run once per row. Rows whose letters are all Latin skip the 24 script counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.plan import aside, seal
from askframe.functions.text import char_class, col, first_chars, lower_simple, round4

LATIN = char_class(fixed.LATIN_RANGES)
LANGUAGES = list(fixed.STOPWORDS)
WORD_SETS = {lang: sorted(set(words.split())) for lang, words in fixed.STOPWORDS.items()}
ALL_WORDS = sorted({w for words in WORD_SETS.values() for w in words})

DETECTION_TYPE = (
    "struct<script:string,script_profile:map<string,double>,language:string,"
    "is_english:boolean,non_latin_fraction:double>"
)


def detection_window(text: Column) -> Column:
    """The part of a flattened context that detection looks at."""
    return first_chars(text, fixed.DETECTION_CHARS)


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{L}+", "")


def foreign_letters(text: Column) -> Column:
    """Letters outside the Latin ranges, in text order."""
    lo, hi = fixed.LATIN_RANGES[0]
    found = F.regexp_replace(text, rf"[\P{{L}}{LATIN}]+", "")
    return F.when(text.rlike(rf"[^\x{{{lo:X}}}-\x{{{hi:X}}}]"), found).when(
        text.isNotNull(), F.lit("")
    )


def _script_count(name: str, ranges) -> str:
    """SQL of struct(n, rank, script) of one script in ``_foreign``."""
    body = char_class(ranges)
    # Ties go to the script seen first, so the negated position is the second sort key.
    return f"""CASE WHEN _foreign RLIKE r'[{body}]' THEN struct(
        length(regexp_replace(_foreign, r'[^{body}]+', '')) AS n,
        -regexp_instr(_foreign, r'[{body}]') AS rank, '{name}' AS script) END"""


def _present_scripts() -> str:
    """SQL of the ARRAY of structs of all scripts that occur in ``_foreign``.

    Six scripts share one test, so a text in one script is not searched for all 24.
    """
    groups = [fixed.SCRIPT_RANGES[i : i + 6] for i in range(0, len(fixed.SCRIPT_RANGES), 6)]
    parts = []
    for group in groups:
        anywhere = char_class([r for _, ranges in group for r in ranges])
        counts = ", ".join(_script_count(name, ranges) for name, ranges in group)
        parts.append(
            f"CASE WHEN _foreign RLIKE r'[{anywhere}]' THEN array_compact(array({counts})) "
            f"ELSE {_NO_COUNTS} END"
        )
    return f"concat({', '.join(parts)})"


_NO_COUNTS = "cast(array() AS array<struct<n:int,rank:int,script:string>>)"


def with_script_counts(
    df: DataFrame, text: Column | str, out: str = "script_counts"
) -> DataFrame:
    """Add ``out``: array of (n, rank, script) with n > 0; the largest struct is dominant."""
    df, (text,), back = aside(df, _SCRIPT_HELPERS, col(text))
    df = _script_counts(df.withColumn("_text", detection_window(text)), out, exact=True)
    return back(seal(df, out, drop=_SCRIPT_HELPERS))


_SCRIPT_HELPERS = ("_text", "_foreign", "_latin")


def _script_counts(df: DataFrame, out: str, exact: bool) -> DataFrame:
    """Script counts of ``_text``; ``exact=False`` is enough for shares: a text whose letters
    are all Latin then gets the count 1 for Latin instead of its number of letters.
    """
    n_latin = F.length(letters(F.col("_text"))) - F.length("_foreign")
    if not exact:
        any_letter = F.when(F.col("_text").rlike(r"\p{L}"), 1).otherwise(0)
        n_latin = F.when(F.length("_foreign") > 0, n_latin).otherwise(any_letter)
    latin = F.struct(
        n_latin.alias("n"),
        F.lit(-(2**31) + 1).alias("rank"),  # Latin loses every tie
        F.lit("latin").alias("script"),
    )
    none = F.expr(_NO_COUNTS)
    return (
        df.withColumn("_foreign", foreign_letters(F.col("_text")))
        .withColumn("_latin", latin)
        .withColumn(
            out,
            F.concat(
                F.when(F.length("_foreign") > 0, F.expr(_present_scripts())).otherwise(none),
                F.when(F.col("_latin")["n"] > 0, F.array("_latin")).otherwise(none),
            ),
        )
    )


def dominant_script(counts: Column) -> Column:
    return F.coalesce(F.array_max(counts)["script"], F.lit("unknown"))


def total_letters(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, s: a + s["n"])


def latin_letters(counts: Column) -> Column:
    return F.aggregate(
        counts, F.lit(0), lambda a, s: a + F.when(s["script"] == "latin", s["n"]).otherwise(0)
    )


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(fixed.WORD_PATTERN), F.lit(0))


def among(column: str, members: list[str]) -> str:
    """SQL of the elements of an array column that are in a fixed list (one hash probe each)."""
    listed = ", ".join(f"'{m}'" for m in members)
    return f"filter({column}, w -> w IN ({listed}))"


def diacritic_count(lowered: Column) -> Column:
    found = F.length(lowered) - F.length(F.translate(lowered, fixed.DIACRITICS, ""))
    return F.when(F.octet_length(lowered) == F.length(lowered), 0).otherwise(found)


def with_latin_language(df: DataFrame, text: Column | str, out: str = "language") -> DataFrame:
    """Add ``out``: best-effort language code of Latin-script text, or null."""
    df, (text,), back = aside(df, _LANGUAGE_HELPERS, col(text))
    df = _latin_language(df, detection_window(text), out)
    return back(seal(df, out, drop=_LANGUAGE_HELPERS))


_LANGUAGE_HELPERS = ("_low", "_words", "_n_words", "_hits", "_scores", "_best", "_rate")


def _latin_language(df: DataFrame, window: Column, out: str) -> DataFrame:
    """Language of a detection window; a null window gives null and costs nothing."""
    scores = F.col("_scores")
    en, best, rate = scores[0], F.col("_best"), F.col("_rate")
    others = F.slice(scores, 2, len(LANGUAGES) - 1)
    # The first maximum wins, which is "fr" when nothing was found at all.
    best_lang = F.element_at(
        F.array(*[F.lit(x) for x in LANGUAGES[1:]]),
        F.array_position(others, best).cast("int"),
    )
    english = F.when(en > 0, "en")
    guess = (
        F.when(F.col("_n_words") < 4, None)
        .when((best == 0) & (rate < F.lit(fixed.LOW_DIACRITIC_RATE)), english)
        .when(best >= F.greatest(F.lit(2), en + 2), best_lang)
        .when((rate >= F.lit(fixed.HIGH_DIACRITIC_RATE)) & (best >= en), best_lang)
        .otherwise(english)
    )
    return (
        df.withColumn("_low", lower_simple(window))
        .withColumn("_words", words(F.col("_low")))
        # One hash probe per word leaves the few words that any language set contains.
        .withColumns({"_n_words": F.size("_words"), "_hits": F.expr(among("_words", ALL_WORDS))})
        .withColumn(
            "_scores",
            F.array(*[F.expr(f"size({among('_hits', WORD_SETS[x])})") for x in LANGUAGES]),
        )
        .withColumn("_best", F.array_max(others))
        # The diacritic rate only decides when the word lists do not.
        .withColumn(
            "_rate",
            F.when(
                (best == 0) | ((best >= en) & (best < F.greatest(F.lit(2), en + 2))),
                diacritic_count(F.col("_low")).cast("double")
                / F.greatest(F.lit(1), F.length("_low")).cast("double"),
            ).otherwise(F.lit(0.0)),
        )
        .withColumn(out, guess)
    )


def detect(
    df: DataFrame, text: Column | str, out: str = "detection", where: Column | None = None
) -> DataFrame:
    """Add ``out``: script, script profile, language, is_english and non-Latin fraction.

    Rows where ``where`` is not true get a null detection and cost nothing.
    """
    helpers = (*_SCRIPT_HELPERS, "_counts", "_total", "_script", "_outside", "_language",
               *_LANGUAGE_HELPERS)
    text = col(text) if where is None else F.when(where, col(text))
    df, (text,), back = aside(df, helpers, text)
    counts, total = F.col("_counts"), F.col("_total")
    script = F.col("_script")
    df = _script_counts(df.withColumn("_text", detection_window(text)), "_counts", exact=False)
    df = df.withColumns(
        {
            "_total": total_letters(counts),
            "_script": F.when(F.col("_text").isNotNull(), dominant_script(counts)),
        }
    ).withColumn(
        "_outside",
        F.lit(1.0) - F.try_divide(latin_letters(counts).cast("double"), total.cast("double")),
    )
    df = _latin_language(df, F.when(script == "latin", F.col("_text")), "_language")
    fraction = F.when(script == "unknown", F.lit(0.0)).otherwise(round4(F.col("_outside")))
    profile = F.map_from_entries(
        F.transform(
            counts,
            lambda s: F.struct(s["script"], s["n"].cast("double") / total.cast("double")),
        )
    )
    english = (
        F.when(script == "unknown", True)
        .when(script == "latin", F.col("_language").isNull() | (F.col("_language") == "en"))
        .otherwise(False)
    )
    detection = F.struct(
        script.alias("script"),
        profile.alias("script_profile"),
        F.col("_language").alias("language"),
        english.alias("is_english"),
        fraction.alias("non_latin_fraction"),
    )
    return back(seal(df.withColumn(out, F.when(script.isNotNull(), detection)), out, drop=helpers))
