"""Email cleaning: quoted history, signatures and disclaimers are removed.

``clean_email`` works on a DataFrame so that every intermediate result is computed once per
row in its own projection. There is no shuffle and no Python. Plain substring tests decide
first which steps a body can need at all; each test finds at least every body the step's
pattern can match, so skipping a step never changes the result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.functions import fixed
from askframe.functions.plan import aside, seal
from askframe.functions.pyjson import context_text, json_text
from askframe.functions.text import col, first_chars, ltrim_space, rtrim_space, trim_space

# Characters a quote header can start with; white space is more than the patterns allow.
_HEADER_STARTS = "OoFf-_\x1c\x1d\x1e\x1f" + fixed.SPACE_CHARS


def _pattern(text: str) -> str:
    """Java form of a fixed pattern.

    Case folding is the ASCII one plus the two other letters that fold to s and k: with the
    Unicode flag Java would also take dotted and dotless i for each other. (?d) makes LF the
    only line end that "." and "$" know.
    """
    return text.replace("s", "[sſ]").replace("k", "[kK]").replace("~", fixed.PATTERN_SPACE)


QUOTE_HEADER = "(?id)" + "|".join(map(_pattern, fixed.QUOTE_HEADERS))
SIGNATURE = "(?id)" + "|".join(map(_pattern, fixed.SIGNATURE_MARKERS))
DISCLAIMER = "(?i)" + "|".join(map(_pattern, fixed.DISCLAIMERS))
BLANK_LINES = _pattern(r"\n~*\n")
BLANK_LINES_AND_INDENT = BLANK_LINES + r"[\p{Z}\x09-\x0d\x85]*"

# Lower-case parts of which a text must contain one before a pattern can match in it.
HEADER_HINTS = ["wrote:", "original ", "forwarded ", "________", "from:"]
SIGNATURE_HINTS = ["--", "be", "ind", "warm", "than", "regard", "cheer", "incerely", "ent from"]
DISCLAIMER_HINTS = ["confidential", "intended", "received"]


def _has_any(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def _one_of(characters: str, char: Column) -> Column:
    """Whether a one-character text is among these; true for the empty text too."""
    return F.contains(F.lit(characters), char)


def normalise_newlines(body: Column) -> Column:
    r"""CRLF, CR and the two-character text ``\n`` become LF."""
    return F.when(
        _has_any(body, ["\r", "\\n"]), F.regexp_replace(body, r"\r\n|\r|\\n", "\n")
    ).otherwise(body)


def is_quote_header(line: Column) -> Column:
    return _one_of(_HEADER_STARTS, F.substring(line, 1, 1)) & line.rlike(QUOTE_HEADER)


def is_quoted(line: Column) -> Column:
    return F.startswith(line, F.lit(">")) | (
        _one_of(fixed.SPACE_CHARS, F.substring(line, 1, 1))
        & F.startswith(ltrim_space(line), F.lit(">"))
    )


def is_signature(line: Column) -> Column:
    """Test of a line that has no blanks at its end any more."""
    indented = _one_of(fixed.SPACE_CHARS, F.substring(line, 1, 1))
    size = F.octet_length(F.when(indented, ltrim_space(line)).otherwise(line))
    return (size <= fixed.SIGNATURE_BYTES) & line.rlike(SIGNATURE)


def trim_line_end(line: Column) -> Column:
    blank = _one_of(fixed.SPACE_CHARS, F.substring(line, -1, 1))
    return F.when(blank, rtrim_space(line)).otherwise(line)


def before_first(lines: Column, hits: Column, start: Column) -> Column:
    """Lines ahead of the first hit; ``hits[0]`` belongs to the line at 0-based ``start``."""
    first = F.array_position(hits, F.lit(True))
    return F.when(first > 0, F.slice(lines, F.lit(1), (start + first - 1).cast("int"))).otherwise(
        lines
    )


def signature_start(n: Column) -> Column:
    """0-based index of the first line that may be a signature."""
    return F.greatest(
        F.lit(1),
        F.least(
            (n * F.lit(fixed.SIGNATURE_SHARE)).cast("int"), n - F.lit(fixed.SIGNATURE_TAIL)
        ),
    )


def _collapse_blanks(text: Column) -> Column:
    return F.when(
        _has_any(text, ["  ", "\t"]), F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    ).otherwise(text)


def _from(lines: Column, start: Column) -> Column:
    return F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))


def _without_disclaimers(text: Column) -> Column:
    paragraphs = F.filter(F.split(text, BLANK_LINES, -1), lambda p: ~p.rlike(DISCLAIMER))
    kept = F.filter(F.transform(paragraphs, trim_space), lambda p: p != "")
    return F.array_join(kept, "\n\n")


def _tidy_paragraphs(text: Column) -> Column:
    # Lines end without blanks here, so only an empty line or a separator splits paragraphs.
    gaps = _has_any(text, ["\n\n", "\x1c", "\x1d", "\x1e", "\x1f"])
    return trim_space(
        F.when(gaps, F.regexp_replace(text, BLANK_LINES_AND_INDENT, "\n\n")).otherwise(text)
    )


def clean_email(
    df: DataFrame, body: Column | str, out: str = "clean_body", max_chars: int = fixed.EMAIL_CHARS
) -> DataFrame:
    """Add ``out``: the message itself, without quoted history, signature and disclaimers."""
    helpers = ("_text", "_low", "_headers", "_signature", "_disclaimer", "_lines", "_hits", "_start")
    df, (body,), back = aside(df, helpers, col(body))
    text, lines, hits, start = (F.col(c) for c in ("_text", "_lines", "_hits", "_start"))
    df = (
        df.withColumn("_text", normalise_newlines(body))
        .withColumn("_low", F.lower(text))
        .withColumns(
            {
                "_headers": _has_any(F.col("_low"), HEADER_HINTS),
                "_signature": _has_any(F.col("_low"), SIGNATURE_HINTS),
                "_disclaimer": _has_any(F.col("_low"), DISCLAIMER_HINTS),
                "_lines": F.split(text, "\n", -1),
            }
        )
        .withColumn(
            "_lines",
            F.when(F.contains(text, F.lit(">")), F.filter(lines, lambda x: ~is_quoted(x))).otherwise(
                lines
            ),
        )
        # A header ends the message unless it is the first line that is kept.
        .withColumn(
            "_hits", F.when(F.col("_headers"), F.transform(_from(lines, F.lit(1)), is_quote_header))
        )
        .withColumn("_lines", before_first(lines, hits, F.lit(1)))
        .withColumn("_lines", F.transform(lines, trim_line_end))
        .withColumn("_start", signature_start(F.size(lines)))
        .withColumn(
            "_hits", F.when(F.col("_signature"), F.transform(_from(lines, start), is_signature))
        )
        .withColumn("_text", F.array_join(before_first(lines, hits, start), "\n"))
        .withColumn(
            "_text",
            F.when(F.col("_disclaimer"), _without_disclaimers(text)).otherwise(
                _tidy_paragraphs(text)
            ),
        )
        .withColumn(out, first_chars(_collapse_blanks(text), max_chars))
    )
    return back(seal(df, out, drop=helpers))


def email_context(
    subject: Column | str, body: Column | str, sender: Column | str | None = None, extra=None
) -> Column:
    """Fields of an email context in order: ARRAY<STRUCT<key, val, json>>, absent ones left out.

    Subject and body are always there, empty where null. ``body`` is expected to be cleaned already
    where cleaning is wanted. ``extra`` maps names to string columns, or to pairs of a column and
    its Spark type for values of any JSON kind; null extras are left out. ``json`` is the JSON text
    of a typed extra, and ``val`` then holds its string leaves; for strings ``json`` is null.
    """
    none = F.lit(None).cast("string")
    fields = [
        ("subject", F.coalesce(trim_space(col(subject)), F.lit("")), none),
        ("body", F.coalesce(col(body), F.lit("")), none),
    ]
    if sender is not None:
        fields.append(("from", F.nullif(col(sender), F.lit("")), none))
    for name, given in (extra or {}).items():
        if not isinstance(given, tuple):
            fields.append((name, col(given), none))
            continue
        value, dtype = col(given[0]), given[1]
        there = value.isNotNull()
        fields.append((
            name, F.when(there, context_text(value, dtype)), F.when(there, json_text(value, dtype))))
    pairs = F.array(*[
        F.struct(F.lit(k).alias("key"), v.alias("val"), j.alias("json")) for k, v, j in fields])
    return F.filter(pairs, lambda f: f["val"].isNotNull())


def email_text(fields: Column | str) -> Column:
    """What detection reads of an email context: its texts in order, cut to the window."""
    texts = F.transform(col(fields), lambda f: f["val"])
    read = F.filter(texts, lambda t: t != "")
    return first_chars(F.array_join(read, " "), fixed.DETECTION_CHARS)
