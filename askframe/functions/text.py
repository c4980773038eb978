"""Text and number helpers: plain Column expressions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askframe.functions import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_class(ranges) -> str:
    """Regex character-class body for code-point ranges."""
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges)


def trim_space(c: Column) -> Column:
    """Trim Unicode white space on both sides (plain ``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(fixed.SPACE_CHARS))


def rtrim_space(c: Column) -> Column:
    return F.rtrim(c, F.lit(fixed.SPACE_CHARS))


def ltrim_space(c: Column) -> Column:
    return F.ltrim(c, F.lit(fixed.SPACE_CHARS))


def lower_simple(c: Column) -> Column:
    """Lower case letter by letter.

    ``lower`` turns U+0130 into two code points; the one-to-one mapping is a plain ``i``.
    """
    return F.lower(F.replace(c, F.lit("İ"), F.lit("i")))


def fold_name(c: Column) -> Column:
    """Key under which names and aliases are looked up."""
    return lower_simple(trim_space(c))


def first_chars(c: Column, n: int) -> Column:
    """Cut to n code points."""
    return F.substring(c, 1, n)


def quote_repr(c: Column) -> Column:
    """Quote a text for a reason message: double quotes only around a lone apostrophe."""
    return F.when(
        F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')),
        F.concat(F.lit('"'), c, F.lit('"')),
    ).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def percent_text(fraction: Column) -> Column:
    """Whole percent of a fraction, ties to even."""
    return F.rint(fraction * F.lit(100.0)).cast("bigint").cast("string")


def round4(x: Column) -> Column:
    """Round a double to 4 decimals, correctly from its binary value, ties to even.

    ``round`` and ``bround`` go through the shortest decimal text and are wrong for some
    doubles. The product x * 10^4 is split into its rounded value ``p`` and the exact error
    ``e`` of that rounding, which decides the values that look like ties.
    Pass a materialised column: ``x`` appears several times in the expression.
    """
    scale = F.lit(10000.0)
    p = x * scale
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    e = (hi * scale - p) + (x - hi) * scale
    f = F.floor(p)
    d = p - f - F.lit(0.5)
    up = (
        (d > 0)
        | ((d == 0) & (e > 0))
        | ((d == 0) & (e == 0) & (F.pmod(f, F.lit(2)) == 1))
    )
    return (f + F.when(up, 1).otherwise(0)).cast("double") / scale


def round4_float(x: Column) -> Column:
    """``round4`` of a FLOAT: its 24 bits times 10^4 are exact in a double, so ``rint`` is."""
    return F.rint(x.cast("double") * F.lit(10000.0)) / F.lit(10000.0)


#: Control characters with a letter of their own in a quoted name.
_NAME_ESCAPES = {"\a": "a", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v"}


def quoted_name(text: Column) -> Column:
    r"""A name in double quotes as messages show it: ``\"``, ``\\``, ``\n``, ``\x01``."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in (*range(0x20), 0x7F):
        shown = _NAME_ESCAPES.get(chr(code), f"x{code:02x}")
        full = F.replace(full, F.lit(chr(code)), F.lit("\\" + shown))
    body = F.when(text.rlike(r"[\x00-\x1f\x7f]"), full).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))
