r"""Python-style JSON text of typed columns.

``json_text`` walks a Spark type and returns one Column that writes the value the way
``json.dumps(value, ensure_ascii=False)`` does: ``", "`` and ``": "`` between parts, field
order kept, nulls written out. Everything stays in the JVM but the shortest text of DOUBLE
values, which needs one Arrow UDF (``double_text``): the JVM text is not always shortest.
Types that JSON does not have are written as one stated text (``leaf_text``) or refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import fixed
from askframe.functions.batches import even_pieces
from askframe.functions.text import col, first_chars

_SHORT_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_OTHER_CONTROLS = [chr(c) for c in range(0x20) if chr(c) not in _SHORT_ESCAPES]


def quote(text: Column) -> Column:
    r"""JSON string literal; control characters as lower-case ``\u00xx``."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = plain
    for ch, escape in _SHORT_ESCAPES.items():
        short = F.replace(short, F.lit(ch), F.lit(escape))
    full = short
    for ch in _OTHER_CONTROLS:
        full = F.replace(full, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    body = (
        F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), full)
        .when(text.rlike(r'[\x08-\x0d"\\]'), short)
        .otherwise(text)
    )
    return F.concat(F.lit('"'), body, F.lit('"'))


def _unit(value: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(value), 4, "0")))


def _ascii_char(ch: Column) -> Column:
    code = F.ascii(ch)
    high = code - 0x10000
    pair = F.concat(
        _unit(F.lit(0xD800) + F.shiftright(high, 10)),
        _unit(F.lit(0xDC00) + high.bitwiseAND(F.lit(0x3FF))),
    )
    return F.when(code < 0x7F, ch).when(code < 0x10000, _unit(code)).otherwise(pair)


def ascii_escape(json_text: Column) -> Column:
    r"""Write all but printable ASCII of a JSON text as ``\uXXXX`` (pairs above U+FFFF)."""
    escaped = F.array_join(F.transform(F.split(json_text, ""), _ascii_char), "")
    return F.when(json_text.rlike(r"[^\x00-\x7e]"), escaped).otherwise(json_text)


def _shortest(value: float | None) -> str | None:
    if value is None:
        return None
    text = repr(value)
    return {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}.get(text, text)


@F.arrow_udf(T.StringType())
def double_text(values: pa.Array) -> pa.Array:
    """Shortest round-trip text of doubles: ``1.0``, ``1e+20``, ``2.5e-07``, ``Infinity``."""
    return pa.array([_shortest(v) for v in values.to_pylist()], pa.string())


def _texts(values: pa.Array, dtype: T.DataType) -> pa.Array:
    """JSON texts of a column whose leaves are numbers, booleans and strings (see ``_ready``), level
    by level and not value by value; ``null`` for null."""
    if values.null_count == len(values):
        return pa.array(["null"] * len(values), pa.string())
    if isinstance(dtype, T.StructType):
        parts: list = []
        for i, (field, column) in enumerate(zip(dtype.fields, values.flatten())):
            parts.append(f"{', ' if i else '{'}{encode_basestring(field.name)}: ")
            parts.append(_texts(column, field.dataType))
        texts = _concat(*parts, "}") if parts else pa.array(["{}"] * len(values), pa.string())
    elif isinstance(dtype, T.ArrayType):
        edges = values.offsets.to_numpy()
        inside = values.values.slice(edges[0], edges[-1] - edges[0])
        texts = _concat("[", _joined(_texts(inside, dtype.elementType), edges), "]")
    elif isinstance(dtype, T.MapType):
        texts = _concat("{", _joined(*_entries(values, dtype)), "}")
    else:
        texts = _leaf_texts(values, dtype)
    return pc.if_else(values.is_valid(), texts, "null") if values.null_count else texts


def _concat(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _joined(items: pa.Array, edges: np.ndarray) -> pa.Array:
    """The items between each two edges, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges - edges[0], pa.int32()), items), ", ")


def _entries(values: pa.MapArray, dtype: T.MapType) -> tuple[pa.Array, np.ndarray]:
    """Texts of the entries of maps, those of each map by key, and the edges of the maps."""
    edges = values.offsets.to_numpy()
    keys, items = (c.slice(edges[0], edges[-1] - edges[0]) for c in (values.keys, values.items))
    counts = np.diff(edges)
    if counts.max() > 1:
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        order = pc.sort_indices(
            pa.table([owner, keys], names=["owner", "key"]),
            sort_keys=[("owner", "ascending"), ("key", "ascending")])
        keys, items = keys.take(order), items.take(order)
    known = keys.dictionary_encode()
    names = pa.array([encode_basestring(k) for k in known.dictionary.to_pylist()], pa.string())
    return _concat(names.take(known.indices), ": ", _texts(items, dtype.valueType)), edges


def _leaf_texts(values: pa.Array, dtype: T.DataType) -> pa.Array:
    """``_texts`` of a column of leaves; whatever for null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        doubles = values.to_numpy(zero_copy_only=False)  # nulls as NaN
        text = repr if np.isfinite(doubles).all() else _shortest
        return pa.array([text(v) for v in doubles.tolist()], pa.string())
    if isinstance(dtype, T.BooleanType):
        return pc.if_else(values, "true", "false")
    if isinstance(dtype, _WHOLE):
        return values.cast(pa.string())
    if isinstance(dtype, T.VariantType):
        text = _canonical
    elif isinstance(dtype, T.StringType):
        text = encode_basestring
    elif isinstance(dtype, T.DecimalType):
        text = "{:f}".format
    else:
        raise TypeError(_no_text(dtype))
    return pa.array([None if v is None else text(v) for v in values.to_pylist()], pa.string())


def _canonical(text: str) -> str:
    """JSON text in this module's form: spaced, shortest doubles, key order as it is."""
    return json.dumps(json.loads(text), ensure_ascii=False)


@F.arrow_udf(T.StringType())
def canonical_json(values: pa.Array) -> pa.Array:
    """``_canonical`` of JSON texts."""
    return pa.array([None if v is None else _canonical(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def canonical_jsons(values: pa.Array) -> pa.Array:
    """``_canonical`` of every JSON text of an array."""
    return pa.array([
        None if row is None else [None if v is None else _canonical(v) for v in row]
        for row in values.to_pylist()], pa.list_(pa.string()))


def _ready(value: Column, dtype: T.DataType) -> Column:
    """``value`` with its dates, times, binaries and variants as text, so that one table of types
    (``leaf_text``) serves the native and the Arrow path."""
    if isinstance(dtype, T.StructType):
        fields = [_ready(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _ready(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda k, v: _ready(v, dtype.valueType))
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    text = leaf_text(value, dtype)
    return value if text is None else text


def _ready_type(dtype: T.DataType) -> T.DataType:
    """The type of ``_ready``; a variant stays one, as its text is JSON already."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _ready_type(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_ready_type(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _ready_type(dtype.valueType))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return T.StringType()
    return dtype


def _whole_text(value: Column, dtype: T.DataType) -> Column:
    """JSON text of an array or map with doubles or variants deep inside: one Arrow call on the
    whole value."""
    ready = _ready_type(dtype)

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for part in even_pieces(values):
                yield pc.if_else(part.is_valid(), _texts(part, ready), None)

    return text(_ready(value, dtype))


def _holds_doubles(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_doubles(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_doubles(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_doubles(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType, T.VariantType))


def _check_keys(dtype: T.DataType) -> None:
    if isinstance(dtype, T.MapType) and not isinstance(dtype.keyType, T.StringType):
        raise TypeError("JSON objects need text keys; cast the map's keys to strings")


@F.arrow_udf(T.ArrayType(T.StringType()))
def double_texts(values: pa.Array) -> pa.Array:
    """``double_text`` of every element of an array; null elements become ``null``."""
    texts = [
        None if row is None else ["null" if v is None else _shortest(v) for v in row]
        for row in values.to_pylist()
    ]
    return pa.array(texts, pa.list_(pa.string()))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _no_text(dtype: T.DataType) -> str:
    return f"no JSON text for {dtype.simpleString()}; cast it to a string first"


def leaf_text(value: Column, dtype: T.DataType) -> Column | None:
    """Text of a leaf that JSON has no type for, None for a leaf that it has one for.

    Dates are ``2024-05-01``; times ``2024-05-01T12:30:00``, with six digits of the second if it has
    a fraction, and with the offset of the session's zone (``+00:00``) unless the type has no zone;
    binaries are base64. Other types raise ``TypeError``.
    """
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        fraction = F.date_format(value, "SSSSSS")
        zone = [F.date_format(value, "xxx")] if isinstance(dtype, T.TimestampType) else []
        return F.concat(
            F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), *zone)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType, T.BooleanType, T.DecimalType,
                          T.DoubleType, T.FloatType, T.NullType, *_WHOLE)):
        return None
    raise TypeError(_no_text(dtype))


def _scalar_text(value: Column, dtype: T.DataType) -> Column:
    text = leaf_text(value, dtype)
    if text is not None:
        return quote(text)
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "true").when(~value, "false")
    if isinstance(dtype, (T.DecimalType, *_WHOLE)):
        return value.cast("string")
    return quote(value)


def json_text(value: Column | str, dtype: T.DataType) -> Column:
    """JSON text of ``value``; null becomes ``null``, struct fields keep their order.

    DOUBLE leaves at the top or in structs go through ``double_text``, arrays of them through
    ``double_texts``, and an array or map with doubles deeper inside goes through Python as a
    whole: a UDF cannot be called per element. Decimals keep their digits; maps have text keys;
    variants are written as the JSON they hold. For dates, times and binaries see ``leaf_text``.
    """
    return _json(col(value), dtype)


def _json(value: Column, dtype: T.DataType) -> Column:
    _check_keys(dtype)
    if isinstance(dtype, T.StructType):
        parts: list[Column] = []
        for i, field in enumerate(dtype.fields):
            parts.append(F.concat(F.lit(", " if i else ""), quote(F.lit(field.name)), F.lit(": ")))
            parts.append(_json(value[field.name], field.dataType))
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.DoubleType, T.FloatType)):
            items = double_texts(value.cast("array<double>"))
        elif _holds_doubles(dtype):
            return F.coalesce(_whole_text(value, dtype), F.lit("null"))
        else:
            items = F.transform(value, lambda x: _json(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        if _holds_doubles(dtype):
            return F.coalesce(_whole_text(value, dtype), F.lit("null"))
        # Maps carry no order of their own: keys are written sorted. Maps have no order as values
        # either, so the keys are sorted alone.
        items = F.transform(
            F.array_sort(F.map_keys(value)),
            lambda k: F.concat(
                quote(k), F.lit(": "), _json(F.element_at(value, k), dtype.valueType)
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = double_text(value.cast("double"))
    elif isinstance(dtype, T.NullType):
        return F.lit("null")
    elif isinstance(dtype, T.VariantType):
        text = canonical_json(F.to_json(value))
    else:
        text = _scalar_text(value, dtype)
    return F.coalesce(text, F.lit("null"))


def state_text(value: Column | str, dtype: T.DataType) -> Column:
    """Context as the model reads it: a string as it is, anything else as JSON text."""
    if isinstance(dtype, T.StringType):
        return col(value)
    return json_text(value, dtype)


def object_text(fields: Column) -> Column:
    """JSON object of an ARRAY<STRUCT<key, val, json>> in array order; null values dropped.

    A field is written as its JSON text, or as the string ``val`` where it has none.
    """
    kept = F.filter(fields, lambda f: f["val"].isNotNull())
    return F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(kept, lambda f: F.concat(
                quote(f["key"]), F.lit(": "), F.coalesce(f["json"], quote(f["val"])))),
            ", ",
        ),
        F.lit("}"),
    )


def _or_empty(leaves: Column) -> Column:
    return F.coalesce(leaves, F.array().cast("array<string>"))


def _string_leaves(value: Column, dtype: T.DataType, depth: int) -> Column | None:
    """ARRAY<STRING> of the string leaves in order, or None where a type holds no strings."""
    if depth > fixed.DETECTION_DEPTH:
        return None
    if isinstance(dtype, T.StringType):
        return F.array(value)
    if isinstance(dtype, T.StructType):
        parts = [_string_leaves(value[f.name], f.dataType, depth + 1) for f in dtype.fields]
        parts = [_or_empty(p) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(dtype, T.ArrayType):
        element = dtype.elementType
        if isinstance(element, T.StringType):
            return value if depth < fixed.DETECTION_DEPTH else None
        if _holds_strings(element, depth + 1):
            return F.flatten(
                F.transform(value, lambda x: _or_empty(_string_leaves(x, element, depth + 1)))
            )
        return None
    if isinstance(dtype, T.MapType):
        element = dtype.valueType
        if _holds_strings(element, depth + 1):
            return F.flatten(
                F.transform(
                    F.array_sort(F.map_keys(value)),
                    lambda k: _or_empty(_string_leaves(F.element_at(value, k), element, depth + 1)),
                )
            )
    return None


def _holds_strings(dtype: T.DataType, depth: int) -> bool:
    if depth > fixed.DETECTION_DEPTH:
        return False
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.StructType):
        return any(_holds_strings(f.dataType, depth + 1) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_strings(dtype.elementType, depth + 1)
    if isinstance(dtype, T.MapType):
        return _holds_strings(dtype.valueType, depth + 1)
    return False


def context_text(value: Column | str, dtype: T.DataType) -> Column:
    """Flattened text of a typed context: its string leaves in order, joined by one space.

    Keys and other types are not read, leaves deeper than six levels neither; the result is
    cut to the detection window.
    """
    leaves = _string_leaves(col(value), dtype, 0)
    if leaves is None:
        return F.lit("")
    # array_join leaves nulls out, as a JSON null would be.
    return F.coalesce(
        first_chars(F.array_join(leaves, " "), fixed.DETECTION_CHARS), F.lit("")
    )
