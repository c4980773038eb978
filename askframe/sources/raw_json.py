"""Raw JSON text as tables.

One Arrow pass turns a column of JSON texts into (a) the canonical text, as Python's
``json.dumps`` writes it, and (b) the nodes of the document in reading order. All that comes
after is Column expressions over the ``nodes`` array; nothing is exploded or shuffled. A text has
up to one node per character, so the pass hands on its rows in pieces of bounded text.

Spark's own JSON functions do not do here: they take the first of two equal keys (the last
one counts), rewrite numbers, and cannot tell ``2048`` from ``"2048"`` or null from absent.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import count
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.functions import fixed
from askframe.functions.batches import pieces
from askframe.functions.text import col, first_chars

NODE_TYPE = (
    "struct<pos:int,size:int,depth:int,key:string,kind:string,text:string,at:int,len:int>"
)
PARSED_TYPE = f"invalid string, kind string, canonical string, nodes array<{NODE_TYPE}>"

_ARROW_NODE = pa.struct(
    [("pos", pa.int32()), ("size", pa.int32()), ("depth", pa.int32()), ("key", pa.string()),
     ("kind", pa.string()), ("text", pa.string()), ("at", pa.int32()), ("len", pa.int32())]
)
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


class _Number:
    """A number with the text it was written as."""

    __slots__ = ("literal",)

    def __init__(self, literal: str):
        self.literal = literal

    def canonical(self) -> str:
        if not re.search("[.eE]", self.literal):
            return "0" if self.literal == "-0" else self.literal
        value = float(self.literal)
        return {"inf": "Infinity", "-inf": "-Infinity"}.get(repr(value), repr(value))


def _refuse(literal: str):
    raise ValueError(f"invalid number {literal}")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def _valid(text: str) -> str:
    return text if text.isascii() else _LONE_SURROGATE.sub("�", text)


#: A string in quotes, as ``json.dumps(text, ensure_ascii=False)`` writes it; that would set up an
#: encoder for every string, which takes several times as long as the string itself.
_quoted = json.encoder.encode_basestring


_BLANK = re.compile(r"[ \t\n\r]*")
_LITERAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def _decode_deep(text: str):
    """What ``_DECODER.decode`` gives, with an explicit stack in place of recursion."""
    def fail(message: str, at: int):
        raise json.JSONDecodeError(message, text, at)

    def skip(at: int) -> int:
        return _BLANK.match(text, at).end()

    def name_at(at: int) -> tuple[str, int]:
        if text[at:at + 1] != '"':
            fail("Expecting property name enclosed in double quotes", at)
        name, at = scanstring(text, at + 1, True)
        at = skip(at)
        if text[at:at + 1] != ":":
            fail("Expecting ':' delimiter", at)
        return name, skip(at + 1)

    root: list = []
    stack: list[tuple] = [(root, None)]  # open containers and the key that is being read
    at = skip(0)
    while True:
        ch = text[at:at + 1]
        opened = None
        if ch == "{":
            at = skip(at + 1)
            opened = {}
            if text[at:at + 1] != "}":
                key, at = name_at(at)
                stack.append((opened, key))
                continue
        elif ch == "[":
            at = skip(at + 1)
            opened = []
            if text[at:at + 1] != "]":
                stack.append((opened, None))
                continue
        if opened is not None:
            value, at = opened, at + 1
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            found = _LITERAL.match(text, at)
            if found is None:
                fail("Expecting value", at)
            value, at = found[0], found.end()
            value = _WORDS[value] if value in _WORDS else _Number(value)
        # Put the value into its container, and close what ends here.
        while True:
            inside, key = stack[-1]
            if key is None:
                inside.append(value)
            else:
                inside[key] = value
            at = skip(at)
            if len(stack) == 1:
                if at != len(text):
                    fail("Extra data", at)
                return root[0]
            ch, end = text[at:at + 1], "]" if key is None else "}"
            if ch == ",":
                at = skip(at + 1)
                if key is not None:
                    key, at = name_at(at)
                    stack[-1] = (inside, key)
                break
            if ch != end:
                fail("Expecting ',' delimiter", at)
            stack.pop()
            value, at = inside, at + 1


def _decoded(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _decode_deep(text)


class _Nodes:
    """Nodes of many documents as typed columns; the kind is a place in ``KINDS``."""

    KINDS = ("object", "array", "string", "number", "bool", "null")

    def __init__(self) -> None:
        self.size, self.depth, self.at, self.len = (array("i") for _ in range(4))
        self.kind = array("b")
        self.key: list[str | None] = []
        self.text: list[str | None] = []

    def __len__(self) -> int:
        return len(self.size)

    def cut(self, n: int) -> None:
        """Keep the first ``n`` nodes only."""
        for column in vars(self).values():
            del column[n:]

    def arrow(self, offsets: list[int]) -> pa.ListArray:
        """One list of nodes per document; document i ends before ``offsets[i + 1]``."""
        def whole(column) -> pa.Array:
            return pa.array(np.asarray(column, np.int32))

        starts = np.asarray(offsets, np.int32)
        kinds = pa.DictionaryArray.from_arrays(
            pa.array(np.asarray(self.kind, np.int8)), pa.array(self.KINDS, pa.string()))
        columns = {
            "pos": whole(np.arange(len(self)) - np.repeat(starts[:-1], np.diff(starts))),
            "size": whole(self.size), "depth": whole(self.depth), "key": pa.array(self.key, pa.string()),
            "kind": kinds.cast(pa.string()), "text": pa.array(self.text, pa.string()),
            "at": whole(self.at), "len": whole(self.len),
        }
        return pa.ListArray.from_arrays(
            pa.array(starts),
            pa.StructArray.from_arrays([columns[f.name] for f in _ARROW_NODE], fields=list(_ARROW_NODE)))


_OBJECT, _ARRAY, _STRING, _NUMBER, _BOOL, _NULL = range(len(_Nodes.KINDS))


class _Unusual(Exception):
    """No JSON, or an object with equal keys: for ``_document_of`` the decoded value."""


def _document(text: str, nodes: _Nodes) -> str:
    """Canonical text of one JSON text, of any depth, its nodes put to ``nodes``; ValueError where
    it is not JSON."""
    known = len(nodes)
    try:
        return _document_at_once(text, nodes)
    except (_Unusual, json.JSONDecodeError):
        nodes.cut(known)
    return _document_of(_decoded(text), nodes)


def _document_at_once(text: str, nodes: _Nodes) -> str:
    """``_document`` in one pass over the text, without a decoded value."""
    text += "\0"  # so that there is a character after every value
    parts: list[str] = []
    write, sizes, lens = parts.append, nodes.size, nodes.len
    add_size, add_depth, add_at, add_len = sizes.append, nodes.depth.append, nodes.at.append, lens.append
    add_key, add_kind, add_text = nodes.key.append, nodes.kind.append, nodes.text.append
    blank, literal = _BLANK.match, _LITERAL.match
    # The innermost open container: its node, its keys (None of an array), where its text begins,
    # the character that ends it; and those around it.
    inside, seen, begun, closing = -1, None, 0, ""
    stack: list[tuple] = []
    opened = stack.append
    n, at, depth, key = len(nodes), 0, 0, None
    i = blank(text).end()
    while True:
        # A value begins at i.
        ch = text[i]
        add_key(key)
        add_depth(depth)
        add_at(at)
        if ch == "[" or ch == "{":
            add_kind(_ARRAY if ch == "[" else _OBJECT)
            add_text(None)
            add_size(1)
            add_len(2)
            write(ch)
            i += 1
            end = "]" if ch == "[" else "}"
            ch = text[i]
            if ch in " \t\n\r":
                i = blank(text, i).end()
                ch = text[i]
            if ch != end:
                opened((inside, seen, begun, closing))
                inside, begun, closing, seen, key = n, at, end, None, None
                n += 1
                at += 1
                depth += 1
                if end == "]":
                    continue
                seen = set()
                key, i = _key_at(text, i, seen)
                part = _quoted(key) + ": "
                write(part)
                at += len(part)
                continue
            write(end)
            at += 2
            i += 1
        else:
            if ch == '"':
                value, i = scanstring(text, i + 1, True)
                value = _valid(value)
                add_kind(_STRING)
                part = _quoted(value)
            else:
                found = literal(text, i)
                if found is None:
                    raise _Unusual
                value, i = found[0], found.end()
                if value == "null":
                    add_kind(_NULL)
                    part, value = value, None
                elif value in _WORDS:
                    add_kind(_BOOL)
                    part = value
                else:
                    add_kind(_NUMBER)
                    part = _Number(value).canonical()
            add_text(value)
            add_size(1)
            add_len(len(part))
            write(part)
            at += len(part)
        n += 1
        # Close what ends here, up to the next value.
        while True:
            ch = text[i]
            if ch in " \t\n\r":
                i = blank(text, i).end()
                ch = text[i]
            if ch == closing:
                write(ch)
                at += 1
                i += 1
                sizes[inside] = n - inside
                lens[inside] = at - begun
                inside, seen, begun, closing = stack.pop()
                depth -= 1
                key = None
                continue
            if inside < 0:
                if i != len(text) - 1:
                    raise _Unusual
                return "".join(parts)
            if ch == ",":
                write(", ")
                at += 2
                i += 1
                if text[i] in " \t\n\r":
                    i = blank(text, i).end()
                if seen is not None:
                    key, i = _key_at(text, i, seen)
                    part = _quoted(key) + ": "
                    write(part)
                    at += len(part)
                break
            raise _Unusual


#: A key without escapes, up to where its value begins.
_PLAIN_KEY = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*')


def _key_at(text: str, i: int, seen: set[str]) -> tuple[str, int]:
    """The key that begins at ``i``, and where its value begins."""
    found = _PLAIN_KEY.match(text, i)
    if found is not None:
        key, i = found[1], found.end()
    else:
        if text[i] != '"':
            raise _Unusual
        key, i = scanstring(text, i + 1, True)
        i = _BLANK.match(text, i).end()
        if text[i] != ":":
            raise _Unusual
        i = _BLANK.match(text, i + 1).end()
    if key in seen:
        raise _Unusual
    seen.add(key)
    return _valid(key), i


def _document_of(value, nodes: _Nodes) -> str:
    """``_document`` of a decoded value."""
    parts: list[str] = []
    at = 0

    def write(part: str) -> None:
        nonlocal at
        parts.append(part)
        at += len(part)

    def begin(value, key: str | None, depth: int) -> tuple | None:
        """Write a value; of a container the opening, and return what is left of it."""
        node = len(nodes)
        nodes.size.append(1)
        nodes.depth.append(depth)
        nodes.key.append(key)
        nodes.at.append(at)
        nodes.len.append(0)
        text = None
        if isinstance(value, dict):
            kind, opened = _OBJECT, (node, iter(value.items()), "}")
            write("{")
        elif isinstance(value, list):
            kind, opened = _ARRAY, (node, ((None, child) for child in value), "]")
            write("[")
        else:
            opened = None
            if isinstance(value, str):
                kind, text = _STRING, _valid(value)
                write(_quoted(text))
            elif isinstance(value, _Number):
                kind, text = _NUMBER, value.literal
                write(value.canonical())
            elif value is None:
                kind = _NULL
                write("null")
            else:
                kind, text = _BOOL, "true" if value else "false"
                write(text)
            nodes.len[node] = at - nodes.at[node]
        nodes.kind.append(kind)
        nodes.text.append(text)
        return opened

    opened = begin(value, None, 0)
    stack = [opened] if opened else []
    while stack:
        node, rest, end = stack[-1]
        item = next(rest, None)
        if item is None:
            write(end)
            nodes.size[node], nodes.len[node] = len(nodes) - node, at - nodes.at[node]
            stack.pop()
            continue
        key, child = item
        if len(nodes) > node + 1:
            write(", ")
        if key is not None:
            key = _valid(key)
            write(_quoted(key) + ": ")
        opened = begin(child, key, nodes.depth[node] + 1)
        if opened:
            stack.append(opened)
    return "".join(parts)


def _parse_batch(texts: list[str | None]) -> list[pa.Array]:
    invalid, kinds, canonicals, offsets, nodes = [], [], [], [0], _Nodes()
    for text in texts:
        problem = canonical = kind = None
        known = len(nodes)
        try:
            if text:
                canonical = _document(text, nodes)
                kind = nodes.KINDS[nodes.kind[known]]
        except json.JSONDecodeError as e:
            problem = "trailing data after JSON value" if e.msg == "Extra data" else e.msg
        except ValueError as e:
            problem = str(e)
        invalid.append(problem)
        kinds.append(kind)
        canonicals.append(canonical)
        offsets.append(len(nodes))
    texts_of = [pa.array(c, pa.string()) for c in (invalid, kinds, canonicals)]
    return [*texts_of, nodes.arrow(offsets)]


def parse_json(df: DataFrame, json_col: str) -> DataFrame:
    """Add ``invalid``, ``kind``, ``canonical`` and ``nodes`` of a JSON text column.

    Empty and null texts give null in all of them. A node knows its position, the size of its
    subtree, its depth, key and kind, the text of a string or the literal of a number, and
    where its canonical text lies (``at``, ``len`` in code points). Columns that have one of the
    four names are replaced; all others stay.
    """
    parsed = T.StructType.fromDDL(PARSED_TYPE)

    @F.arrow_udf(parsed)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for piece in pieces(texts):
                yield pa.StructArray.from_arrays(_parse_batch(piece.to_pylist()), names=parsed.names)

    taken = {c.lower() for c in df.columns}
    one = next(n for i in count() if (n := f"parsed_{i}") not in taken)
    rest = ["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in parsed.names]
    return df.withColumn(one, parse(col(json_col))).select(
        *rest, *[F.col(one)[name].alias(name) for name in parsed.names])


# --- reading nodes ----------------------------------------------------------------------------


def children(nodes: Column, node: Column) -> Column:
    """Direct children of a node, in order."""
    inside = F.slice(nodes, node["pos"] + 2, node["size"] - 1)
    return F.filter(inside, lambda n: n["depth"] == node["depth"] + 1)


def child(kids: Column, key: str) -> Column:
    """The child with this key, or null."""
    return F.try_element_at(F.filter(kids, lambda n: n["key"] == key), F.lit(1))


def node_json(canonical: Column, node: Column) -> Column:
    """Canonical JSON text of a node."""
    return F.substring(canonical, node["at"] + 1, node["len"])


def node_text(canonical: Column, node: Column) -> Column:
    """A string as it is, anything else as JSON text."""
    return F.when(node["kind"] == "string", node["text"]).otherwise(node_json(canonical, node))


def flatten_text(nodes: Column, node: Column) -> Column:
    """String leaves below a node, joined by one space and cut to the detection window."""
    inside = F.slice(nodes, node["pos"] + 1, node["size"])
    strings = F.filter(
        inside,
        lambda n: (n["kind"] == "string")
        & (n["depth"] - node["depth"] <= fixed.DETECTION_DEPTH),
    )
    return first_chars(F.array_join(strings["text"], " "), fixed.DETECTION_CHARS)


#: Characters of strings that compact JSON escapes beyond what JSON asks for.
_ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


def _compact(text: str) -> str:
    """JSON without spaces: keys in order, numbers as written, strings safe inside HTML."""
    def string(value: str) -> str:
        return _quoted(_valid(value)).translate(_ESCAPED)

    def simple(value) -> str | None:
        if isinstance(value, str):
            return string(value)
        if isinstance(value, _Number):
            return value.literal
        return {None: "null", True: "true", False: "false"}.get(value) if not isinstance(
            value, (dict, list)) else None

    out: list[str] = []
    stack: list[tuple] = []
    value, at = _decoded(text), ""
    while True:
        out.append(at)
        plain = simple(value)
        if plain is not None:
            out.append(plain)
        elif isinstance(value, dict):
            out.append("{")
            stack.append((iter(value.items()), "}", True))
        else:
            out.append("[")
            stack.append((iter(value), "]", False))
        first = plain is None
        while stack:
            rest, end, keyed = stack[-1]
            item = next(rest, stack)
            if item is not stack:
                break
            out.append(end)
            stack.pop()
            first = False
        else:
            return "".join(out)
        at = "" if first else ","
        if keyed:
            key, value = item
            at += string(key) + ":"
        else:
            value = item


def _compact_or_null(text: str | None) -> str | None:
    try:
        return None if text is None else _compact(text)
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def compact_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compact ordered form of JSON texts, null for null and for what is no JSON. ``parse_json``
    reads it back to the nodes of the original."""
    for texts in batches:
        for piece in pieces(texts):
            yield pa.array([_compact_or_null(t) for t in piece.to_pylist()], pa.string())


_FIELD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("size", T.IntegerType()), T.StructField("number", T.DoubleType()),
    T.StructField("text", T.StringType())])


def _plain(value):
    """A decoded value with its numbers as doubles, so that 1 and 1.0 are the same."""
    if isinstance(value, _Number):
        return float(value.literal)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _field_rows(text: str) -> list[tuple]:
    """(path, kind, size, number, text) of the root and every value that only objects lie above.

    A path is a JSON pointer. Arrays are one value, written with sorted keys and double numbers.
    """
    out, stack = [], [("", _decoded(text))]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            out.append((path, "object", len(value), None, None))
            stack += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", v)
                      for k, v in value.items()]
        elif isinstance(value, _Number):
            out.append((path, "number", None, float(value.literal), None))
        elif value is None:
            out.append((path, "null", 0, 0.0, None))
        else:
            kind = {list: "array", str: "string", bool: "bool"}[type(value)]
            out.append((path, kind, None, None, json.dumps(_plain(value), sort_keys=True)))
    return out


_ARROW_FIELD = pa.struct(list(zip(
    _FIELD.names, (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string()))))


def _fields_or_null(text: str | None) -> list[dict] | None:
    try:
        return None if text is None else [dict(zip(_FIELD.names, r)) for r in _field_rows(text)]
    except (ValueError, RecursionError):  # no JSON, or arrays too deep to be written as one
        return None


@F.arrow_udf(T.ArrayType(_FIELD))
def json_fields(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Values of JSON documents by path, for comparisons; null for what is no JSON."""
    for texts in batches:
        for piece in pieces(texts):
            yield pa.array([_fields_or_null(t) for t in piece.to_pylist()], pa.list_(_ARROW_FIELD))


def leaf_rows(df: DataFrame) -> DataFrame:
    """Long form of ``nodes``: one row per node that is not an object or array."""
    rest = [c for c in df.columns if c not in ("nodes", "invalid", "kind", "canonical")]
    leaves = F.filter("nodes", lambda n: ~n["kind"].isin("object", "array"))
    return df.select(*rest, F.explode(leaves).alias("n")).select(*rest, "n.*")
