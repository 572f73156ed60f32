"""Flatten nested JSON objects of any depth into dotted-key rows.

Null and empty-string values are skipped, nested objects go on with a dotted prefix, and
everything else prints as a browser would: ``true``, ``50`` for 50.0, arrays joined by
``", "`` (arrays inside by ``","``, objects inside as ``[object Object]``).

The input is scanned once: each document's text goes through one small helper with a
stack of its own, so neither the plan nor the recursion limit bounds the depth.  A
document that is no object (or null) gives no rows.  Key columns may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def js_number(token: str) -> str:
    """A JSON number as a browser prints it."""
    value = float(token)
    if value == 0:
        return "0"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    shortest = Decimal(repr(value))
    if 1e-6 <= abs(value) < 1e21:
        text = format(shortest, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    sign, digits, power = shortest.normalize().as_tuple()
    head = str(digits[0]) + ("." + "".join(map(str, digits[1:])) if len(digits) > 1 else "")
    power += len(digits) - 1
    return f"{'-' if sign else ''}{head}e{'+' if power > 0 else ''}{power}"


class _Number(str):
    """A number as it was written."""


def _joined(items: list, by: str) -> str:
    """``items.join(by)`` of an array, with a stack for the arrays inside."""
    out, todo = [], [(items, 0, by)]
    while todo:
        values, i, sep = todo.pop()
        if i == len(values):
            continue
        if i:
            out.append(sep)
        todo.append((values, i + 1, sep))
        if isinstance(values[i], list):
            todo.append((values[i], 0, ","))
        else:
            out.append("" if values[i] is None else js_string(values[i]))
    return "".join(out)


def js_string(value) -> str:
    """``String(value)`` of a JSON value; arrays of the top level are joined by ``", "``."""
    if isinstance(value, _Number):
        return js_number(value)
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dict):
        return "[object Object]"
    return _joined(value, ", ")


def entries(text: str | None) -> list[tuple[str, str]]:
    """Dotted keys and printed values of one JSON document, in order."""
    if text is None:
        return []
    doc = _parsed(text)
    if not isinstance(doc, dict):
        return []
    out, todo = [], [iter([("", doc)])]
    while todo:
        at = next(todo[-1], None)
        if at is None:
            todo.pop()
            continue
        key, value = at
        if isinstance(value, dict):
            todo.append(iter([(f"{key}.{k}" if key else k, v) for k, v in value.items()]))
        elif value is not None and value != "":
            out.append((key, js_string(value)))
    return out


def _parsed(text: str):
    """The parsed document; a stack of its own takes over where nesting is beyond the parser's."""
    if text.count("{") + text.count("[") < 400:
        return json.loads(text, parse_int=_Number, parse_float=_Number)
    decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number)
    root: list = []
    stack: list = [root]
    keys: list = [None]
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "{[":
            new: dict | list = {} if c == "{" else []
            _put(stack[-1], keys, new)
            stack.append(new)
            keys.append(None)
            i += 1
        elif c in "}]":
            stack.pop()
            keys.pop()
            i += 1
        elif c in ",: \t\r\n":
            i += 1
        else:
            value, i = decoder.raw_decode(text, i)
            if isinstance(stack[-1], dict) and keys[-1] is None:
                keys[-1] = value
            else:
                _put(stack[-1], keys, value)
    return root[0]


def _put(into: dict | list, keys: list, value) -> None:
    if isinstance(into, dict):
        into[keys[-1]] = value
        keys[-1] = None
    else:
        into.append(value)


def flatten_rows(df: DataFrame, doc_col: str, keys: list[str]) -> DataFrame:
    """``keys, key, value``: a row per leaf of the VARIANT column ``doc_col``.

    ``keys`` may hold any names but ``key`` and ``value``.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, values = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for k, v in entries(text.as_py()):
                    at.append(i)
                    names.append(k)
                    values.append(v)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[:-1]], pa.array(names, pa.string()), pa.array(values, pa.string())], names=schema.names)

    return df.select(*[F.col(f"`{k}`") for k in keys], F.to_json(F.col(f"`{doc_col}`")).alias("_doc")).mapInArrow(mapped, schema)
