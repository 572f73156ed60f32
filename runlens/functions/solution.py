"""Open-answer extraction and equality.

A solution value is ``STRUCT<kind STRING, list ARRAY<STRING>, scalar STRING>``
with ``kind`` one of ``list``, ``int``, ``str`` (``bool`` may come from JSON
truth files); NULL means "no solution".  ``int`` values carry their canonical
decimal text, so ``0218``, ``+218`` and ``2_18`` all become ``218``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import json_kind, strict_json, variant_elements
from .text import WS_BODY, WS_CLASS, py_strip, py_strip_chars

SOLUTION_TYPE = "struct<kind:string,list:array<string>,scalar:string>"

# Python's int(): surrounding whitespace, a sign, digits with single underscores.
_INT_TEXT = rf"^{WS_CLASS}*[+-]?[0-9]+(_[0-9]+)*{WS_CLASS}*\z"
_LIST_ITEM = rf"[\"']?([^,\[\]\"'{WS_BODY}]+)[\"']?"


def _solution(kind: Column, lst: Column, scalar: Column) -> Column:
    return F.struct(kind.alias("kind"), lst.alias("list"), scalar.alias("scalar"))


def canonical_int(text: Column) -> Column:
    """Canonical decimal text of an integer literal accepted by Python's ``int()``."""
    sign = F.regexp_extract(text, rf"^{WS_CLASS}*([+-]?)", 1)
    digits = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9_]*)", 1), "_", "")
    digits = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(digits == "0", F.lit("0")).otherwise(F.concat(F.when(sign == "-", F.lit("-")).otherwise(F.lit("")), digits))


def py_str_of_json(v: Column) -> Column:
    """``str(x)`` of a parsed JSON element for the common kinds."""
    kind = json_kind(v)
    return (
        F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        .when(kind == "bool", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .when(kind == "null", F.lit("None"))
        .otherwise(F.to_json(v))
    )


def extract_solution(response: Column) -> Column:
    """The value after ``solution =`` on its line, as a solution struct."""
    text = response.cast("string")
    pattern = rf"(?iud)solution{WS_CLASS}*={WS_CLASS}*(.+?)(?:\n|$)"
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    s = py_strip(found)
    as_json = strict_json(F.regexp_replace(s, "'", '"'))
    elements = variant_elements(as_json)
    parsed_list = F.transform(elements, lambda x: py_strip(py_str_of_json(x)))
    loose_list = F.regexp_extract_all(s, F.lit(_LIST_ITEM), 1)
    scalar = py_strip_chars(s, "\"'")
    is_int = scalar.rlike(_INT_TEXT)
    as_list = _solution(F.lit("list"), F.coalesce(parsed_list, loose_list), F.lit(None).cast("string"))
    as_scalar = _solution(
        F.when(is_int, F.lit("int")).otherwise(F.lit("str")),
        F.lit(None).cast("array<string>"),
        F.when(is_int, canonical_int(scalar)).otherwise(scalar),
    )
    return (
        F.when((text.isNull()) | (text == "") | (found == ""), F.lit(None).cast(SOLUTION_TYPE))
        .when(s.startswith("["), as_list)
        .otherwise(as_scalar)
    )


def solution_from_json(v: Column) -> Column:
    """A solution struct from a parsed JSON value (truth files, ``solution`` fields)."""
    kind = json_kind(v)
    elements = variant_elements(v)
    return (
        F.when(v.isNull() | (kind == "null"), F.lit(None).cast(SOLUTION_TYPE))
        .when(kind == "array", _solution(F.lit("list"), F.transform(elements, py_str_of_json), F.lit(None).cast("string")))
        .when(kind == "string", _solution(F.lit("str"), F.lit(None).cast("array<string>"), py_str_of_json(v)))
        .when(kind == "int", _solution(F.lit("int"), F.lit(None).cast("array<string>"), F.to_json(v)))
        .when(kind == "bool", _solution(F.lit("bool"), F.lit(None).cast("array<string>"), py_str_of_json(v)))
        .otherwise(_solution(kind, F.lit(None).cast("array<string>"), F.to_json(v)))
    )


def _set_of(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def open_equal(pred: Column, exp: Column) -> Column:
    """Open-answer equality.

    NULL prediction -> false; list vs list -> same length and (equal, or equal
    as sets: ``[a,a,b]`` equals ``[a,b,b]``); str/int/bool vs str/int ->
    stripped text equality; anything else -> false.
    """
    scalar_kinds = ("str", "int", "bool")
    both_lists = (pred.kind == "list") & (exp.kind == "list")
    list_eq = (F.size(pred.list) == F.size(exp.list)) & (
        (pred.list == exp.list) | (_set_of(pred.list) == _set_of(exp.list))
    )
    both_scalar = pred.kind.isin(*scalar_kinds) & exp.kind.isin("str", "int")
    scalar_eq = py_strip(pred.scalar) == py_strip(exp.scalar)
    return F.coalesce(
        F.when(pred.isNull() | exp.isNull(), F.lit(False))
        .when(both_lists, list_eq)
        .when(both_scalar, scalar_eq)
        .otherwise(F.lit(False)),
        F.lit(False),
    )


__all__ = ["SOLUTION_TYPE", "extract_solution", "solution_from_json", "open_equal", "canonical_int"]
