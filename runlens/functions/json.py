"""JSON helpers on top of Spark's VARIANT type.

``try_parse_json`` differs from Python's ``json.loads`` in three ways that
matter for artefacts (see the README):

* trailing text after a complete value is accepted (``[1] x``) -- rejected here
  by parsing the text inside a one-element array and checking the element count;
* duplicate object keys make the whole document NULL (Python keeps the last);
* bare ``NaN``/``Infinity`` are rejected (Python accepts them).

The last two are reported through ``json_bad_reason`` (``DUP_KEY`` for a
repeated top-level key, ``NAN_LITERAL``) rather than silently turned into NULLs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """Parse a JSON document; NULL when it is not exactly one JSON value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]")))
    first = F.try_variant_get(wrapped, "$[0]", "variant")
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return F.when(first.isNotNull() & second.isNull(), first)


def json_kind(v: Column) -> Column:
    """Python-side kind of a VARIANT: object, array, string, int, float, bool, null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(s.startswith("OBJECT"), F.lit("object"))
        .when(s.startswith("ARRAY"), F.lit("array"))
        .when(s == "STRING", F.lit("string"))
        .when(s == "BOOLEAN", F.lit("bool"))
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
        .when(s.startswith("DECIMAL") & s.endswith(",0)"), F.lit("int"))
        .when(s.startswith("DECIMAL"), F.lit("float"))
        .when(s.isin("DOUBLE", "FLOAT"), F.lit("float"))
        .when(s == "VOID", F.lit("null"))
        .otherwise(F.lower(s))
    )


def json_truthy(v: Column) -> Column:
    """Whether Python counts a JSON value as true; an absent one is false."""
    kind = json_kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(
        F.when(kind == "bool", F.try_variant_get(v, "$", "boolean"))
        .when(kind.isin("int", "float"), number != 0)
        .when(kind == "string", F.try_variant_get(v, "$", "string") != "")
        .when(kind == "array", F.size(variant_elements(v)) > 0)
        .when(kind == "object", F.size(variant_entries(v)) > 0), F.lit(False))


def json_bad_reason(text: Column) -> Column:
    """Why a document did not parse: NULL when it did."""
    parsed = strict_json(text)
    # A top-level object read as a map keeps repeated keys, which VARIANT rejects.
    top = F.from_json(text, "map<string,string>")
    return (
        F.when(parsed.isNotNull(), F.lit(None))
        .when(text.isNull(), F.lit("UNREADABLE"))
        .when(F.length(F.trim(text)) == 0, F.lit("EMPTY"))
        .when(text.rlike(r"(^|[\[:,\s])(NaN|-?Infinity)([\]},\s]|$)"), F.lit("NAN_LITERAL"))
        .when(F.size(F.map_keys(top)) > F.size(F.array_distinct(F.map_keys(top))), F.lit("DUP_KEY"))
        .when(F.try_parse_json(text).isNotNull(), F.lit("TRAILING_DATA"))
        .otherwise(F.lit("INVALID_JSON"))
    )


def accuracy_percent(doc: Column) -> Column:
    """P10: ``accuracy_percent`` if present, else ``accuracy * 100`` when numeric (bools count)."""
    pct = F.try_variant_get(doc, "$.accuracy_percent", "double")
    acc_v = F.try_variant_get(doc, "$.accuracy", "variant")
    kind = json_kind(acc_v)
    acc_num = F.when(kind == "bool", F.try_variant_get(doc, "$.accuracy", "boolean").cast("double")).when(
        kind.isin("int", "float"), F.try_variant_get(doc, "$.accuracy", "double")
    )
    return F.coalesce(pct, acc_num * 100.0)


def variant_entries(v: Column) -> Column:
    """A JSON object as ``MAP<STRING, VARIANT>`` (NULL for other kinds)."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def variant_elements(v: Column) -> Column:
    """A JSON array as ``ARRAY<VARIANT>`` (NULL for other kinds)."""
    return F.try_variant_get(v, "$", "array<variant>")


def scalar_metrics(df, doc_col: str, keys: list[str]):
    """Top-level scalars (int, float, string, bool) of a JSON object as long rows.

    Returns ``keys + [key, kind, num, str]``; nulls, objects and arrays are dropped
    and non-object documents produce no rows.
    """
    rows = df.select(*keys, F.explode(variant_entries(F.col(doc_col))).alias("key", "value"))
    kind = json_kind(F.col("value"))
    return rows.select(
        *keys,
        "key",
        kind.alias("kind"),
        F.when(kind == "bool", F.try_variant_get("value", "$", "boolean").cast("double"))
        .when(kind.isin("int", "float"), F.try_variant_get("value", "$", "double"))
        .alias("num"),
        F.when(kind == "string", F.try_variant_get("value", "$", "string"))
        .when(kind == "bool", F.when(F.try_variant_get("value", "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .when(kind.isin("int", "float"), F.to_json("value"))
        .alias("str"),
    ).where(F.col("kind").isin("int", "float", "string", "bool"))
