"""Comma-separated records with quoted fields, as Python's ``csv`` reads them.

A quote opens a field only at its start; inside, ``""`` is a quote and commas and line ends are
text; what follows the closing quote belongs to the field; an unclosed quote runs to the
end of the text.  Records end at ``\\n``, ``\\r`` or ``\\r\\n`` outside quotes; empty lines give no
record.  All quantifiers are possessive, so matching is linear and needs no backtracking.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"?+[^,\r\n]*+|[^,\r\n]*+)'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r\n|\r|\n|\z)"


def csv_records(text: Column) -> Column:
    """The records of a text, unsplit; null gives no record."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RECORD), 1)
    return F.filter(found, lambda r: r != "")


def _unquoted(field: Column) -> Column:
    inner = F.regexp_extract(field, r'(?s)^"([^"]*+(?:""[^"]*+)*+)', 1)
    rest = F.regexp_extract(field, r'(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
    return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)


def csv_fields(record: Column) -> Column:
    """The fields of one record."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), 1)
    return F.transform(raw, _unquoted)
