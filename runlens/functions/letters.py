"""Answer-letter extraction for the multiple-choice task.

The two rules are deliberately different and must never be merged:

* ``normalize_letter`` (grader): strip + upper; a *substring* of ``ABCD``
  (including the empty string, ``AB``, ``BCD``) passes unchanged; otherwise the
  first of A-D by position in the text; otherwise ``""``.
* ``parse_letter`` (agent side): a greedy ``{...}`` block parsed as JSON and its
  ``answer`` field; then the whole text; then ``ANSWER IS X``; then
  ``ANSWER: X``; then the first of A, B, C, D *in that order* found anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .json import strict_json
from .text import py_strip

def _is_letter_substring(u: Column) -> Column:
    # Python: ``u in "ABCD"`` -- a substring test, true for "".
    return F.contains(F.lit(C.LETTERS), u)


def normalize_letter(col: Column) -> Column:
    """The grader's normalisation.  NULL behaves like ``str(None)``."""
    u = F.upper(py_strip(F.coalesce(col.cast("string"), F.lit("None"))))
    return F.when(_is_letter_substring(u), u).otherwise(F.regexp_extract(u, "[ABCD]", 0))


def parse_letter(raw: Column) -> Column:
    """The agent-side parser of a raw model response."""
    text = F.coalesce(raw.cast("string"), F.lit(""))
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    doc = strict_json(F.when(block != "", block))
    is_obj = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    ans_v = F.try_variant_get(doc, "$.answer", "variant")
    ans_kind = F.schema_of_variant(ans_v)
    # str(data.get("answer", "")): absent -> "", string -> itself; any other JSON
    # kind renders to text that can never be a substring of ABCD.
    json_ans = (
        F.when(ans_v.isNull(), F.lit(""))
        .when(ans_kind == "STRING", F.upper(py_strip(F.try_variant_get(doc, "$.answer", "string"))))
        .otherwise(F.lit("#"))
    )
    whole = F.upper(py_strip(text))
    is_phrase = F.regexp_extract(whole, "ANSWER IS ([ABCD])", 1)
    colon = F.regexp_extract(whole, "ANSWER: ([ABCD])", 1)
    first_in_order = (
        F.when(F.contains(whole, F.lit("A")), F.lit("A"))
        .when(F.contains(whole, F.lit("B")), F.lit("B"))
        .when(F.contains(whole, F.lit("C")), F.lit("C"))
        .when(F.contains(whole, F.lit("D")), F.lit("D"))
        .otherwise(F.lit(""))
    )
    return (
        F.when(is_obj & _is_letter_substring(json_ans), json_ans)
        .when(_is_letter_substring(whole), whole)
        .when(is_phrase != "", is_phrase)
        .when(colon != "", colon)
        .otherwise(first_in_order)
    )
