"""Metric and insight extraction from free text.

Patterns are the fixed values in ``config``; ``\\s`` is spliced to the explicit
Python whitespace class and ``.``/``$`` use Unix-line semantics, so Java and
RE2 read them like Python does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import WS_BODY, WS_CLASS, preview, py_strip


def java_pattern(py_pattern: str) -> str:
    """A Python pattern with ``\\s`` made explicit (inside and outside classes)."""
    out, i, in_class = [], 0, False
    while i < len(py_pattern):
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < len(py_pattern):
            nxt = py_pattern[i + 1]
            if nxt == "s":
                out.append(WS_BODY if in_class else WS_CLASS)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def log_metric(text: Column, metric: str) -> Column:
    """P7 for one metric: the first pattern (in order) that matches, first occurrence."""
    values = [
        F.nullif(F.regexp_extract(text, "(?id)" + java_pattern(p), 1), F.lit(""))
        for p in C.LOG_METRIC_PATTERNS[metric]
    ]
    return F.coalesce(*values).cast("double")


def log_metrics_struct(text: Column) -> Column:
    return F.struct(*(log_metric(text, m).alias(m) for m in C.LOG_METRIC_PATTERNS))


def insights(text: Column, keep: int = C.INSIGHTS_KEPT) -> Column:
    """Bullets, then numbered items; stripped; longer than 20 and not ending
    in ``:``; the first ``keep``.  ``\\s+`` after the marker may cross lines."""
    flags = "(?md)"
    bullets = F.regexp_extract_all(text, F.lit(flags + java_pattern(C.BULLET_PATTERN)), 1)
    numbered = F.regexp_extract_all(text, F.lit(flags + java_pattern(C.NUMBERED_PATTERN)), 1)
    items = F.transform(F.concat(bullets, numbered), lambda x: py_strip(x))
    kept = F.filter(items, lambda x: (F.length(x) > C.INSIGHT_MIN_LEN) & ~x.endswith(":"))
    return F.slice(kept, 1, keep)


def insight_preview(col: Column) -> Column:
    return preview(col, C.INSIGHT_PREVIEW_LIMIT, C.INSIGHT_MARKER)
