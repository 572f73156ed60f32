"""String primitives shared by the extractors.

Python's ``str.strip`` and ``\\s`` are Unicode aware, Spark's ``trim`` removes
spaces only and Java's ``\\s`` is ASCII unless asked otherwise.  All extractors
therefore use one explicit character class, which reads the same in Java
regexps (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Fixed value: the characters Python's str.isspace() accepts, as a regexp class.
WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same class without the square brackets, to splice into other classes.
WS_BODY = WS_CLASS[1:-1]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Fixed value: the same characters as a plain string, for end trimming.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(col: Column | str) -> Column:
    """``str.strip()`` with Python's whitespace set (touches only the two ends)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def py_rstrip_chars(col: Column | str, chars: str) -> Column:
    """``str.rstrip(chars)`` for a fixed set of ASCII characters."""
    return F.regexp_replace(_c(col), "[" + _escape_class(chars) + r"]+\z", "")


def py_strip_chars(col: Column | str, chars: str) -> Column:
    """``str.strip(chars)`` for a fixed set of ASCII characters."""
    cls = "[" + _escape_class(chars) + "]"
    return F.regexp_replace(_c(col), rf"^{cls}+|{cls}+\z", "")


def _escape_class(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)


def preview(col: Column | str, limit: int, marker: str) -> Column:
    """Cut to ``limit`` characters and append ``marker`` only when cut."""
    c = _c(col)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def tail_lines(col: Column | str, n: int = C.TAIL_LINES) -> Column:
    """The last ``n`` lines of ``split('\\n')`` when there are more than ``n``."""
    c = _c(col)
    parts = F.split(c, "\n", -1)
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "\n")).otherwise(c)


def line_count(col: Column | str) -> Column:
    """Number of lines as text-mode ``readlines()`` counts them.

    Universal newlines: ``\r\n``, ``\r`` and ``\n`` each end a line; a last line
    without an ending counts too; empty text has 0 lines.
    """
    c = _c(col)
    breaks = F.regexp_count(c, F.lit(r"\r\n|\r|\n"))
    unterminated = F.when((F.length(c) > 0) & ~c.rlike(r"[\r\n]\z"), 1).otherwise(0)
    return (breaks + unterminated).cast("int")


def parse_percent(col: Column | str) -> Column:
    """``float(str(x).rstrip('%'))`` or NULL when that raises.

    Python's float() also accepts surrounding whitespace, a sign, ``inf``/``nan``
    and underscores between digits; the decimal forms are what metric files
    contain, and they are accepted here.
    """
    s = py_strip(py_rstrip_chars(_c(col).cast("string"), "%"))
    ok = s.rlike(r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")
    return F.when(ok, F.regexp_replace(s, "_", "").cast("double"))
