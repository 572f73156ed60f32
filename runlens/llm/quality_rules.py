"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` computes length, symbol, stop-word and line measures of every whole
text; ``RULES`` holds one row per limit, and ``assess`` compiles the rows into
columns of the same projection.  ``RULES`` is the table of the registered query, whose
SQL fixes it; ``keep``, the pipeline's stage, goes by ``KEEP_RULES``, which judges
repeated lines by their share of the text, and stop words without case and outer
punctuation and only in texts that look like a language of the list: nine letters of ten
are of its alphabets, and one word of twenty has an ending that is common there.  A text
that does not (another language, a table of numbers) is not judged by its stop words.  No user function, join, exchange or aggregate:
the work is one pass over the scan, so a hot source or a group of copies costs
no more than other rows.

Defined results: a null text counts as empty (no words; it fails the length
rule); an empty table gives an empty table; repeated rows are assessed row by row.
``assess`` returns only its own columns, so extra input columns cannot clash;
``keep`` returns the input's columns unchanged and in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, table, words

#: Common function words of the languages covered.
STOP_WORDS = (
    "the be to of and that have with is was for on a in it as are this by at from "
    "der die das und ist ein eine zu den von mit nicht auf für im sich "
    "le la les de et un une des est que qui du dans pour pas "
    "el los las y en por con una se del lo no para"
).split()
#: Letters of those languages, and common endings of their words.
ALPHABET = "a-zäöüßàâçéèêëîïôùûœæñáíóú"
ENDINGS = "ing ion ers est ent ung ich eit sch ten den ait ant eux ado ida ión nte".split()
PUNCTUATION = ".,;:!?\"'()[]«»“”„…-"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails a text when ``100 * measure`` is beyond ``percent * per``; texts with
    fewer than ``from_words`` words or ``from_lines`` lines, or without the Boolean
    measure ``only``, are not judged by the rule."""

    name: str
    measure: str
    side: str  # "above" or "below"
    percent: int
    per: str  # a measure, or "one"
    base: bool = False
    from_words: int = 0
    from_lines: int = 0
    only: str = ""


RULES = (
    Rule("too_few_words", "n_words", "below", 1000, "one", base=True),
    Rule("repeated_words", "n_repeat_words", "above", 20, "n_words", base=True),
    Rule("symbols", "n_symbols", "above", 50, "n_words"),
    Rule("short_words", "word_chars", "below", 200, "n_words"),
    Rule("long_words", "word_chars", "above", 2000, "n_words"),
    Rule("repeated_lines", "n_dup_lines", "above", 30, "n_lines"),
    Rule("few_stop_words", "n_stop_words", "below", 1, "n_words", from_words=100),
)

#: One short line that stands twice among a few lines says nothing of a text: the characters decide, from four lines on.
_KEEP = {
    "repeated_lines": Rule("repeated_lines", "n_dup_line_chars", "above", 30, "n_line_chars", from_lines=4),
    "few_stop_words": Rule("few_stop_words", "n_function_words", "below", 1, "n_words", from_words=100, only="listed_language"),
}
KEEP_RULES = tuple(_KEEP.get(r.name, r) for r in RULES)


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window
    (fewer distinct hashes than windows) are sorted; the covered words are the
    union of the intervals that begin at the repeated windows.
    """

    def covered(hashes: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            at = lambda j: F.get(s, j)["h"]
            twice = F.filter(s, lambda x, j: (at(j - 1) == x["h"]) | (at(j + 1) == x["h"]))
            # get() is null beyond the ends; filter() drops null conditions unless the other side holds
            begins = F.sort_array(F.transform(twice, lambda x: x["i"]))
            none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct((p + window).alias("end"), (a["n"] + p + window - F.greatest(a["end"], p)).alias("n"))
            return F.aggregate(begins, none, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, from_sorted))

    def over(h: Column) -> Column:
        n = F.size(h)
        key = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        return F.when(n > window, let(F.transform(F.sequence(F.lit(0), n - window), key), covered)).otherwise(F.lit(0))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), over)


def _listed(text: Column, ws: Column) -> Column:
    """Whether a text looks like a language of the stop-word list, by its letters and its words' endings."""
    foreign = F.length(F.regexp_replace(F.lower(text), rf"[{ALPHABET}]+|[^\p{{L}}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    ended = F.size(F.filter(ws, lambda w: F.right(F.rtrim(F.lower(w), F.lit(PUNCTUATION)), F.lit(3)).isin(ENDINGS)))
    return (foreign * 10 <= letters) & (ended * 20 >= F.size(ws))


def measures(docs: DataFrame, text: str = "text") -> list[Column]:
    """Measure columns over ``_words``, ``_lines`` and ``_text``."""
    ws, lines, t = F.col("_words"), F.col("_lines"), F.col("_text")
    chars = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    stop = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})
    return [
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        chars(lines).alias("n_line_chars"),
        (chars(lines) - chars(F.array_distinct(lines))).alias("n_dup_line_chars"),
        F.size(F.filter(ws, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_function_words"),
        # short texts are judged by no rule that asks for it
        F.when(F.size(ws) >= 100, _listed(t, ws)).otherwise(F.lit(False)).alias("listed_language"),
    ]


def compiled(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One failing flag per row of the threshold table."""

    def flag(r: Rule) -> Column:
        per = F.lit(1) if r.per == "one" else F.col(r.per)
        left, right = F.col(r.measure) * 100, per * r.percent
        beyond = left > right if r.side == "above" else left < right
        judged = (F.col("n_words") >= r.from_words) & (F.col("n_lines") >= r.from_lines) & (F.col(r.only) if r.only else F.lit(True))
        return (beyond & judged).alias(f"fails_{r.name}")

    return [flag(r) for r in rules]


def _either(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | F.col(f"fails_{r.name}")
    return out


def _judged(docs: DataFrame, carried: list[Column], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    # a line has a word if it has a character that is not white space
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*carried, t.alias("_text"), words(F.col(text)).alias("_words"), lines.alias("_lines"))
    names = [c for c in d.columns if c not in ("_text", "_words", "_lines")]
    d = d.select(*names, *measures(d))
    d = d.select("*", *compiled(rules))
    base = _either([r for r in rules if r.base])
    return d.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~_either([r for r in rules if not r.base]))


def assess(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its key, the measures, a flag per rule, ``base_failed`` and ``kept``."""
    return _judged(docs, [F.col(key)], text, rules)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = KEEP_RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return _judged(docs, [whole], text, rules).where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``."""
    return assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join("'" + x + "'" for x in sorted({x for w in STOP_WORDS for x in (w, w.capitalize())}))

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({_STOP_SQL}))) AS n_stop
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND 100 * n_symbols <= 50 * n_words AND 100 * word_chars >= 200 * n_words
        AND 100 * word_chars <= 2000 * n_words AND 100 * n_dup_lines <= 30 * n_lines
        AND (n_words < 100 OR 100 * n_stop >= n_words)) AS kept
FROM b
"""
