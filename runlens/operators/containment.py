"""Containment join: the first class, in list order, contained in a text.

A nested-loop ``contains(text, class)`` join touches every (text, class) pair.
This operator is an exact k-gram index join instead, in which no text is exchanged:

* every non-empty class has length ``>= m``; with gram length ``k = min(m, 16)`` and
  stride ``S <= m - k + 1``, any occurrence of a class covers some text window starting
  at ``1 + j*S`` whose ``k`` characters equal the class gram at offset
  ``o = window - start`` (``0 <= o < S``);
* a text is cut once into chunks of ``S`` characters (a linear scan) and its windows'
  gram hashes are looked up in the anchors, ``S`` gram hashes a class, without leaving its
  task: anchors and class texts are broadcast, both bounded in bytes (``S`` shrinks until
  the anchors fit).  A candidate is verified on the few chunks that its class covers, which
  are still at hand, so only ``(key, pass, position)`` leaves the task;
* where the class texts are beyond the bound, positional postings (text key, gram hash)
  are joined to the anchors, and only the texts with a candidate are met again.

Work is linear in total text length; hot grams only add candidates, which the
verification discards.  Empty classes match every text and are handled as a
one-row aggregate.

P4 (label extraction) runs two passes: the stripped text against the classes,
then the text with the fixed markers removed against the classes with the
marker character removed; pass 1 wins over pass 2, list position breaks ties,
and texts matching nothing get the first class of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import py_strip

MAX_GRAM = 16
MAX_STRIDE = 64
#: Bytes of class texts, and of anchors, that are broadcast.
MAX_BYTES = 64 << 20
ANCHOR_BYTES = 64       # of one anchor in a hashed relation


def clean_text(text: Column) -> Column:
    """P4 pass-2 text: drop the fixed markers, then strip."""
    t = text
    for marker in C.LABEL_PREFIXES_TO_DROP:
        t = F.replace(t, F.lit(marker), F.lit(""))
    return py_strip(t)


def clean_class(label: Column) -> Column:
    """P4 pass-2 class: drop the marker character, then strip."""
    return py_strip(F.replace(label, F.lit(C.LABEL_SUFFIX_CHAR), F.lit("")))


def class_stats(patterns: DataFrame) -> dict:
    """One small aggregate over the class patterns: shortest non-empty
    length, row count, bytes, empty-pattern presence and the first class."""
    n = F.length("pattern")
    p1 = F.col("pass") == 1
    row = patterns.agg(
        F.min(F.when(n > 0, n)).alias("m"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length("pattern") + F.lit(64)), F.lit(0)).alias("bytes"),
        F.count_if(n == 0).alias("empty"),
        F.min_by(F.when(p1, F.col("pattern")), F.when(p1, F.col("pos"))).alias("first_label"),
        F.min(F.when(p1, F.col("pos"))).alias("first_pos"),
    ).first()
    return row.asDict()


def grams(stats: dict, max_bytes: int) -> tuple[int, int]:
    """Gram length and stride: the longest stride whose anchors stay within the bound."""
    k = min(stats["m"], MAX_GRAM)
    most = max(1, max_bytes // (ANCHOR_BYTES * max(stats["rows"], 1)))
    return k, max(1, min(MAX_STRIDE, stats["m"] - k + 1, most))


def _anchors(classes: DataFrame, k: int, stride: int) -> DataFrame:
    """``h, pass, pos, o``: hashes of each class's grams at the offsets below the stride."""
    at = classes.where(F.length("pattern") > 0).select("pass", "pos", "pattern", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("o"))
    return at.select(F.xxhash64(F.col("pattern").substr(F.col("o") + 1, F.lit(k))).alias("h"), "pass", "pos", "o")


def _windows(texts: DataFrame, keys: list[str], k: int, stride: int) -> DataFrame:
    """``keys, passes, c, j, h``: the gram hash of each window ``j``, beside the text's chunks ``c``."""
    chunks = F.regexp_extract_all(F.col("t"), F.lit("(?s).{1,%d}" % stride), 0)
    cut = texts.where(F.length("t") >= k).select(*keys, "passes", chunks.alias("c"))
    whole = F.col("chunk") if k <= stride else F.array_join(F.slice("c", F.col("j") + 1, -(-k // stride)), "")
    # outer: no text here is without chunks, and no filter on their number is inferred that would cut them twice
    each = cut.select(*keys, "passes", "c", F.posexplode_outer("c").alias("j", "chunk"))
    return each.select(*keys, "passes", "c", "j", F.xxhash64(F.substring(whole, 1, k)).alias("h"))


def contains_first(texts: DataFrame, classes: DataFrame, keys: list[str], stats: dict | None = None,
                   max_bytes: int | None = None) -> DataFrame:
    """For each text row, the best (pass, pos) of a class contained in it.

    ``texts``: keys + ``passes`` (array<int>) + ``t`` -- one row per distinct text variant
    of a key, whose passes do not meet; ``classes``: ``pass``, ``pos``, ``pattern``.
    Returns keys + ``best`` (struct<pass, pos>) for texts with any match.
    """
    stats = stats or class_stats(classes)
    max_bytes = MAX_BYTES if max_bytes is None else max_bytes
    empty = classes.where(F.length("pattern") == 0).groupBy("pass").agg(F.min("pos").alias("pos"))
    parts = []
    if stats["m"]:
        k, stride = grams(stats, max_bytes)
        anchors, windows = _anchors(classes, k, stride), _windows(texts, keys, k, stride)
        of_pass = F.array_contains("passes", F.col("pass"))
        patterns = classes.where(F.length("pattern") > 0).select(F.col("pass").alias("_pass"), F.col("pos").alias("_pos"), "pattern")
        same = (F.col("pass") == F.col("_pass")) & (F.col("pos") == F.col("_pos"))
        if stats["bytes"] <= max_bytes and stats["rows"] * stride * ANCHOR_BYTES <= max_bytes:
            found = windows.join(F.broadcast(anchors), "h").where(of_pass)
            start = F.col("j") * stride - F.col("o")          # of the class, from 0
            head = F.floor(start / stride).cast("int")        # its chunk
            size = F.length("pattern")
            span = F.array_join(F.slice("c", F.greatest(head, F.lit(0)) + 1, (size / stride).cast("int") + 2), "")
            hit = (start >= 0) & (F.substring(span, (start - head * stride + 1).cast("int"), size) == F.col("pattern"))
            hits = found.join(F.broadcast(patterns), same & hit)
        else:
            found = windows.drop("c").join(anchors, "h").where(of_pass).select(*keys, "pass", "pos").distinct()
            met = found.join(patterns, same).drop("_pass", "_pos")
            bodies = texts.select(*keys, "t", F.explode("passes").alias("pass"))
            hits = bodies.join(met, [*keys, "pass"]).where(F.col("t").contains(F.col("pattern")))
        parts.append(hits.select(*keys, "pass", "pos"))
    if stats["empty"]:
        parts.append(
            texts.select(*keys, F.explode("passes").alias("pass")).join(F.broadcast(empty), "pass")
            .select(*keys, "pass", "pos")
        )
    if not parts:
        return texts.select(*keys, F.lit(None).cast("struct<pass:int,pos:bigint>").alias("best")).where(F.lit(False))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # (pass, pos) ordered as one fixed-width key: positions are list indexes
    # below 2**48, so the minimum is a hash aggregate, not a sort.
    code = F.col("pass").cast("bigint") * F.lit(1 << 48) + F.col("pos").cast("bigint")
    best = hits.groupBy(*keys).agg(F.min(code).alias("_c"))
    return best.select(*keys, F.struct(
        F.floor(F.col("_c") / F.lit(1 << 48)).cast("int").alias("pass"),
        F.pmod(F.col("_c"), F.lit(1 << 48)).cast("bigint").alias("pos")).alias("best"))


def extract_label(texts: DataFrame, classes: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """P4 + J7: the predicted class of each text.

    ``classes``: ``pos`` (list order) and ``label``.  Returns keys + label +
    ``pass`` (1 or 2; 0 for the first-class fallback) + ``pos``.
    """
    t1 = py_strip(F.col(text_col))
    vtype = "array<struct<passes:array<int>,t:string>>"
    one = F.array(F.struct(F.array(F.lit(1), F.lit(2)).alias("passes"), F.col("t1").alias("t")))
    two = F.array(
        F.struct(F.array(F.lit(1)).alias("passes"), F.col("t1").alias("t")),
        F.struct(F.array(F.lit(2)).alias("passes"), F.col("t2").alias("t")),
    )
    # One scan: a text whose cleaned form equals it serves both passes.
    variants = texts.select(*keys, t1.alias("t1")).select(*keys, "t1", clean_text(F.col("t1")).alias("t2")) \
        .select(*keys, F.explode(F.when(F.col("t1") == F.col("t2"), one).otherwise(two).cast(vtype)).alias("v")) \
        .select(*keys, "v.passes", "v.t")
    cls = classes.select("pos", "label")
    patterns = cls.select(F.lit(1).alias("pass"), "pos", F.col("label").alias("pattern")).unionByName(
        cls.select(F.lit(2).alias("pass"), "pos", clean_class(F.col("label")).alias("pattern"))
    )
    stats = class_stats(patterns)
    best = contains_first(variants, patterns, keys, stats)
    lookup = F.broadcast(cls) if stats["bytes"] <= MAX_BYTES else cls
    labels = best.select(*keys, "best.pass", "best.pos").join(lookup, "pos", "left")
    out = texts.select(*keys).join(labels, keys, "left")
    # Texts without a match take the first class of the list (one known value).
    return out.select(
        *keys,
        F.coalesce(F.col("label"), F.lit(stats["first_label"])).alias("label"),
        F.coalesce(F.col("pass"), F.lit(0)).cast("int").alias("pass"),
        F.coalesce(F.col("pos"), F.lit(stats["first_pos"]).cast("bigint")).cast("bigint").alias("pos"),
    )
