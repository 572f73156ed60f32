r"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A text is its lower-cased runs of letters and digits, as 64-bit word hashes.  A
seed is a window of ``SPAN`` words seen through a mask that ignores some of its
positions.  ``MASKS`` ignores every third position, at each of three phases, so one
changed word in a window leaves at least one seed as it was.  The seeds of
all windows of the items meet those of all windows of the documents; around each hit
the whole item is laid over the document on the hit's diagonal and the
words that agree are counted, where a word off the diagonal by up to ``SHIFT``
counts if a neighbour agrees at the same shift (a word was put in or left out).
The diagonals of a (text, item) are united: an item position counts if it agrees on
any of them with most of the words beside it, so words put in anywhere between two
hits lose nothing, and lone words that agree by chance on one of many diagonals add
nothing.  A document holds an item if the agreeing words are ``SHARE`` of it or more,
or if ``RUN`` of them lie within ``REACH`` neighbouring positions of the item, whatever
its length.  A moved piece without a hit of its own (under ``SPAN`` words) counts only
by ``SHIFT``.

Items of fewer than ``SPAN`` words have no window of a seed.  They are found whole: the
item's word hashes in order are its key, joined to the documents' windows of the same
number of words.  ``least`` is the number of words from which an item is looked for (1:
every item that has a word); a caller whose benchmark holds one-word answers may raise it.

Plan: the document side is not exchanged.  Its seeds are made, probed against the
broadcast benchmark seeds and verified inside one stage, and only narrow rows
(text key, item, agreeing positions), one per run of hits, leave it.  The benchmark side is broadcast if it has at most
``BROADCAST_SEEDS`` seeds, a count that is taken first; a larger one is
joined by an exchange of narrow seed rows, and hits go back to the texts by key.

Defined results: null text and text without a word hold nothing, and items without a
word, null ones included, are held by nothing; copies and repeated rows are found one by one; with an empty table on either
side nothing is found.  Only ``doc_id``, ``item_id`` and ``text`` are read, so extra
columns cannot clash; ``clean`` returns its input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import has_at_most, small_side
from .common import let, table, written

SPAN, SHIFT = 9, 2
#: The positions of a window that each mask keeps.
MASKS = tuple(tuple(p for p in range(SPAN) if p % 3 != phase) for phase in range(3))
SHARE = 60  # percent of the item's words
RUN, REACH = 24, 30
#: A position counts in the union if so many of the ``2 * BESIDE + 1`` around it agree on the diagonal.
BESIDE, SUPPORT = 4, 5
BROADCAST_SEEDS = 400_000
BROADCAST_KEYS = 500_000
_NOT_WORD = r"[^\p{L}\p{N}]+"


def word_hashes(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD, -1), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def content_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _windows(df: DataFrame, at: str) -> DataFrame:
    """``df`` (with ``_h``, the word hashes) by window and mask: ``at`` and ``seed``."""
    n = F.size("_h")
    # no filter on the size: it would be pushed below the projection and hash all words twice
    w = df.withColumn(at, F.explode(F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN))))
    seeds = [F.xxhash64(F.lit(m), *[F.get("_h", F.col(at) + p) for p in mask]) for m, mask in enumerate(MASKS)]
    return w.withColumn("seed", F.explode(F.array(*seeds)))


def _agreeing(doc: Column, item: Column, diagonal: Column) -> Column:
    """``n``, how many of the item's words agree with the document's around the
    diagonal, and ``at``, the positions among them that agree with most words beside them."""

    def same(k: Column, shift: int) -> Column:
        return F.coalesce(F.get(doc, diagonal + k + shift) == F.get(item, k), F.lit(False))

    def near(k: Column) -> Column:
        out = same(k, 0)
        for s in [s for s in range(-SHIFT, SHIFT + 1) if s]:
            out = out | (same(k, s) & (same(k - 1, s) | same(k + 1, s)))
        return out

    def counted(a: Column) -> Column:
        def supported(k: Column) -> Column:
            beside = sum((F.coalesce(F.get(a, k + j), F.lit(0)) for j in range(-BESIDE, BESIDE + 1)), F.lit(0))
            return (F.get(a, k) == 1) & (beside >= SUPPORT)

        n = F.aggregate(a, F.lit(0), lambda x, y: x + y)
        return F.struct(n.alias("n"), F.filter(places, supported).alias("at"))

    places = F.sequence(F.lit(0), F.size(item) - 1)
    return let(F.transform(places, lambda k: near(k).cast("int")), counted)


def _begins(doc: Column, item: Column, q: Column, p: Column) -> Column:
    """Whether the windows just before do not hit: one row per run of hits on a diagonal is enough."""
    same = [F.coalesce(F.get(doc, q - 1 + j) == F.get(item, p - 1 + j), F.lit(False)) for j in range(SPAN)]
    before = F.lit(False)
    for mask in MASKS:
        every = F.lit(True)
        for j in mask:
            every = every & same[j]
        before = before | every
    return ~(before & (q > 0) & (p > 0))


def _verified(hits: DataFrame) -> DataFrame:
    """``key, item_id, matched, n_words`` of hits with ``key, _h, item_id, _k, _b, diagonal``."""
    m = hits.select("key", "item_id", "_k", F.size("_b").alias("n_words"), _agreeing(F.col("_h"), F.col("_b"), F.col("diagonal")).alias("v"))
    m = m.groupBy("key", "item_id", "_k", "n_words").agg(F.max("v.n").alias("most"), F.collect_set("v.at").alias("_at"))
    m = m.withColumn("_at", F.sort_array(F.array_distinct(F.flatten("_at"))))
    m = m.withColumn("matched", F.greatest("most", F.size("_at")))
    close = F.exists(F.sequence(F.lit(0), F.size("_at") - RUN), lambda i: F.get("_at", i + RUN - 1) - F.get("_at", i) < REACH)
    held = (F.col("matched") * 100 >= F.col("n_words") * SHARE) | F.when(F.size("_at") >= RUN, close).otherwise(F.lit(False))
    return m.where(held).groupBy("key", "item_id", "n_words").agg(F.max("matched").alias("matched"))


def _whole(docs: DataFrame, items: DataFrame, bound: int, least: int) -> DataFrame | None:
    """Items of fewer than ``SPAN`` words that stand in a text word by word: ``key, item_id, n_words, matched``."""
    short = items.where((F.size("_h") >= least) & (F.size("_h") < SPAN)).select("item_id", F.col("_h").alias("_w")).distinct()
    sizes = sorted(r.n for r in short.select(F.size("_w").alias("n")).distinct().collect())  # fewer than SPAN numbers
    if not sizes:
        return None
    d = docs.select(content_key(F.col("text")).alias("key"), word_hashes(F.col("text")).alias("_h")).withColumn("_n", F.explode(F.array(*map(F.lit, sizes))))
    n = F.size("_h")
    d = d.withColumn("_q", F.explode(F.when(n >= F.col("_n"), F.sequence(F.lit(0), n - F.col("_n")))))
    d = d.select("key", F.slice("_h", F.col("_q") + 1, F.col("_n")).alias("_w"))
    near = d.join(F.broadcast(short) if has_at_most(short, bound) else short, "_w")
    return near.select("key", "item_id", F.size("_w").alias("n_words"), F.size("_w").alias("matched")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_SEEDS, least: int = 1) -> DataFrame:
    """Verified overlaps by content: ``key, item_id, n_words, matched``."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("_h"))
    short, long = _whole(docs, items, bound, least), _seeded(docs, items.where(F.size("_h") >= least), bound)
    # rows of one item_id may hold a short and a long text
    return long if short is None else long.unionByName(short).groupBy("key", "item_id", "n_words").agg(F.max("matched").alias("matched"))


def _seeded(docs: DataFrame, items: DataFrame, bound: int) -> DataFrame:
    seeds = _windows(items, "_p").select("seed", "item_id", "_p").distinct()
    # rows of one item_id with other words are items of their own
    items = items.where(F.size("_h") >= SPAN).select("item_id", F.xxhash64("_h").alias("_k"), F.col("_h").alias("_b")).distinct()
    texts = docs.select(content_key(F.col("text")).alias("key"), word_hashes(F.col("text")).alias("_h"))
    found = _windows(texts, "_q")
    if has_at_most(seeds, bound):
        near = found.join(F.broadcast(seeds), "seed").withColumn("diagonal", F.col("_q") - F.col("_p")).join(F.broadcast(items), "item_id")
        return _verified(near.where(_begins(F.col("_h"), F.col("_b"), F.col("_q"), F.col("_p"))))
    # narrow rows only; the texts are met again by key
    near = (found.select("key", "seed", "_q").join(seeds, "seed")
            .select("key", "item_id", (F.col("_q") - F.col("_p")).alias("diagonal")).distinct())
    one = docs.select(content_key(F.col("text")).alias("key"), F.col("text")).groupBy("key").agg(F.first("text").alias("text"))
    whole = near.join(one, "key").select("key", "item_id", "diagonal", word_hashes(F.col("text")).alias("_h"))
    return _verified(whole.join(items, "item_id"))


def leaks(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_SEEDS, least: int = 1) -> DataFrame:
    """One row per document and item that it holds: ``doc_id, item_id, matched, n_words``."""
    ids = docs.select("doc_id", content_key(F.col("text")).alias("key"))
    return ids.join(hits(docs, benchmark, bound, least), "key").select(
        "doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("n_words").cast("long").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_SEEDS, least: int = 1) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    bad = written(hits(docs, benchmark, bound, least).select(F.col("key").alias("_bad")).distinct(), "leaks")
    bad = small_side(bad, BROADCAST_KEYS)  # beyond it, the texts are exchanged by key
    return docs.join(bad, content_key(docs["text"]) == bad["_bad"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of ``documents`` against every item of ``benchmark``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
