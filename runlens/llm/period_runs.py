"""Periodic run detection by multi-scale minimizers.

A *run* is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least ``max(least_length, least_repeats * q)`` words that no
neighbouring word extends keeping period q.

1. *Words.*  Each task numbers the words of a group of texts exactly (a dictionary of
   byte strings, no hashing), and puts the texts one after another, longest first, with
   a number of its own between them, so no run crosses texts.
2. *Short periods.*  Up to ``LAGS``, words are compared with those q places on.
3. *Scales.*  Periods in [lo, hi), hi about 1.5 lo, share a scale.  Every place stands for
   the k-gram that begins there, k = hi - 1, and of every W = 2 lo - hi + 2 neighbouring
   places the ones of least (mixed) hash are *minimizers*.  A run of period q in the
   scale has 3 q words or more, so the window at its start and the one q places on both lie in it
   (W + k - 1 = 2 lo <= 2 q) and hold the same words: a minimizer p of the one is p + q in
   the other.  Since k >= q, no place between has that k-gram, else q were not the
   smallest period.  So p and p + q are neighbours among the equal minimizers: each such
   pair at a distance in [lo, hi) is a seed, and there are at most as many seeds as
   minimizers, about 4 / lo of the words.
4. *Extension.*  A seed is extended word by word, to both sides, over the exact
   numbers.  Seeds inside a stretch found for their distance are passed over.  A stretch
   found with several periods keeps the least: if a multiple of q is a period found, so is q.

A scale looks only at texts long enough for it (3 lo words), so the work is about n log n
and a text's memory is a few numbers per word; groups of short texts share the cost of
the array operations.  The k-grams' 64-bit hashes are made by doubling with a mixing step
each, so there is no structured collision; a chance collision can only hide a seed, never
make a wrong run.

Defined results: null text, text without words and short text have no runs, and their
collapsed text is their words joined by a space (empty where there are none); repeated
rows are judged each; an empty table gives an empty table; columns named like an added
one are replaced, all other columns are kept whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, release, table, words

#: Periods that are found by direct comparison.
LAGS = 8
LEAST_LENGTH, LEAST_REPEATS = 24, 3
#: Bytes of text that are taken together (a longer text alone), and cut into words at once.
CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = b" \t\n\x0b\x0c\r"
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least (or ``np.maximum``: greatest) of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[:-(width - have)], x[width - have:]) if width > have else x


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """The ranges [lo, hi) of periods above ``LAGS`` that texts of so many words may have."""
    lo = LAGS + 1
    while 3 * lo <= longest:
        hi = max(lo + 1, 3 * lo // 2)
        yield lo, hi
        lo = hi


def _seeds(grams: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring equal minimizers at a distance in [lo, hi)."""
    width = 2 * lo - hi + 2
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(grams, width)
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    order = np.argsort(grams[at], kind="stable")
    g, at = grams[at][order], at[order]
    apart = np.diff(at)
    ok = np.flatnonzero((g[1:] == g[:-1]) & (apart >= lo) & (apart < hi))
    return at[ok], apart[ok]


def _reach(x: np.ndarray, p: int, lag: int) -> tuple[int, int]:
    """The stretch [b, e) round ``p`` of places that equal the place ``lag`` further on.
    Numbers that occur once stand at both ends of ``x``, so it ends inside."""
    step, e = 64, p + 1
    while True:
        a, b = x[e:e + step], x[e + lag:e + lag + step]
        differ = a[:len(b)] != b
        if differ.any() or not len(b):
            e += int(differ.argmax()) if len(b) else 0
            break
        e, step = e + len(b), 2 * step
    step, b0 = 64, p
    while True:
        lo = max(0, b0 - step)
        differ = x[lo:b0] != x[lo + lag:b0 + lag]
        if differ.any():
            b0 = lo + int(np.flatnonzero(differ)[-1]) + 1
            break
        if not lo:
            return 0, e
        b0, step = lo, 2 * step
    return b0, e


def runs_of(x: np.ndarray, ends: list[tuple[int, int]], least_length: int, least_repeats: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the texts laid out in ``x``, which begins and ends
    with a number that occurs once; ``ends``: (words, end) of each text, longest first."""
    found: dict[tuple[int, int], int] = {}

    def keep(b: int, e: int, lag: int) -> None:
        if e - b + lag >= max(least_length, least_repeats * lag):
            found[b, e + lag] = min(lag, found.get((b, e + lag), lag))

    for lag in range(1, LAGS + 1):
        same = np.zeros(max(len(x) - lag, 0) + 2, dtype=bool)
        same[1:-1] = x[:-lag] == x[lag:]
        cuts = np.flatnonzero(same[1:] != same[:-1])
        b, e = cuts[::2], cuts[1::2]
        for i in np.flatnonzero(e - b + lag >= max(least_length, least_repeats * lag)):
            keep(int(b[i]), int(e[i]), lag)
    have, held = 1, _mixed(x.astype(np.uint64) * _MIX + np.uint64(1))
    for lo, hi in scales(ends[0][0] if ends else 0):
        # texts too short for this scale stand behind the others
        stop = next((end for n, end in reversed(ends) if n >= 3 * lo), 0) + 1
        k = hi - 1
        held = held[:max(stop - have + 1, 0)]
        while 2 * have <= k:
            held = _mixed(held[:-have] * _MIX + held[have:])
            have *= 2
        grams = held if have == k else _mixed(held[:have - k] * _MIX + held[k - have:])
        at, lags = _seeds(grams, lo, hi)
        last: dict[int, int] = {}
        for i in np.lexsort((at, lags)):
            p, lag = int(at[i]), int(lags[i])
            if p < last.get(lag, -1) or x[p] != x[p + lag]:
                continue
            b, e = _reach(x, p, lag)
            last[lag] = e
            keep(b, e, lag)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def _numbered(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers, cut in pieces that end between words."""
    if len(text) <= CHUNK:
        parts = [text]
    else:
        blank = np.isin(np.frombuffer(text, np.uint8), list(_BLANK))
        parts, at = [], 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                after = int(blank[end:].argmax())
                end = end + after if blank[end + after] else len(text)
            parts.append(text[at:end])
            at = end
    out = []
    for part in parts:
        w = part.split()  # bytes split at exactly the six blanks
        out.append(np.fromiter(map(vocabulary.__getitem__, w), np.int64, len(w)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def _collapsed(x: np.ndarray, runs: list[tuple[int, int, int]], names: list[bytes]) -> bytes:
    """The words left when each run keeps its first period only, joined by spaces."""
    if runs:
        keep = np.ones(len(x), dtype=bool)
        for b, n, q in runs:
            keep[b + q:b + n] = False
        x = x[keep]
    return b" ".join([names[i] for i in x.tolist()])


def detect(texts: list[bytes | None], least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> tuple[list, list]:
    """The runs and the collapsed text of each of a group of texts."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    each = [_numbered(t, vocabulary) if t else np.zeros(0, np.int64) for t in texts]
    names = list(vocabulary)
    runs: list[list] = [[] for _ in texts]
    order = sorted((i for i, x in enumerate(each) if len(x) >= least_length), key=lambda i: -len(each[i]))
    if order:
        parts, begins, ends, at = [np.array([len(names)])], [], [], 1
        for j, i in enumerate(order):
            parts += [each[i], np.array([len(names) + 1 + j])]
            begins.append(at)
            ends.append((len(each[i]), at + len(each[i])))
            at += len(each[i]) + 1
        for b, n, q in runs_of(np.concatenate(parts), ends, least_length, least_repeats):
            j = int(np.searchsorted(begins, b, side="right")) - 1
            runs[order[j]].append((b - begins[j], n, q))
    return runs, [_collapsed(x, r, names) for x, r in zip(each, runs, strict=True)]


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK, side="right")) - 1)
        yield first, last
        first = last


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) counted in words, by
    start and then period, and ``collapsed``, the words outside the repeated parts of
    runs joined by one space.  ``least_repeats`` is 3 or more."""
    if least_repeats < 3:
        raise ValueError("the scales find runs of three periods or more")
    rest = [f for f in docs.schema.fields if f.name.lower() not in ("runs", "collapsed")]
    schema = T.StructType([*rest, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]) if len(raw) else np.zeros(0, np.int64)
            for lo, hi in _groups(sizes):
                runs, left = detect(raw.slice(lo, hi - lo).to_pylist(), least_length, least_repeats)
                runs = pa.array([[dict(zip(RUN.names, r, strict=True)) for r in one] for one in runs], kind)
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, runs, pa.array(left, pa.binary()).view(pa.string())], names=schema.names)
        batch = raw = None
        release()

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(mapped, schema)


def planted(text: Column, key: Column) -> Column:
    """Every tenth text (by the checksum of its key) with its words from place a on
    repeating with period p; a null key leaves its text alone."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        later = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, (a + F.pmod(i - a, p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), later), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def _first_of_greatest(runs: Column) -> Column:
    """The run of greatest length / period; they stand by start, then period."""
    nothing = F.lit(None).cast(RUN)
    return F.aggregate(runs, nothing, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: runs of 24 words and three periods or more in every whole text of
    ``documents``, of which every tenth is made to repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs).select("doc_id", "runs", _first_of_greatest(F.col("runs")).alias("best"), "collapsed")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
