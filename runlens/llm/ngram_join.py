"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles (words are
split at ASCII white space, A-Z lower-cased).  Two sets of sizes n and m link if
their Jaccard similarity reaches the threshold t; then each shares at least
ceil(t n) tokens with the other.

1. *Classes.*  Tokens in the first part of each set, by hash, are counted over all
   documents; those in more than T sets are *frequent* (T is the least power of two
   for which there are at most ``MOST_FREQUENT``, so they can be broadcast).
   Each set is ordered rare tokens first.  Any such classes give right results;
   they decide how long posting lists are.
2. *Index.*  Rare tokens among the first p = n - ceil(t n) + 1 are indexed singly.  If
   a pair's first common token is frequent, all its common tokens are: for sets whose
   prefix reaches the frequent class, the prefix is extended to p + k - 1 tokens, of
   which a similar pair shares k or more.  Its frequent tokens fall into b = k - 1
   buckets by hash, so one bucket holds two shared tokens: the index takes the 2-token
   combinations inside the buckets, about 3 p of them, not p^2.  b follows the size
   class of n; sets near the upper end of a class are indexed for the next one too.
   Members of a list are counted where its key is; the lists of hot keys lie in parts.
3. *Stars.*  In every list, the largest set is paired with the others.  The sizes and a
   bitmap of the tokens (differing bits bound the symmetric difference from below) leave
   the pairs that can link; these are verified on the whole sets, and the links give
   first components.
4. *Forests.*  Of the longer lists that still span several components, in blocks of
   bounded size dealt over the tasks, each block gives a forest of the pairs that sizes
   and bitmaps leave, fewer pairs than it has members, so a large group of near copies
   is not paired member by member.  They are verified, and joined components
   go round again while that finds links (``ROUNDS`` at most).
5. *The rest.*  Lists that then still span several components are gone through pair by
   pair: short ones by a join, longer ones in the blocks.  Pairs of one component need
   no proof; of the others, those that sizes and bitmaps leave are verified on the
   whole sets.  A pair that shares several lists is given in the one of its least
   shared key, as far as the ``FIRST_KEYS`` least keys of both tell.  No link between
   components can be missed, so the components are exact.

Copies (equal word sequences) are one node from the first step on.  Nodes, words and
shingles are told apart by 64-bit hashes; words and nodes mix a polynomial modulo 2^64
with one modulo a prime, so that no pattern of letters or words collides by structure.

Defined results: null text and text without words have an empty set, link with
nothing and are components of their own; with fewer words than a shingle has, the
whole sequence is the one shingle; repeated rows and repeated ids are members like
any others; a component whose ids are all null has a null id; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import has_at_most, small_side
from .common import release, table, written
from .components import components

LEAST_FREQUENT, MOST_FREQUENT = 1, 4_000_000
#: A key of about ``HOT`` rows or more, by one node of ``PROBE``, is spread over the tasks; broadcast up to ``MOST_HOT`` such keys.
HOT, PROBE, MOST_HOT = 1_000_000, 64, 500_000
#: Node ids that may be broadcast to choose the sets that verification needs (8 bytes each).
MOST_IDS = 4_000_000
#: Lists of up to so many members are paired by a join, longer ones in blocks with bitmaps.
SMALL = 8
#: Members of one side of a block.
BLOCK = 2048
BITS, MOST_BITS = 16, 16_384
#: Forests of the longer lists that are verified before all pairs between components are.
ROUNDS = 4
#: Keys that a member carries to tell in which of its lists a pair is given.
FIRST_KEYS = 64
MEMO = 500_000
#: Bytes of text that are hashed at once (a longer text alone).
CHUNK = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F  # odd, so they have inverses modulo 2^64
_PRIME, _PRIME_BASE = 2**31 - 1, 1_395_628_743
_P31 = np.uint64(_PRIME)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, CHUNK + 1), np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def _ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the ranges, whatever place they stand at."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])
    return (sums[end] - sums[begin]) * _powers(pow(base, -1, 2**64), len(values) + 1)[begin]


def _prime_ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same modulo a prime of 31 bits, from a fixed base: sequences that
    collide modulo 2^64 whatever the base (Thue-Morse patterns) do not collide here."""
    n = len(values)
    if _PRIME not in _POWERS or len(_POWERS[_PRIME]) < 2 * (n + 1):
        _POWERS[_PRIME] = _prime_powers(max(n, CHUNK) + 1)
    powers, inverses = np.split(_POWERS[_PRIME], 2)
    # values stay under 2^31, so sums of fewer than 2^33 of them fit
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values % _P31 * powers[:n] % _P31, dtype=np.uint64)])
    return (sums[end] - sums[begin]) % _P31 * inverses[begin] % _P31


def _prime_powers(n: int) -> np.ndarray:
    """The powers of the base and of its inverse modulo the prime, by doubling."""
    out = []
    for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)):
        p = np.ones(1, dtype=np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), _PRIME)) % _P31])
        out.append(p[:n])
    return np.concatenate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingle hashes of a sequence of word hashes, ascending."""
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = _mixed(out * _MIX + h[i:len(h) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _both(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the ranges from both polynomials and their lengths."""
    first = _ranges(values, begin, end, base) ^ (end - begin).astype(np.uint64) * _MIX
    return _mixed(first ^ _mixed(_prime_ranges(values, begin, end) * _MIX + np.uint64(1)))


def _hashed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts that begin at ``at`` (its last entry is the end), and
    where each text's begin among them."""
    inside = ~_SPACE[raw]
    # one place more, so that texts without bytes do no harm
    before, after = np.zeros(len(raw) + 1, dtype=bool), np.zeros(len(raw) + 1, dtype=bool)
    before[1:], after[:-1] = inside, inside
    before[at], after[at] = False, False  # no word runs on from the text before
    begin = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    h = _both(_LOWER[raw], begin, end, _BASE)
    return h, np.searchsorted(begin, at)


def _hashed_long(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, in pieces that end between words."""
    parts, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not _SPACE[raw[at:end]].any():
            end = min(end + CHUNK, len(raw))  # a word longer than a piece
        if end < len(raw):
            end = at + int(np.flatnonzero(_SPACE[raw[at:end]])[-1]) + 1
        parts.append(_hashed(raw[at:end], np.array([0, end - at]))[0])
        at = end
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts as word hashes, some at a time: the first one's place, all their word
    hashes, where each one's begin (and the last one's end), and each one's node."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        at = offsets[first:last + 1] - offsets[first]
        raw = data[offsets[first]:offsets[last]]
        h, of = _hashed_long(raw) if len(raw) > CHUNK else _hashed(raw, at)
        node = _both(h, of[:-1], of[1:], _WORD_BASE)
        yield first, h, of, _signed(node)
        first = last


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Law:
    """The arithmetic of one threshold, ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.unit = max(2, 200 // (100 - percent))

    def shared(self, n: int) -> int:
        """Tokens that a set of n shares with any set that links with it, at least."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.shared(n) + 1

    def size_class(self, n: int) -> int:
        return 0 if n < self.unit else int(n // self.unit).bit_length()

    def classes(self, n: int) -> list[int]:
        """The size classes that a set of n is indexed for: its own, and the next
        if a set that links with it may be in that."""
        c = self.size_class(n)
        return [c, c + 1] if n * 100 >= self.percent * self.unit * 2**c else [c]

    def buckets(self, c: int) -> int:
        return max(1, 2 ** (c - 1))

    def keys(self, tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Index keys of a set (ascending ``tokens``; ``frequent`` marks), ascending."""
        n = len(tokens)
        p = self.prefix(n)
        rare = tokens[~frequent]
        keys = [_mixed(rare[:p])]
        if len(rare) < p:
            often = tokens[frequent]
            if n == 1:
                keys.append(_mixed(often ^ _MIX))
            else:
                for c in self.classes(n):
                    b = self.buckets(c)
                    part = often[:p + b - len(rare)]
                    by = (part >> np.uint64(7)) % np.uint64(b)
                    for x in range(b):
                        at = np.flatnonzero(by == x)
                        i, j = np.triu_indices(len(at), 1)
                        keys.append(_mixed(part[at[i]] * _MIX + _mixed(part[at[j]]) + np.uint64(c)))
        return np.unique(np.concatenate(keys))


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits of the tokens' hashes; their number follows the set's size."""
    bits = min(MOST_BITS, 1 << max(8, int(BITS * len(tokens) - 1).bit_length()))
    out = np.zeros(bits // 64, dtype=np.uint64)
    at = (_mixed(tokens) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bytes or more, folded to that size."""
    out = np.zeros((len(maps), size // 8), dtype=np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, size // 8), axis=0)
    return out


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _over_sets(docs: DataFrame, text: str, size: int, make, schema: str, wanted=None) -> DataFrame:
    """``make(node, tokens)`` gives columns for the first copy of each text that a task
    meets; ``wanted``: a broadcast of the only nodes that matter, ascending."""
    fields = [f.split() for f in schema.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        arrays = []
        for i, (_, kind) in enumerate(fields):
            if kind in ("long", "int"):
                arrays.append(pa.array(np.concatenate([np.asarray(r[i]) for r in rows]), type=_TYPES[kind]))
            else:
                arrays.append(pa.array([x for r in rows for x in r[i]], type=_TYPES[kind]))
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, h, of, nodes in chunks(batch.column(0)):
                out, room = [], 0
                these = np.flatnonzero(np.diff(of))
                if wanted is not None:
                    these = these[_is_in(nodes[these], wanted.value)]
                for i in these:
                    node = int(nodes[i])
                    if node in seen:
                        continue
                    if len(seen) > MEMO:  # a copy may then be given twice, which the exchange puts right
                        seen.clear()
                    seen.add(node)
                    out.append(make(node, shingles(h[of[i]:of[i + 1]], size)))
                    room += of[i + 1] - of[i]
                    if room > 200_000:
                        yield batch_of(out)
                        out, room = [], 0
                if out:
                    yield batch_of(out)
        batch = h = of = nodes = out = None
        _POWERS.clear()
        release()

    return docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(mapped, schema)


def _frequent(docs: DataFrame, text: str, size: int, law: Law) -> np.ndarray:
    """The frequent tokens, ascending."""

    def early(node: int, tokens: np.ndarray):
        return (_signed(tokens[:3 * law.prefix(len(tokens)) // 2 + 8]),)

    counted = _over_sets(docs, text, size, early, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = written(counted.where(F.col("n") > LEAST_FREQUENT), "token-counts")
    # how many tokens are in more than T sets, by the bits of T: a few dozen rows
    by = {r.b: r.c for r in often.groupBy(F.ceil(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    limit = LEAST_FREQUENT.bit_length() - 1
    while sum(c for b, c in by.items() if b > limit) > MOST_FREQUENT:
        limit += 1
    got = often.where(F.col("n") > (1 << limit)).select("token").toArrow().column("token").to_numpy()
    return np.sort(got.view(np.uint64))


def _is_in(tokens: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(tokens), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, tokens), len(ascending) - 1)
    return ascending[at] == tokens


def _postings(docs: DataFrame, text: str, size: int, law: Law, frequent) -> DataFrame:
    """Lists of two or more: ``key, id, n, members``; ``frequent`` is a broadcast."""

    def indexed(node: int, tokens: np.ndarray):
        keys = law.keys(tokens, _is_in(tokens, frequent.value))
        return _signed(keys), np.full(len(keys), node, dtype=np.int64), np.full(len(keys), len(tokens), dtype=np.int32)

    rows = written(_over_sets(docs, text, size, indexed, "key long, id long, n int"), "entries")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # keys that one node of PROBE shows to be long; which keys they are changes where rows are counted, not what
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    hot = small_side(written(seen.where(F.col("c") * PROBE >= HOT).select("key"), "hot-keys"), MOST_HOT)
    # one exchange, by key; equal rows of copies in several tasks then meet, and members are counted where they are
    cool = rows.join(hot, "key", "left_anti").repartition(parts, "key").distinct()
    cool = cool.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key")))
    # a hot key is spread by its nodes and counted in parts
    spread = written(rows.join(hot, "key", "left_semi").repartition(parts, "key", "id").distinct(), "hot-entries")
    sums = small_side(spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")), MOST_HOT)
    return written(cool.unionByName(spread.join(sums, "key").select(*cool.columns)).where("members > 1"), "postings")


def _chosen(docs: DataFrame, text: str, size: int, ids: DataFrame, make, schema: str) -> DataFrame:
    """``make``'s rows (first column ``id``) for the nodes in ``ids``, one row each."""
    rest = [f.split()[0] for f in schema.split(", ")][1:]
    if has_at_most(ids, MOST_IDS):
        few = np.sort(ids.toArrow().column(0).to_numpy())
        rows = _over_sets(docs, text, size, make, schema, docs.sparkSession.sparkContext.broadcast(few))
    else:
        rows = _over_sets(docs, text, size, make, schema).join(ids, "id", "left_semi")
    return rows.groupBy("id").agg(*[F.first(c).alias(c) for c in rest])


def _sets(docs: DataFrame, text: str, size: int, pairs: DataFrame) -> DataFrame:
    """``id, tokens`` of the pairs' nodes."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    sets = _chosen(docs, text, size, ids, lambda node, tokens: ([node], [_signed(tokens)]), "id long, tokens array<long>")
    return written(sets, "sets")


def _verified(sets: DataFrame, pairs: DataFrame, law: Law) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold."""
    x, y = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(x, "a").join(y, "b").where(
        both * 100 >= (F.size("ta") + F.size("tb") - both) * law.percent).select("a", "b")


def _star_pairs(lists: DataFrame, law: Law) -> DataFrame:
    """Each list's largest set with the others, where the sizes allow a link."""
    centre = lists.groupBy("key").agg(F.max(F.struct("n", "id")).alias("c"))
    p = lists.join(centre, "key").where(F.col("id") != F.col("c.id")).where(F.col("n") * 100 >= F.col("c.n") * law.percent)
    return p.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()


def _few_bits(differing: np.ndarray, total: np.ndarray, law: Law) -> np.ndarray:
    """Whether sets of ``total`` tokens together may link with so many bits differing."""
    return differing * (100 + law.percent) <= total * (100 - law.percent)


def _partners(run: dict[str, np.ndarray], maps: list[bytes], across: bool, law: Law) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per row of a block (by ascending ``n``), the later rows that may link with it and the
    bits that differ; ``across``: only between the block's two sides."""
    n = run["n"].astype(np.int64)
    sizes = np.array([len(m) for m in maps])
    folded: dict[int, tuple[int, np.ndarray]] = {}
    for size in np.unique(sizes):
        from_row = int(np.searchsorted(sizes, size))  # sizes follow n, so they ascend
        folded[int(size)] = (from_row, _folded(maps[from_row:], int(size)))
    for i in range(len(n) - 1):
        # partners of row i: not smaller, and at most n / t
        end = int(np.searchsorted(n, n[i] * 100 // law.percent, side="right"))
        j = np.arange(i + 1, end)
        j = j[run["comp"][j] != run["comp"][i]]
        if across:
            j = j[run["side"][j] != run["side"][i]]
        if not len(j):
            continue
        start, rows = folded[int(sizes[i])]
        differing = np.bitwise_count(rows[j - start] ^ rows[i - start]).sum(axis=1, dtype=np.int64)
        few = _few_bits(differing, n[i] + n[j], law)
        yield i, j[few], differing[few]


def _by_size(run: dict[str, np.ndarray], *others: list) -> tuple:
    by = np.lexsort((run["id"], run["n"]))
    return {k: v[by] for k, v in run.items()}, *([o[i] for i in by] for o in others)


def _pairs_of(run: dict[str, np.ndarray], maps: list[bytes], firsts: list[np.ndarray], across: bool, law: Law) -> tuple[list, list]:
    """The pairs of one block that may link and are given in its list; ``across``: only
    between the block's two sides."""
    run, maps, firsts = _by_size(run, maps, firsts)
    key = run["key"][0]
    out_a, out_b = [], []
    for i, j, _ in _partners(run, maps, across, law):
        for k in j:
            shared = np.intersect1d(firsts[i], firsts[k], assume_unique=True)
            if not len(shared) or shared[0] == key:
                out_a.append(int(min(run["id"][i], run["id"][k])))
                out_b.append(int(max(run["id"][i], run["id"][k])))
    return out_a, out_b


def _forest_of(run: dict[str, np.ndarray], maps: list[bytes], across: bool, law: Law, round_: int) -> tuple[list, list]:
    """A forest of the block's pairs that may link.  The first round's is over the members and
    touches each that has such a pair; later ones are over components and take other pairs."""
    run, maps = _by_size(run, maps)
    _, group = np.unique(run["comp" if round_ else "id"], return_inverse=True)
    alike = [set() for _ in range(int(group.max()) + 1)]  # joined here so far: one set object each
    for g, x in enumerate(alike):
        x.add(g)
    out_a, out_b = [], []
    for i, j, differing in _partners(run, maps, across, law):
        # nearest first; a later round begins at another place
        by = np.roll(np.argsort(differing, kind="stable"), -(round_ * len(j) // ROUNDS)) if len(j) else j
        for k in j[by]:
            mine, other = alike[group[i]], alike[group[k]]
            if mine is not other:
                out_a.append(int(min(run["id"][i], run["id"][k])))
                out_b.append(int(max(run["id"][i], run["id"][k])))
                small, large = sorted((mine, other), key=len)
                large |= small
                for g in small:
                    alike[g] = large
    return out_a, out_b


def _near(pairs: DataFrame, maps: DataFrame, law: Law) -> DataFrame:
    """The pairs ``a, b`` whose bitmaps let them link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            differing = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                both = _folded([p, q], min(len(p), len(q)))
                differing[i] = np.bitwise_count(both[0] ^ both[1]).sum()
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            yield batch.filter(pa.array(_few_bits(differing, total, law))).select(["a", "b"])
        batch = x = y = None
        release()

    for c in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")), c)
    return pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(near, "a long, b long")


def _short_pairs(lists: DataFrame, law: Law) -> DataFrame:
    """Pairs of different components and fitting sizes from short lists."""
    x, y = (lists.select("key", F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("comp").alias(f"comp{c}")) for c in ("a", "b"))
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * law.percent
    return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("compa") != F.col("compb")) & fit).select("a", "b").distinct()


def _long_pairs(lists: DataFrame, maps: DataFrame, law: Law, forest: int | None = None) -> DataFrame:
    """Pairs of different components that may link from long lists, in blocks; only a forest
    of each block where ``forest``, the round, is given."""
    spark = lists.sparkSession
    dealt = lists.join(maps.drop("n"), "id").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n", "comp",
        (F.col("own") > F.col("other")).cast("int").alias("side"), "bits", "firsts")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "x", "y").sortWithinPartitions("key", "x", "y")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held)
            run = {c: rows.column(c).to_numpy() for c in ("key", "id", "n", "comp", "side")}
            if (run["comp"] == run["comp"][0]).all():
                return None
            bits, across = rows.column("bits").to_pylist(), last[1] != last[2]
            if forest is not None:
                a, b = _forest_of(run, bits, across, law, forest)
            else:
                a, b = _pairs_of(run, bits, [np.array(f, dtype=np.int64) for f in rows.column("firsts").to_pylist()], across, law)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(marks[lo])
                if held and this != last:
                    if (got := close()) is not None:
                        yield got
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = this
        if held and (got := close()) is not None:
            yield got
        held = batch = got = None
        release()

    return dealt.mapInArrow(joined, "a long, b long")


def nodes(docs: DataFrame, size: int, carry: list[Column], schema: str, text: str = "text") -> DataFrame:
    """``carry`` (typed by ``schema``) with ``id`` (null without words) and ``n_shingles``, row by row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for first, h, of, found in chunks(b.column(b.num_columns - 1)):
                ids[first:first + len(found)] = found
                n[first:first + len(found)] = [len(shingles(h[i:j], size)) for i, j in zip(of[:-1], of[1:], strict=True)]
            columns = [*b.columns[:-1], pa.array(ids, mask=n == 0), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "id", "n_shingles"])
        b = columns = h = of = found = None
        _POWERS.clear()
        release()

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(rows, f"{schema}, id long, n_shingles long")


def labels(docs: DataFrame, size: int, percent: int, text: str = "text") -> DataFrame:
    """``id, label`` of the nodes that link with another one."""
    law = Law(percent)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, size, law))
    lists = _postings(docs, text, size, law, frequent)

    def described(node: int, tokens: np.ndarray):
        keys = _signed(law.keys(tokens, _is_in(tokens, frequent.value)))
        return [node], [bitmap(tokens)], [len(tokens)], [np.sort(keys)[:FIRST_KEYS]]

    maps = written(_chosen(docs, text, size, lists.select("id").distinct(), described, "id long, bits binary, n int, firsts array<long>"), "bitmaps")
    stars = written(_near(_star_pairs(lists, law), maps, law), "star-pairs")
    found = written(_verified(_sets(docs, text, size, stars), stars, law), "star-links")
    left = written(_open(lists, found), "open-lists")
    short = _near(_short_pairs(left.where(F.col("members") <= SMALL), law).join(stars, ["a", "b"], "left_anti"), maps, law)
    short = written(short, "short-pairs")
    # every node that may link in a longer list is in the first forest, so the others go
    long = written(_long_pairs(left.where(F.col("members") > SMALL), maps, law, 0).distinct(), "forest")
    sets = _sets(docs, text, size, short.unionByName(long))
    touched = long.select(F.col("a").alias("id")).unionByName(long.select(F.col("b").alias("id"))).distinct()
    lists = written(left.where(F.col("members") > SMALL).drop("comp").join(touched, "id", "left_semi"), "open-lists")
    more, tried = written(_verified(sets, short.unionByName(long).distinct(), law), "links"), stars.unionByName(short).unionByName(long)
    found = found.unionByName(more)
    for k in range(1, ROUNDS):
        if more.isEmpty():
            break
        left = written(_open(lists, found), "open-lists")
        lists = left.drop("comp")
        here = _long_pairs(left, maps, law, k).distinct().join(tried, ["a", "b"], "left_anti")
        here = written(here, "forest")
        more = written(_verified(sets, here, law), "links")
        found, tried = found.unionByName(more), tried.unionByName(here)
    rest = _long_pairs(_open(lists, found), maps, law).distinct().join(tried, ["a", "b"], "left_anti")
    return components(found.unionByName(_verified(sets, written(rest, "rest-pairs"), law)), "a", "b")


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with ``comp``, each member's component by the links so far."""
    known = components(links, "a", "b").withColumnRenamed("label", "comp")
    return lists.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _open(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists that span several components, with ``comp``."""
    labelled = _labelled(lists, links)
    several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return labelled.join(several, "key", "left_semi")


def with_components(docs: DataFrame, size: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``key, n_shingles, component_id``, and ``id``, its node."""
    kind = docs.schema[key].dataType.simpleString()
    n = written(nodes(docs, size, [F.col(key).alias("_key")], f"_key {kind}", text), "nodes")
    own = n.join(labels(docs, size, percent, text), "id", "left").withColumn("comp", F.coalesce("label", "id"))
    least = own.where("comp IS NOT NULL").groupBy("comp").agg(F.min("_key").alias("component_id"))
    linked = own.join(least, "comp", "left")
    return linked.select(
        F.col("_key").alias(key), "n_shingles",
        F.when(F.col("comp").isNull(), F.col("_key")).otherwise(F.col("component_id")).alias("component_id"), "id", "comp")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the least key (nulls last, then by
    node); documents without words stay."""
    found = with_components(docs, size, percent, text, key).where("comp IS NOT NULL")
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("_keep"), F.col("id").alias("_node"))
    chosen = found.groupBy("comp").agg(F.min(order).alias("c")).select(F.col("c._keep").alias("_keep"), F.col("c._node").alias("_node"))

    @F.pandas_udf(T.LongType())
    def node(t: pd.Series) -> pd.Series:
        got = [(found, np.diff(of) > 0) for _, _, of, found in chunks(pa.array(t, type=pa.string()))]
        ids, has = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i in (0, 1))
        return pd.Series(pd.arrays.IntegerArray(ids, ~has.astype(bool)))

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(whole, F.col(key).alias("_key"), node(F.col(text)).alias("_id"))
    kept = marked.join(chosen, (F.col("_id") == F.col("_node")) & F.col("_key").eqNullSafe(F.col("_keep")), "left_semi")
    # rows with one key and one text that are there more than once
    kept = kept.dropDuplicates(["_key", "_id"])
    return kept.unionByName(marked.where("_id IS NULL")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: three-word shingles and a similarity of 0.9 over every whole text of ``documents``."""
    return with_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
