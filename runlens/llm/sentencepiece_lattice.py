"""SentencePiece encoding and decoding over a relational lattice.

``lattice`` explodes the substrings of bounded length of distinct words and equi-joins
them to the piece table; the edges are grouped by word and ``fold`` turns each
group into pieces with Spark's higher-order ``aggregate``:

* unigram models: Viterbi, the best-scored path to each place of the word;
* byte-pair models (the installed one): a best-sum path is not what the library
  gives, so the fold takes the edges in the model's merge order instead: while an edge
  spans exactly two neighbouring parts, the best-scored one (the leftmost of
  equals) joins them.  One pass over the edges in that order does it, unless the word
  has an edge that is ``Pieces.late``; then each step looks for the first that is ready.

Characters without a piece become byte pieces.  A word is a run that no piece
crosses the ends of: space marks with the letters, or the other characters, that
follow them (with a model whose pieces mix the two, all up to the next space mark).

Every distinct word goes through the lattice.  ``encode`` counts the words of all texts and
folds those that occur most often first (as many count classes as fit in ``MOST_WORDS``); their
encodings are broadcast.  The other words, a tail that grows with the corpus, are named by the
tasks that meet them, with the bucket of rows they stand in; each is folded once, and its pieces
go to its buckets, where the compressed texts go too.  Tasks put whole texts together from both;
no occurrence of a frequent word is exchanged by itself, each text is once.  Words of at most
``LONGEST_WORD`` characters are folded by ``aggregate``, longer ones by a heap over the same
grouped edges.

Defined results: null and empty texts have no pieces and decode to the empty text;
repeated rows are encoded row by row; an empty table gives an empty table.  Extra
columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, release, table, written

MARK = "▁"
MOST_WORDS = 200_000
#: Distinct runs that a task counts at a time; those met once go when there are more.
MOST_RUNS = 200_000
#: (bucket, word) pairs that a task gathers before it gives them on.
MOST_PAIRS = 100_000
#: Characters of text to a bucket of rows, about, and the least buckets to a partition.
BUCKET_CHARS, LEAST_BUCKETS = 1 << 20, 4
#: Longer words are exploded chunk by chunk and their edges folded by a heap; the cuts of
#: shorter ones are the bits of a long.
LONGEST_WORD = 64
#: An edge of a byte-pair model is a long: rank, first character, size, late or not.
RANK_BIT, AT_BIT, SIZE_BIT = 44, 13, 1
_COARSE = re.compile(" *[^ ]+| +")
#: Letters of the basic plane; the class of a pattern is searched much faster without others.
_LETTERS = [c for c in map(chr, range(1 << 16)) if c.isalnum() and re.match(r"[^\W\d_]", c)]
_LETTER = re.compile(f"[{''.join(_LETTERS)}]")
#: So many odd letters are kept apart; a model with more of them is cut at space marks only.
FEW = 32
UNREACHED = -1e18
_WORKER: dict = {}


class Pieces:
    """The piece table of a model and the fold of one word."""

    def __init__(self, entries: list[tuple[str, int, float]], bytes_: dict[int, int], viterbi: bool, names: list[bytes], unknown: int = 0):
        self.entries, self.viterbi, self.names, self.unknown = entries, viterbi, names, unknown
        self.edges = {p: (score, i) for p, i, score in entries}
        self.ranks = {p: -score for p, _, score in entries}
        self.four = {p: i.to_bytes(4, "little") for p, i, _ in entries}
        self.bytes = bytes_
        self.longest = max((len(p) for p, _, _ in entries), default=1)
        pairs = {(a, b) for p, _, _ in entries for a, b in zip(p, p[1:], strict=False)}
        if any(b == MARK != a for a, b in pairs):
            raise ValueError("pieces that run across words are not supported")
        # letters that some piece joins with another character count as other characters
        joined = {x for a, b in pairs if a != MARK and bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for x in (a, b) if _LETTER.match(x)}
        torn = any((a in joined) != (b in joined) for a, b in pairs if _LETTER.match(a) and _LETTER.match(b))
        if len(joined) <= FEW and not torn:
            letters = "".join(c for c in _LETTERS if c not in joined)
            self.words = re.compile(f" *(?:[{letters}]+|[^{letters} ]+)| +")
        else:
            self.words = _COARSE
        self.late = set() if viterbi else {p for p in self.edges if len(p) > 2 and self._is_late(p)}
        if self.longest >= 1 << (AT_BIT - SIZE_BIT) or len(entries) >= 1 << (63 - RANK_BIT):
            raise ValueError("models with so many or so long pieces are not supported")

    def split(self, text: str | None) -> list[str]:
        return [w.replace(" ", MARK) for w in self.spaced(text)]

    def spaced(self, text: str | None) -> list[str]:
        """The text's words with spaces for space marks: plain letters take half the room without a mark."""
        return self.words.findall(" " + text.replace(MARK, " ")) if text else []

    def ids_of(self, part: str) -> list[int]:
        hit = self.edges.get(part)
        if hit:
            return [hit[1]]
        return [self.bytes.get(b, self.unknown) for b in part.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word by itself, without Spark."""
        return [i for p in self.parts(word) for i in self.ids_of(p)]

    def parts(self, word: str) -> list[str]:
        return self._best_path(word) if self.viterbi else self._merged(word)

    def _best_path(self, word: str) -> list[str]:
        best = [(0.0, 0)] + [(UNREACHED, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                hit = self.edges.get(word[start:end])
                score = best[start][0] + (hit[0] if hit else UNREACHED / 1e6 if end - start == 1 else 2 * UNREACHED)
                if score > best[end][0]:
                    best[end] = (score, start)
        cuts = [len(word)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts.reverse()
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merged(self, word: str) -> list[str]:
        """The best-scored neighbours are joined first, the leftmost of equals."""
        if len(word) > LONGEST_WORD:
            return self._merged_long(word)
        parts, rank = list(word), self.ranks.get
        ranks = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < np.inf:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], np.inf)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], np.inf)
        return parts

    def _is_late(self, piece: str) -> bool:
        """Whether the piece by itself is made after a merge that scores no better than it.

        What is merged inside a piece's span, before a merge crosses the span's ends, is what is
        merged in the piece by itself.  So only a late piece can become ready, in any word, after
        its turn in the order of the edges, and words without one need one pass over that order."""
        parts, ranks, worst = list(piece), self.ranks, -np.inf
        while len(parts) > 1:
            at = [ranks.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            if (best := min(at)) == np.inf:
                return False
            i = at.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                return worst >= best
            worst = max(worst, best)
        return False

    def codes(self) -> list[tuple[str, int]]:
        """The pieces with what is the same in all edges that are this piece."""
        rank = {score: i for i, score in enumerate(sorted({s for _, _, s in self.entries}, reverse=True))}
        return [(p, rank[s] << RANK_BIT | len(p) << SIZE_BIT | (p in self.late)) for p, _, s in self.entries]

    def _merged_long(self, word: str) -> list[str]:
        """The same over a heap, for words of any length."""
        cuts = merged_cuts(len(word), lambda a, b: self.edges.get(word[a:b], (None,))[0] if b - a <= self.longest else None)
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def packed(self, parts: list[str]) -> bytes:
        """The parts' ids as little-endian 32-bit integers."""
        four = self.four
        return b"".join([four.get(p) or b"".join(i.to_bytes(4, "little") for i in self.ids_of(p)) for p in parts])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(itemgetter(*ids)(self.names) if len(ids) > 1 else map(self.names.__getitem__, ids))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]

    def decode_all(self, packed: list[bytes]) -> list[str]:
        """The same for many texts' ids at once, given as little-endian 32-bit integers."""
        ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        if not len(ids):
            return [""] * len(packed)
        taken = pa.array(self.names, pa.large_binary()).take(ids)
        _, starts, raw = taken.buffers()
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])])
        ends = np.frombuffer(starts, dtype=np.int64)[ends].tolist()
        raw = memoryview(raw)
        return [str(raw[a:b], "utf-8", "replace").replace(MARK, " ")[1:] for a, b in zip(ends, ends[1:], strict=False)]


def merged_cuts(n: int, score: Callable[[int, int], float | None]) -> list[int]:
    """Cuts of ``n`` characters after all merges; ``score`` gives that of an edge, if there is one."""
    before = list(range(-1, n - 1))  # neighbouring parts, by where they begin
    end = list(range(1, n + 1))
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            hit = score(a, end[b])
            if hit is not None:
                heapq.heappush(heap, (-hit, a, b, end[b]))

    for a in range(n):
        offer(a)
    alive = [True] * n
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not (alive[a] and alive[b] and end[a] == b and end[b] == e):
            continue
        end[a], alive[b] = e, False
        if e < n:
            before[e] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [a for a in range(n) if alive[a]] + [n]


def best_cuts(n: int, edges: dict[tuple[int, int], float]) -> list[int]:
    """Cuts of ``n`` characters on the best-scored path; a character without a piece costs much."""
    into: dict[int, list[tuple[int, float]]] = {}
    for (a, b), score in edges.items():
        into.setdefault(b, []).append((a, score))
    best = [(0.0, 0)]
    for end in range(1, n + 1):
        ways = [*into.get(end, []), (end - 1, UNREACHED / 1e6)]
        best.append(max(((best[a][0] + score, a) for a, score in ways), key=lambda x: (x[0], -x[1])))
    cuts = [n]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    return cuts[::-1]


def load(path: str) -> Pieces:
    """The piece table of a model file, on the driver."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("models that rewrite texts are not supported")
    sp = SentencePieceProcessor(model_file=path)
    entries, bytes_, names = [], {}, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
            names.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            names.append(b"" if sp.is_control(i) else " ⁇ ".encode())
        else:
            entries.append((p, i, sp.get_score(i)))
            names.append(p.encode())
    return Pieces(entries, bytes_, spec.trainer_spec.model_type == 1, names, sp.unk_id())


def keyed(words: DataFrame) -> DataFrame:
    """``words`` dealt by a ``key``: the word itself, or the digest of a long ``word``; a short one is left out."""
    is_long = F.length("word") > LONGEST_WORD
    key = F.when(is_long, F.concat(F.lit(" "), F.sha2("word", 256))).otherwise(F.col("word"))  # no word has a space
    rest = [c for c in words.columns if c != "word"]
    return words.select(key.alias("key"), F.when(is_long, F.col("word")).alias("word"), *rest).repartition(partitions(words), "key")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``keyed`` rows of distinct words with their ``edges``, the substrings that are pieces."""
    import pandas as pd  # on the driver only: a worker is the smaller without

    spark = words.sparkSession
    # as many rows as the model has pieces
    if pieces.viterbi:
        table = spark.createDataFrame(pd.DataFrame([(p, s) for p, _, s in pieces.entries], columns=["piece", "score"]), "piece string, score double")
        edge = F.struct("a", (F.col("a") + F.col("size")).alias("b"), "score")
    else:
        table = spark.createDataFrame(pd.DataFrame(pieces.codes(), columns=["piece", "score"]), "piece string, score long")
        edge = F.col("score").bitwiseOR(F.shiftleft(F.col("a").cast("long"), AT_BIT))
    # a long word is cut into chunks that overlap by a piece, and only its first substring carries the row
    word = F.coalesce("word", "key")
    chunks = words.select("key", F.struct(*(c for c in words.columns if c != "key")).alias("row"), word.alias("whole"), F.explode(
        F.sequence(F.lit(0), F.length(word) - 1, F.lit(LONGEST_WORD))).alias("at"))
    chunks = chunks.select("key", "at", F.when(F.col("at") == 0, F.col("row")).alias("row"), F.substring(
        "whole", F.col("at") + 1, F.lit(LONGEST_WORD + pieces.longest - 1)).alias("chunk"))
    starts = chunks.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("chunk")))).alias("start"))
    starts = starts.withColumn("row", F.when(F.col("start") == 1, F.col("row"))).withColumn("left", F.length("chunk") - F.col("start") + 1)
    # no merge gives a single character; the first one carries the row
    least = F.when(F.lit(pieces.viterbi) | (F.col("start") == 1), 1).otherwise(2)
    spans = starts.where(F.col("left") >= least).select("*", F.explode(F.sequence(least, F.least(F.lit(max(2, pieces.longest)), "left"))).alias("size"))
    cut = spans.select(
        "key", F.when(F.col("size") == 1, F.col("row")).alias("row"), (F.col("at") + F.col("start") - 1).alias("a"), "size",
        F.substring("chunk", F.col("start"), F.col("size")).alias("piece"))
    # a join by one long is cheaper than by strings; other strings of the same hash are no edges
    cut = cut.withColumn("hash", F.xxhash64("piece"))
    table = table.select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("found"), "score")
    is_edge = (F.col("piece") == F.col("found")) & (F.lit(pieces.viterbi) | (F.col("size") > 1))
    rest = [f"row.{c}" for c in words.columns if c not in ("key", "word")]
    # a word without any edge is all bytes
    return cut.join(F.broadcast(table), "hash", "left").where(is_edge | F.col("row").isNotNull()).groupBy("key").agg(
        F.first("row", ignorenulls=True).alias("row"), F.collect_list(F.when(is_edge, edge)).alias("edges")).select(
            F.coalesce("row.word", "key").alias("word"), *rest, "edges")


def _merges(word: Column, edges: Column) -> Column:
    """Cuts of the word after all merges, by the model's order."""
    at = lambda e: F.shiftright(e, AT_BIT).bitwiseAND(F.lit((1 << (RANK_BIT - AT_BIT)) - 1)).cast("int")
    size = lambda e: F.shiftright(e, SIZE_BIT).bitwiseAND(F.lit((1 << (AT_BIT - SIZE_BIT)) - 1)).cast("int")
    shifted = lambda value, n: F.call_function("shiftleft", F.lit(value).cast("long"), n)
    bit = lambda i: shifted(1, i)
    bits = lambda n, start: F.call_function("shiftleft", F.bitwise_not(shifted(-1, n)), start)
    # the cut before character i is bit i - 1; that before character 0 is bit 63 (shifts go by their last six bits), which no edge spans
    spans = F.transform(F.sort_array(edges), lambda e: F.struct(
        bits(size(e) - 1, at(e)).alias("inner"), bit(at(e) - 1).bitwiseOR(bit(at(e) + size(e) - 1)).alias("ends")))
    ready = lambda cuts, e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)
    joined = lambda cuts, e: cuts.bitwiseAND(F.bitwise_not(e["inner"]))
    all_cuts = F.lit(-1).cast("long")
    in_order = F.aggregate(spans, all_cuts, lambda cuts, e: F.when(ready(cuts, e), joined(cuts, e)).otherwise(cuts))

    def step(spans: Column) -> Callable[[Column, Column], Column]:
        return lambda cuts, _: let(F.get(F.filter(spans, lambda e: ready(cuts, e)), F.lit(0)), lambda e: F.when(e.isNull(), cuts).otherwise(joined(cuts, e)))

    one_by_one = let(spans, lambda s: F.aggregate(F.sequence(F.lit(1), F.length(word)), all_cuts, step(s)))
    is_late = F.exists(edges, lambda e: e.bitwiseAND(F.lit(1).cast("long")) == 1)
    return let(F.when(is_late, one_by_one).otherwise(in_order), lambda cuts: F.filter(
        F.sequence(F.lit(0), F.length(word)), lambda i: (i == 0) | (i == F.length(word)) | (cuts.bitwiseAND(bit(i - 1)) != 0)))


def _viterbi(word: Column, edges: Column) -> Column:
    """Cuts of the word on its best-scored path; a character without a piece costs much."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts")))

    def step(places: Column, end: Column) -> Column:
        into = F.concat(F.filter(edges, lambda e: e["b"] == end).getField("a"), F.array(end - 1))
        scores = F.concat(F.filter(edges, lambda e: e["b"] == end).getField("score"), F.array(F.lit(UNREACHED / 1e6)))

        def reached(a: Column, i: Column) -> Column:
            return F.struct((F.get(places, a)["score"] + F.get(scores, i)).alias("score"), F.concat(F.get(places, a)["cuts"], F.array(end)).alias("cuts"))

        return F.concat(places, F.array(F.array_max(F.transform(into, reached))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step, lambda p: F.element_at(p, -1)["cuts"])


def heap_cuts(n: int, edges: list, viterbi: bool) -> list[int]:
    """Cuts of a long word from its grouped edges."""
    if viterbi:
        return best_cuts(n, {(e["a"], e["b"]): e["score"] for e in edges})
    codes = np.asarray(edges, dtype=np.int64)
    at, size = codes >> AT_BIT & (1 << (RANK_BIT - AT_BIT)) - 1, codes >> SIZE_BIT & (1 << (AT_BIT - SIZE_BIT)) - 1
    scores = dict(zip(zip(at.tolist(), (at + size).tolist(), strict=True), (-(codes >> RANK_BIT)).tolist(), strict=True))
    return merged_cuts(n, lambda a, b: scores.get((a, b)))


def fold_short(grouped: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows with their words' ``parts``, from the grouped edges; a long word keeps its ``edges`` and has no parts."""
    long = F.length("word") > LONGEST_WORD
    cuts = (_viterbi if pieces.viterbi else _merges)(F.col("word"), F.col("edges"))
    parts = let(cuts, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: F.substring(F.col("word"), a + 1, F.get(c, i + 1) - a)))
    return grouped.withColumn("parts", F.when(~long, parts)).withColumn("edges", F.when(long, F.col("edges")))


def fold(grouped: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows with their words' ``parts``, from the grouped edges."""
    viterbi = pieces.viterbi

    @F.arrow_udf("array<string>")
    def over_heap(words: pa.Array, edges: pa.Array) -> pa.Array:
        def parts(w, found):
            cuts = heap_cuts(len(w), found, viterbi)
            return [w[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

        return pa.array([None if w is None else parts(w, e) for w, e in zip(words.to_pylist(), edges.to_pylist(), strict=True)], pa.list_(pa.string()))

    folded = fold_short(grouped, pieces)
    of_long = over_heap(F.when(F.col("parts").isNull(), F.col("word")), F.col("edges"))
    return folded.withColumn("parts", F.coalesce("parts", of_long)).drop("edges")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows of distinct ``word`` with their ``parts``."""
    return fold(lattice(keyed(words), pieces), pieces)


def word_counts(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``word, n``: how often words occur, by tasks that leave out a run between spaces that they
    meet but once, or once among ``MOST_RUNS`` distinct ones; and the texts' characters under ''.

    The counts only choose the words that are folded first, not what becomes of any word."""
    shipped = docs.sparkSession.sparkContext.broadcast(pieces.words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, met, n = 0, [], 0

        def summed() -> pa.Table:
            runs = pa.concat_tables(met).group_by("run", use_threads=False).aggregate([("n", "sum")]).rename_columns(["run", "n"])
            met.clear()
            return runs

        def by_words(runs: pa.Table) -> pa.RecordBatch:
            runs = runs.filter(pc.and_(pc.greater(runs["n"], 1), pc.not_equal(runs["run"], ""))).combine_chunks()
            words = pa.array(shipped.value.findall("".join([" " + r for r in runs["run"].to_pylist()])), pa.string())
            of_run = np.cumsum(pc.starts_with(words, " ").to_numpy(zero_copy_only=False)) - 1
            met_in = pa.table({"word": words, "n": runs["n"].take(pa.array(of_run, pa.int64()))})
            n_of = met_in.group_by("word", use_threads=False).aggregate([("n", "sum")]).sort_by("word").combine_chunks()  # neighbours that begin alike take less room
            return pa.RecordBatch.from_pydict({"word": pc.replace_substring(n_of["word"], " ", MARK).combine_chunks(), "n": n_of["n_sum"].combine_chunks()})

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                texts = whole.column(0).slice(at, 500)
                chars += pc.sum(pc.utf8_length(texts)).as_py() or 0
                found = pc.value_counts(pc.list_flatten(pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")))
                met.append(pa.table({"run": found.field("values"), "n": found.field("counts")}))
                n += len(found)
                if n > 2 * MOST_RUNS:
                    runs = summed()
                    if len(runs) > MOST_RUNS:
                        often = runs.filter(pc.greater(runs["n"], 1))
                        if 2 * len(often) > MOST_RUNS:
                            yield by_words(often)
                            often = often.slice(0, 0)
                        runs = often
                    met.append(runs)
                    n = len(runs)
        if met:
            yield by_words(summed())
        yield pa.RecordBatch.from_pydict({"word": pa.array([""], pa.string()), "n": pa.array([chars], pa.int64())})
        whole = texts = found = runs = often = None
        release()

    return written(docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def frequent_words(counts: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The words that occur most often, with ``n``, whole count classes up to ``most`` words; one of more
    than ``LONGEST_WORD`` characters counts as several."""
    counts = counts.where("word <> ''")
    # classes of counts, eight to an octave: a few hundred rows
    octave = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r.o: r.c for r in counts.groupBy(octave.alias("o")).agg(F.sum(F.ceil(F.length("word") / LONGEST_WORD)).alias("c")).collect()}
    total, least = 0, None
    for o in sorted(sizes, reverse=True):
        if total + sizes[o] > most:
            break
        total, least = total + sizes[o], o
    few = F.lit(False) if least is None else octave >= least
    return counts.where(few)


class Known(dict):
    """Encodings of words, with spaces for space marks: of frequent ones and of those that were learnt beside them."""

    pieces: Pieces | None = None
    learnt: dict[str, bytes] | None = None

    def __missing__(self, word: str) -> bytes:
        return self.pieces.packed(self.pieces.parts(word.replace(" ", MARK))) if self.learnt is None else self.learnt[word]


class Coder:
    """What a worker needs: the pieces and the table of frequent words, which is not copied."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes]):
        self.pieces, self.known = pieces, known if isinstance(known, Known) else Known(known)
        self.known.pieces = pieces

    def forget(self) -> None:
        self.known.learnt = None

    def rare(self, text: str | None) -> list[str]:
        """The text's words that are not in the table, with spaces for space marks."""
        known = self.known
        if not text:
            return []
        if "  " in text or MARK in text or "\0" in text or text[0] == " " or text[-1] == " ":
            words = self.pieces.spaced(text)
        else:  # each run is preceded by one space, which begins a word; most runs are known words
            runs = set((" " + text.replace(" ", "\0 ")).split("\0"))
            words = self.pieces.words.findall("".join([r for r in runs if r not in known]))
        return [w for w in set(words) if w not in known]

    def learn(self, tail: str = "") -> None:
        """Takes folded words that are not in the table, two spaces between words, one between
        parts, beside those learnt before; none: in their place."""
        if not tail:
            self.known.learnt = {}
            return
        learnt, packed = self.known.learnt, self.pieces.packed
        for w in tail.split("  "):
            learnt[w.replace(" ", "").replace(MARK, " ")] = packed(w.split(" "))

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian 32-bit integers; words that are not in the table must
        have been learnt, or if ``learn`` was never called are encoded one by one."""
        return b"".join(map(self.known.__getitem__, self.pieces.spaced(text)))


def encode(docs: DataFrame, pieces: Pieces, carry: list[Column], schema: str, text: str = "text", most: int = MOST_WORDS, with_ids: bool = True) -> DataFrame:
    """The ``carry`` columns (typed by ``schema``) with ``ids`` (unless left out), ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian 32-bit integers) and ``decoded_ok``."""
    spark = docs.sparkSession
    counts = word_counts(docs, pieces, text)
    # at most ``most`` words; the most frequent ones first, so that they lie close together in memory
    parts = encode_words(frequent_words(counts, most), pieces).toArrow().sort_by([("n", "descending")])
    known = Known({w.replace(MARK, " "): pieces.packed(ps) for w, ps in zip(parts.column("word").to_pylist(), parts.column("parts").to_pylist(), strict=True)})
    shipped, version = spark.sparkContext.broadcast((pieces, known)), uuid4().hex
    chars = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    buckets = LEAST_BUCKETS * partitions(docs) + chars // BUCKET_CHARS

    def coder_of_worker() -> Coder:
        if version not in _WORKER:
            _WORKER.clear()
            _WORKER[version] = Coder(*shipped.value)
        return _WORKER[version]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, found, n = coder_of_worker(), defaultdict(set), 0

        def named() -> pa.RecordBatch:
            words = pa.array(list(chain.from_iterable(found.values())), pa.string())
            of = pa.array(np.repeat(np.array(list(found), dtype=np.int32), [len(x) for x in found.values()]))
            found.clear()
            order = pc.sort_indices(words)  # neighbours that begin alike take less room
            return pa.RecordBatch.from_arrays([pc.replace_substring(words.take(order), " ", MARK), of.take(order)], names=["word", "bucket"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                for bucket, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = found[bucket]
                    n -= len(words)
                    words.update(coder.rare(t))
                    n += len(words)
                if n > MOST_PAIRS:
                    yield named()
                    n = 0
        yield named()
        whole = b = words = None
        coder.forget()
        release()

    # a row's bucket hangs on its values, so every reading of the table gives the same
    rows = docs.select(*carry, F.col(text).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]
    values = (F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString())
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int"))
    tail = keyed(dealt.select("_bucket", "_text").mapInArrow(rare, "word string, bucket int")).groupBy("key").agg(
        F.first("word").alias("word"), F.collect_list("bucket").alias("buckets"))

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            t = pa.concat_tables(gathered).combine_chunks()
            gathered.clear()
            to = pc.list_flatten(t["buckets"]).to_numpy()
            order = np.argsort(to, kind="stable")
            words = t["word"].take(pc.list_parent_indices(t["buckets"]).take(pa.array(order))).combine_chunks()
            found, starts = np.unique(to[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(to)), pa.int32()), words)
            return pa.RecordBatch.from_arrays([pc.binary_join(lists, "  "), pa.array(found, pa.int32())], names=["_tail", "_bucket"])

        def parts(word: str, edges: list) -> str:
            cuts = heap_cuts(len(word), edges, viterbi)
            return " ".join([word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])

        n = 0
        for whole in batches:
            words, long = whole["parts"], whole["edges"].is_valid()
            if whole["edges"].null_count < len(whole):
                of_long = [parts(w, e) for w, e in zip(whole["word"].filter(long).to_pylist(), whole["edges"].filter(long).to_pylist(), strict=True)]
                words = pc.replace_with_mask(words, long, pa.array(of_long, words.type))
            gathered.append(pa.table({"buckets": whole["buckets"], "word": words}))
            n += len(pc.list_flatten(whole["buckets"]))
            if n > MOST_PAIRS:
                yield joined()
                n = 0
        if n:
            yield joined()
        whole = words = long = None
        release()

    # words and parts have no spaces; the worker that deals the words folds the long ones too, no other worker stands beside it
    viterbi, long = pieces.viterbi, F.col("edges").isNotNull()
    folded = fold_short(lattice(tail, pieces), pieces).select("buckets", F.when(long, F.col("word")).alias("word"), F.array_join("parts", " ").alias("parts"), "edges").mapInArrow(
        by_bucket, "_tail string, _bucket int")

    def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                raw = [None if t is None else t.encode() for t in b.column("_text").to_pylist()]
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                columns["_text"] = pa.array([None if t is None else codec.compress(t, asbytes=True) for t in raw], pa.binary())
                columns["_size"] = pa.array([None if t is None else len(t) for t in raw], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    texts = dealt.mapInArrow(packed_texts, f"{schema}, _text binary, _bucket int, _size long").withColumn("_tail", F.lit(None).cast("string"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema.fields if f.name not in ("_tail", "_bucket")]
    # a bucket's folded words come before its texts
    both = texts.unionByName(folded.select(*none, "_tail", "_bucket")).repartition(partitions(docs), "_bucket").sortWithinPartitions(
        "_bucket", F.col("_tail").isNull())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, codec = coder_of_worker(), None, pa.Codec("zstd")
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # ids take more room than texts
                b = whole.slice(at, 500)
                texts, packed = [], []
                of_bucket = zip(*(b.column(n).to_pylist() for n in ("_bucket", "_tail", "_text", "_size")), strict=True)
                for bucket, tail_words, text, size in of_bucket:
                    if bucket != now:
                        now = bucket
                        coder.learn()
                    if tail_words is not None:
                        coder.learn(tail_words)
                        continue
                    texts.append(codec.decompress(text, size, asbytes=True).decode() if text else "")
                    packed.append(coder.encode(texts[-1]))
                sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
                same = [d == t.replace(MARK, " ") for d, t in zip(coder.pieces.decode_all(packed), texts, strict=True)]
                of_texts = b.filter(b.column("_tail").is_null())
                columns = {n: of_texts.column(n) for n in names}
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
                columns |= {"n_tokens": pa.array(sizes), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), "decoded_ok": pa.array(same, pa.bool_())}
                yield pa.RecordBatch.from_pydict(columns)
        whole = b = texts = packed = columns = of_texts = of_bucket = None
        coder.forget()
        release()

    ids = "ids array<int>, " if with_ids else ""
    return both.mapInArrow(coded, f"{schema}, {ids}n_tokens long, ids_sha256 string, decoded_ok boolean")


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the decoded ``text``."""
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def decoded(x: pa.Array) -> pa.Array:
        return pa.array(["" if i is None else shipped.value.decode(i) for i in x.to_pylist()], pa.string())

    return encoded.withColumn(text, decoded(F.col(ids)))


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every whole text of ``documents``."""
    return encode(table(spark, sf_dir, "documents"), load(model_path()), [F.col("doc_id")], "doc_id long", with_ids=False)
