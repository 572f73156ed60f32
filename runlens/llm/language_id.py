"""Language id: interpolated Kneser-Ney character models in sorted hash arrays.

Training.  A bounded sample of labelled rows (``TRAIN_DOCS`` per language, chosen
by a hash of key and text) is cut into lower-cased words; Spark counts the padded
character n-grams of the words per language and, order by order, their raw and
continuation counts.  From those counts, bounded by the sample, the driver makes
one table per order: the sorted 64-bit hashes of all n-grams that any language
has seen, with a row of interpolated log-probabilities (a column per language)
beside each, and the same for contexts and their back-off weights.

Prediction.  Python tasks take whole texts as runs of letters.  A word's characters
are looked up by binary search, long n-grams first and shorter ones where they
miss; a bounded memo keeps the scores of words that a worker has met.  The
language with the lowest cross-entropy per character wins; ties go to the first
by name.

Calibration.  A fifth of the sample stays out of the counts.  On it, a logistic
curve over the gap between the two best cross-entropies gives ``score``, and a
quantile of the true language's cross-entropy gives the limit beyond which a
prediction is marked ``rejected``.

Defined results: null text and text without a letter give ``und`` with score 0;
without labelled rows every text is ``und``; repeated rows are predicted row by
row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import small_side
from .common import table, written

ORDER = 5
TRAIN_DOCS = 1500
MOST_LANGS = 10_000
#: Share of true-language texts that the rejection limit accepts on the calibration rows.
ACCEPTED = 0.999
MEMO = 300_000
UNKNOWN = "und"
_BEGIN, _END = "\x02", "\x03"
_LETTERS = regex.compile(r"\p{L}+")
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_WORKER: dict = {}


def text_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The padded words' code points in a row, and where events (letters and ends) are."""
    pad = _BEGIN * (ORDER - 1)
    cp = np.frombuffer("".join(pad + w + _END for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return cp, np.flatnonzero(cp != 2)


def _hashes(cp: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        out += (cp[at - k] + np.uint64(1)) * _WEIGHTS[k]
    return out ^ (out >> np.uint64(29))


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted hashes
    logs: list[np.ndarray]  # and their log-probabilities, a column per language
    contexts: list[np.ndarray]  # by order from 2: sorted hashes of contexts
    backoffs: list[np.ndarray]
    floor: np.ndarray  # log-probability of an unseen character
    limit: float = np.inf  # cross-entropy beyond which a prediction is rejected
    slope: float = 1.0
    bias: float = 0.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Summed log-probabilities per word and language; events in the last column."""
        cp, at = _codes(words)
        total = np.zeros((len(at), len(self.langs)), dtype=np.float64)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            hit, row = _find(self.grams[n - 1], _hashes(cp, at[left], n))
            total[left[hit]] += self.logs[n - 1][row[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n > 1:
                hit, row = _find(self.contexts[n - 2], _hashes(cp, at[left] - 1, n - 1))
                total[left[hit]] += self.backoffs[n - 2][row[hit]]
            else:
                total[left] += self.floor
        events = np.array([len(w) + 1 for w in words])
        starts = np.concatenate([[0], np.cumsum(events)[:-1]])
        return np.column_stack([np.add.reduceat(total, starts, axis=0), events]).astype(np.float32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[row] == wanted, row


class Scorer:
    """A model with the word memo of one worker."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((1024, len(model.langs) + 1), dtype=np.float32)

    def entropies(self, text: str | None) -> np.ndarray | None:
        """Cross-entropy per character of each language; none without a letter."""
        words = text_words(text)
        if not words or not self.model.langs:
            return None
        if len(self.rows) > MEMO:
            self.rows.clear()
        fresh = list({w for w in words if w not in self.rows})
        if fresh:
            n = len(self.rows)
            if n + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table[:n], np.zeros((n + 2 * len(fresh), self.table.shape[1]), dtype=np.float32)])
            self.table[n:n + len(fresh)] = self.model.word_scores(fresh)
            self.rows.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        sums = self.table[np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
        return -sums[:-1] / sums[-1]

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        h = self.entropies(text)
        if h is None:
            return UNKNOWN, 0.0, True, None
        best = int(np.argmin(h))
        gap = float(np.partition(h, 1)[1] - h[best]) if len(h) > 1 else 1.0
        score = 1.0 / (1.0 + float(np.exp(-np.clip(self.model.slope * gap + self.model.bias, -60, 60))))
        return self.model.langs[best], score, bool(h[best] > self.model.limit), float(h[best])


def sample(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """At most ``per_lang`` different texts of each language, by a hash: ``lang, text, h``."""
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    # a row per language: broadcast if they are as few as languages are, so no text is exchanged by language.  Different
    # texts are counted, as copies share a hash and would thin the others out; sketches, so no hash is exchanged either
    counts = small_side(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), MOST_LANGS)
    # first a share of about twice the bound by the hash alone (twice, as a sketch may be some percent off); copies then
    # meet in one row; the window sees no more
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("n")) * (1 << 30)
    few = rows.join(counts.where("n > 0"), "lang").where(F.pmod(F.col("h"), F.lit(1 << 30)) < share).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return written(few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("r") <= per_lang).drop("r"), "lang-sample")


def _held_back(h: pd.Series) -> pd.Series:
    return (h // 1024) % 5 == 0


def _counts(chosen: DataFrame) -> pd.DataFrame:
    """``lang, gram, n, raw, cont`` for every order, counted by Spark over the sample."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[~_held_back(b["h"])]
            for lang, texts in b.groupby("lang")["text"]:
                words = Counter(w for t in texts for w in text_words(t))
                out: Counter = Counter()
                for w, c in words.items():
                    s = _BEGIN * (ORDER - 1) + w + _END
                    for i in range(len(w) + 1):
                        out[s[i:i + ORDER]] += c
                yield pd.DataFrame({"lang": lang, "gram": list(out), "raw": list(out.values())})

    level = chosen.select("lang", "text", "h").mapInPandas(grams, "lang string, gram string, raw long").groupBy("lang", "gram").agg(F.sum("raw").alias("raw"))
    level = level.withColumn("cont", F.col("raw"))
    parts = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            level = level.groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("cont"))
        parts.append(level.select(F.lit(n).alias("n"), "lang", "gram", "raw", "cont"))
    all_orders = parts[0]
    for p in parts[1:]:
        all_orders = all_orders.unionByName(p)
    return all_orders.toArrow().to_pandas()


def estimate(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney log-probabilities of every n-gram in every language."""
    langs = sorted(counts["lang"].unique())
    if not langs:
        return Model([], [], [], [], [], np.zeros(0))
    column = {x: i for i, x in enumerate(langs)}
    grams, logs, contexts, backoffs = [], [], [], []
    base = np.full(len(langs), 1.0 / (counts.loc[counts["n"] == 1, "gram"].nunique() + 1))
    lower: dict[str, int] = {}
    lower_p = np.zeros((0, len(langs)))
    back: dict[str, int] = {}
    for n in range(1, ORDER + 1):
        level = counts[counts["n"] == n]
        names = sorted(level["gram"].unique())
        row = {g: i for i, g in enumerate(names)}
        heads = sorted({g[:-1] for g in names})
        head = {g: i for i, g in enumerate(heads)}
        a = np.zeros((len(names), len(langs)))
        # an n-gram at a word's begin has nothing before it to count
        used = np.where((level["gram"].str[0] == _BEGIN) | (n == ORDER), level["raw"], level["cont"])
        a[level["gram"].map(row).to_numpy(), level["lang"].map(column).to_numpy()] = used
        once, twice = (a == 1).sum(axis=0), (a == 2).sum(axis=0)
        cut = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        of_head = np.array([head[g[:-1]] for g in names])
        total, kinds = np.zeros((len(heads), len(langs))), np.zeros((len(heads), len(langs)))
        np.add.at(total, of_head, a)
        np.add.at(kinds, of_head, a > 0)
        weight = np.where(total > 0, cut * kinds / np.maximum(total, 1), 1.0)
        if n == 1:
            below = np.broadcast_to(base, a.shape)
        else:
            below = np.empty(a.shape)
            for i, g in enumerate(names):
                j = lower.get(g[1:])
                below[i] = lower_p[j] if j is not None else base
        p = np.maximum(a - cut, 0) / np.maximum(total, 1)[of_head] + weight[of_head] * below
        lower, lower_p = row, p
        back = head
        order = _sorted_hashes(names, n)
        grams.append(order[0])
        logs.append(np.log(p)[order[1]].astype(np.float32))
        if n > 1:
            order = _sorted_hashes(list(back), n - 1)
            contexts.append(order[0])
            backoffs.append(np.log(weight)[order[1]].astype(np.float32))
        else:
            floor = np.log(weight[0] * base)
    return Model(langs, grams, logs, contexts, backoffs, floor)


def _sorted_hashes(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = _hashes(cp, np.arange(len(names)) * n + n - 1, n)
    by = np.argsort(h)
    return h[by], by


def calibrate(model: Model, rows: pd.DataFrame) -> Model:
    """The rejection limit and the score's curve, from held-back ``h`` (cross-entropies) and ``lang``."""
    if not len(rows):
        return model
    h = np.stack(rows["h"].to_numpy())
    true = rows["lang"].map({x: i for i, x in enumerate(model.langs)})
    h, true = h[true.notna()], true.dropna().astype(int).to_numpy()
    if not len(h):
        return model
    model.limit = float(np.quantile(h[np.arange(len(h)), true], ACCEPTED)) * 1.05
    ordered = np.sort(h, axis=1)
    gap = ordered[:, 1] - ordered[:, 0] if h.shape[1] > 1 else np.ones(len(h))
    right = (np.argmin(h, axis=1) == true).astype(float)
    x, w = np.column_stack([gap, np.ones(len(gap))]), np.array([1.0, 0.0])
    for _ in range(25):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - right) + 0.05 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
    model.slope, model.bias = float(max(w[0], 0.0)), float(w[1])
    return model


def train(labelled: DataFrame, per_lang: int = TRAIN_DOCS) -> Model:
    """``labelled``: columns ``lang`` and ``text``."""
    chosen = sample(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), per_lang)
    model = estimate(_counts(chosen))
    if not model.langs:
        return model

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            b = b[_held_back(b["h"])]
            found = [(lang, e) for lang, t in zip(b["lang"], b["text"], strict=True) if (e := scorer.entropies(t)) is not None]
            yield pd.DataFrame({"lang": [x for x, _ in found], "h": [e for _, e in found]})

    return calibrate(model, chosen.select("lang", "text", "h").mapInPandas(held, "lang string, h array<double>").toArrow().to_pandas())


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[Column, ...] = (), schema: str = "") -> DataFrame:
    """The ``carry`` columns (typed by ``schema``) with ``lang_pred, score, rejected, cross_entropy``."""
    rows = docs.select(*carry, F.col(text).alias("_text"))
    shipped, version = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if version not in _WORKER:
            _WORKER.clear()
            _WORKER[version] = Scorer(shipped.value)
        scorer = _WORKER[version]
        for b in batches:
            found = [scorer.predict(t) for t in b.pop("_text")]
            for i, name in enumerate(("lang_pred", "score", "rejected", "cross_entropy")):
                b[name] = [f[i] for f in found]
            yield b

    return rows.mapInPandas(predicted, f"{schema}, lang_pred string, score double, rejected boolean, cross_entropy double")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: learns from rows whose crc32(doc_id) mod 4 is not 2, predicts every whole text."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out).select("lang", "text"))
    return predict(docs, model, carry=(F.col("doc_id"), held_out.alias("held_out")), schema="doc_id long, held_out boolean")
