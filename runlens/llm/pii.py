r"""Personal data: candidate spans scored by gradient-boosted trees.

Generators propose overlapping spans with high recall: everything that the base
rules match, digit groups in many notations, and spelled-out addresses.  Each
candidate has format features (digits, separators, groups, checksums, ranges) and
context features (neighbouring characters and cue words before it).  The trees are
fitted on the candidates of all different texts, by histograms: equal feature vectors
are counted, values are binned at cuts of all of them, and each level of a tree is one
pass over the counted bins whose tasks give sums of gradients by node, feature and bin;
the driver sees only those sums (integers, so the same in any order).  Base spans are
positives.  A generator's candidate has a label of its own, by ``evidence``: its format
and the cue words before it.  So that there are such candidates for every kind the
corpus holds, each base span is also rewritten in place into other notations
(``rewritten``), near misses among them.  On the generators' candidates of a held-back
fifth of the texts each kind gets the lowest threshold that still reaches ``PRECISION``; a kind that
never does, or has fewer than ``LEAST_CALIBRATION`` of them, adds nothing.

Selection: the base spans stay, always; a further candidate at or above its kind's
threshold is added unless it overlaps a base span or a better addition.

Limits of the generators (the base rules have none): digit groups of 7 to 25 digits, spelled-out
addresses with up to 40 characters before the mark and up to four labels after the first.

Texts are handled whole, one at a time, in Arrow batches; no exchange carries texts, and
the candidates of copies are put into one before theirs.

Defined results: null text counts as empty (no spans); repeated rows are scanned
row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, table, written

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST_CALIBRATION = 0.99, 50
ROUNDS, DEPTH, RATE, BINS = 24, 3, 0.3, 16
#: Gradients are summed as whole multiples of 1 / ``UNIT``.
UNIT = 2**30

_EMAIL_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: High recall: digit groups with any of the usual separators, and spelled-out addresses.
_GROUPS = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,24}(?![0-9A-Za-z])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,40}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,40}(?:(?:\.|\x20\.\x20|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,20}){1,4}")
_DIAL = re.compile(r"(?<![0-9A-Za-z])(?:(?:00|\+)?[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
#: Cue words by kind.
CUES = {
    "email": ("mail", "e-mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "teléfono"),
}
_CUE = {k: re.compile(rf"(?<!\w)(?:tele)?(?:{'|'.join(map(re.escape, c))})(?!\w)") for k, c in CUES.items()}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][01]?[0-9][./-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the rule's leftmost matches: the run of local characters before an ``@``, then a domain."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _EMAIL_AT.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def valid(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern passes its test."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def proposals(text: str) -> list[tuple[int, int, str, bool]]:
    """Candidates ``(start, end, kind, base)``: the rules' valid matches, and other spans."""
    out: list[tuple[int, int, str, bool]] = []
    has_digit = re.search("[0-9]", text) is not None
    if "@" in text:
        out += [(a, b, "email", True) for a, b in _emails(text)]
    if has_digit:
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text):
                s = m.group()
                if len(s) > 1:
                    ok = valid(kind, s)
                    if ok or (kind != "card" or len(s) >= 8):
                        out.append((m.start(), m.end(), kind, ok))
        seen = {(a, b, k) for a, b, k, _ in out}
        for pattern, kinds in ((_GROUPS, ("card", "phone")), (_DIAL, ("phone",))):
            for m in pattern.finditer(text):
                for kind in kinds:
                    if (m.start(), m.end(), kind) not in seen:
                        seen.add((m.start(), m.end(), kind))
                        out.append((m.start(), m.end(), kind, False))
    if "at)" in text or "at]" in text:
        out += [(m.start(), m.end(), "email", False) for m in _SPELLED.finditer(text)]
    return out


def _cue(text: str, start: int, kind: str) -> bool:
    return _CUE[kind].search(text[max(0, start - 32):start].lower()) is not None


def _dials(s: str) -> bool:
    """A dialled number by its marks; figures with spaces alone are told apart by a cue only."""
    return _DIAL.fullmatch(s) is not None and ("(" in s or "-" in s or "." in s)


def evidence(text: str, start: int, end: int, kind: str) -> bool:
    """Whether the format of a generator's candidate, or a plausible format after a cue
    word, speaks for personal data."""
    s = text[start:end]
    d, groups = _digits(s), [len(g) for g in re.findall("[0-9]+", s)]
    if text[start - 1:start].isalnum() or text[end:end + 1].isalnum():
        return False
    if kind == "email":
        return "@" not in s and re.search(r"[A-Za-z]", s) is not None and re.search(r"[^A-Za-z][A-Za-z]{2,20}$", s) is not None
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and (groups[:-1] == [4] * (len(groups) - 1) and len(groups) > 3 or _cue(text, start, kind))
    if kind == "phone" and 10 <= len(d) <= 15 and not _DATE.match(s):
        return _dials(s) or max(groups) <= 11 and "/" not in s and _cue(text, start, kind)
    return False


def rewritten(kind: str, s: str) -> list[str]:
    """A base span in notations that the base rules do not match, near misses last."""
    d = _digits(s)
    if kind == "email":
        local, _, domain = s.partition("@")
        dotted = [domain.replace(".", x) for x in (" (dot) ", "[dot]", " . ")]
        return [f"{local} (at) {dotted[0]}", f"{local}[at]{dotted[1]}", f"{local} [at] {domain}", f"{local} (at) {dotted[2]}", f"{local} (at) {domain}.7"]
    if kind == "phone":
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return [f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"{a} {b} {c}", d[-10:], f"{b}-{c}", f"{a}/{b}/{c}"]
    if kind == "card":
        parts = lambda x: [x[i:i + 4] for i in range(0, len(x), 4)]
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        return [sep.join(parts(x)) for x in (d, wrong) for sep in (".", "/", "  ", " - ")]
    return []


def examples(text: str) -> list[tuple[int, str, bool, bool, list[float]]]:
    """Candidates to fit on: ``(start, kind, base, label, features)``."""
    found = proposals(text)
    base = [c for c in found if c[3]]
    out = [(a, k, True, True, features(text, a, b, k)) for a, b, k, _ in base]

    def add(t: str, a: int, b: int, kind: str) -> None:
        out.append((a, kind, False, evidence(t, a, b, kind), features(t, a, b, kind)))

    for a, b, k, _ in found:  # one that overlaps a base span is never added
        if (a, b, k, True) not in base and all(b <= c or d <= a for c, d, _, _ in base):
            add(text, a, b, k)
    for a, b, k, _ in base:
        left, right = text[max(0, a - 64):a], text[b:b + 64]
        for s in rewritten(k, text[a:b]):
            t, at = left + s + right, len(left)
            around = proposals(t)
            if not any(c[3] and c[0] < at + len(s) and at < c[1] for c in around):
                for kind in sorted({c[2] for c in around if c[:2] == (at, at + len(s))}, key=KINDS.index):
                    add(t, at, at + len(s), kind)
    return out


FEATURES = 22


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    before, after = text[start - 1:start], text[end:end + 1]
    longest = max(map(len, groups), default=0)
    letters = len(s) - len(s.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        float(kind == "email"), float(kind == "ip"), float(kind == "card"), float(kind == "phone"),
        len(s), len(d), len(groups), longest, float(len(groups) > 3 and all(len(g) == 4 for g in groups[:-1])),
        s.count(" ") + s.count("-"), s.count("."), s.count("(") + s.count(")"), s.startswith("+"), letters,
        float(luhn(d)) if d else 0.0, float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        sum(c.isalpha() for c in s) / max(len(s), 1),
        before.isalnum() or after.isalnum(), s.count("/"), _dials(s),
        _cue(text, start, kind), _DATE.match(s) is not None,
    ]


@dataclass
class Trees:
    """Boosted regression trees of one depth: per tree the split features and cuts by
    level order, and the leaf values."""

    start: float = 0.0
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for which, cuts, leaves in self.splits:
            out += leaves[_below(x, which, cuts, DEPTH) - (2**DEPTH - 1)]
        return out


def _below(x: np.ndarray, which: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """The node of one tree that each row reaches after so many levels."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, which[node]] > cuts[node])
    return node


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Per value the number of its feature's cuts below it: it is greater than cut ``c`` if its bin is."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


def _sums(bins: np.ndarray, y: np.ndarray, n: np.ndarray, trees: Trees, which: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Gradients and curvatures of ``n`` rows each, summed by node of the level, feature and bin."""
    p = 1 / (1 + np.exp(-trees.margin(bins)))
    node = _below(bins, which, cut, level) - (2**level - 1)
    out = np.zeros((2, 2**level, bins.shape[1], 2 * BINS), dtype=np.int64)
    for k, v in enumerate((y - p, p * (1 - p))):
        whole = np.rint(v * UNIT).astype(np.int64) * n
        for j in range(bins.shape[1]):
            np.add.at(out[k], (node, j, bins[:, j]), whole)
    return out


def _start(share: float) -> float:
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    return float(np.log(share / (1 - share)))


def boosted(share: float, cuts: list[np.ndarray], sums) -> Trees:
    """Second-order boosting with a logistic loss; ``sums(trees, which, cut, level)`` gives
    the histograms of a level, with ``trees`` and ``cut`` over bins."""
    trees, binned = Trees(_start(share)), Trees(_start(share))
    inner = 2**DEPTH - 1
    for _ in range(ROUNDS):
        which, cut, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.full(inner, np.inf)
        leaves = np.zeros(2**DEPTH)
        for level in range(DEPTH):
            got = sums(binned, which, at, level) / UNIT
            for k in range(2**level):
                n, (g, h) = 2**level - 1 + k, got[:, k]
                left, total = np.cumsum(np.stack([g, h]), axis=2), (g[0].sum(), h[0].sum())
                best, sides = 1e-6, ((*total,), (0.0, 0.0))
                for j, c in enumerate(cuts):
                    for b in range(len(c)):
                        (gl, hl), (gr, hr) = left[:, j, b], total - left[:, j, b]
                        gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - total[0] ** 2 / (total[1] + 1)
                        if gain > best:
                            best, which[n], cut[n], at[n], sides = gain, j, c[b], b, ((gl, hl), (gr, hr))
                if level == DEPTH - 1:
                    leaves[2 * k:2 * k + 2] = [RATE * a / (b + 1) for a, b in sides]
        trees.splits.append((which, cut, leaves))
        binned.splits.append((which, at, leaves))
    return trees


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of rows at hand, with quantile cuts."""
    if len(y) < 20 or y.min() == y.max():
        return Trees(_start(float(y.mean()) if len(y) else 0.5))
    cuts = [np.unique(v) for v in x.T]
    # all cuts of a feature with few values, so that a rare one can be told apart
    cuts = [u[:-1] if len(u) <= 2 * BINS else np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for u, v in zip(cuts, x.T, strict=True)]
    bins, ones = _bins(x, cuts), np.ones(len(y), dtype=np.int64)
    return boosted(float(y.mean()), cuts, lambda *tree: _sums(bins, y, ones, *tree))


@dataclass
class Model:
    trees: Trees
    thresholds: dict[str, float]  # on the margin, by kind; infinite: adds nothing

    def select(self, text: str | None) -> list[tuple[int, int, str, bool]]:
        """The chosen spans ``(start, end, kind, base)`` by start, then by kind."""
        if not text:
            return []
        found = proposals(text)
        chosen = [c for c in found if c[3]]
        rest = [c for c in found if not c[3] and np.isfinite(self.thresholds[c[2]])]
        if rest:
            margins = self.trees.margin(np.array([features(text, a, b, k) for a, b, k, _ in rest], dtype=float))
            for _, c in sorted(((-m, c) for m, c in zip(margins, rest, strict=True) if m >= self.thresholds[c[2]])):
                if all(c[1] <= a or b <= c[0] for a, b, _, _ in chosen):
                    chosen.append(c)
        return sorted(chosen, key=lambda c: (c[0], KINDS.index(c[2]), c[1]))


def _candidate_rows(docs: DataFrame, text: str) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(h, i, *c[1:]) for h, t in zip(b["h"], b["t"], strict=True) for i, c in enumerate(examples(t))]
            yield pd.DataFrame(out, columns=["h", "i", "kind", "base", "label", "x"])
        b = out = None
        release()

    return docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t IS NOT NULL").mapInPandas(
        rows, "h long, i int, kind string, base boolean, label boolean, x array<double>")


def _cuts(vectors: DataFrame) -> list[np.ndarray]:
    """Per feature, all its values but the greatest where there are few, or quantiles of all."""
    values = vectors.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n"))
    at = ", ".join(f"{k / BINS}D" for k in range(1, BINS))
    found = values.groupBy("j").agg(
        F.count(F.lit(1)).alias("c"), F.slice(F.sort_array(F.collect_list("v")), 1, 2 * BINS).alias("few"), F.expr(f"percentile(v, array({at}), n)").alias("q"))
    by = {r.j: r for r in found.collect()}  # one row a feature
    return [np.array(by[j].few[:-1]) if by[j].c <= 2 * BINS else np.unique(by[j].q) for j in range(FEATURES)]


def _binned(vectors: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``vectors`` with ``x`` as one byte per feature, equal rows counted."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["x"] = [r.tobytes() for r in _bins(np.stack(b["x"].to_numpy()), cuts)]
                yield b
        b = None
        release()

    got = vectors.mapInPandas(rows, "kind string, base boolean, label boolean, back boolean, x binary, n long")
    return got.groupBy("kind", "base", "label", "back", "x").agg(F.sum("n").alias("n"))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, FEATURES)


def _level(bins: DataFrame):
    """``boosted``'s ``sums`` over ``bins``; a task gives one row of a fixed size."""

    def sums(trees: Trees, which: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = 0
            for b in batches:
                if len(b):
                    out = out + _sums(_matrix(b["x"]), b["label"].to_numpy().astype(float), b["n"].to_numpy(), trees, which, cut, level)
            if not isinstance(out, int):
                yield pd.DataFrame({"s": [out.tobytes()]})
            b = out = None
            release()

        got = bins.select("label", "x", "n").mapInPandas(rows, "s binary").toArrow().column("s").to_pylist()
        return sum(np.frombuffer(x, dtype=np.int64) for x in got).reshape(2, 2**level, FEATURES, 2 * BINS)

    return sums


def _precise(held: DataFrame, trees: Trees) -> dict[str, float]:
    """Per kind the lowest margin of the ``held`` candidates from which on they reach ``PRECISION``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["m"] = trees.margin(np.stack(b["x"].to_numpy()))
                yield b[["kind", "label", "n", "m"]]
        b = None
        release()

    right = F.sum(F.when(F.col("label"), F.col("n")).otherwise(0))
    by = held.select("kind", "label", "n", "x").mapInPandas(rows, "kind string, label boolean, n long, m double").groupBy("kind", "m").agg(
        F.sum("n").alias("n"), right.alias("r"))
    # one row for each margin that the trees give; a few leaves in each of them
    upward = Window.partitionBy("kind").orderBy(F.desc("m"))
    seen = by.withColumn("precision", F.sum("r").over(upward) / F.sum("n").over(upward))
    good = F.min(F.when((F.col("precision") >= PRECISION) & (F.col("m") > 0), F.col("m")))
    found = seen.groupBy("kind").agg(F.sum("n").alias("n"), good.alias("m")).collect()  # a row a kind
    return {r.kind: r.m for r in found if r.n >= LEAST_CALIBRATION and r.m is not None}


def train(docs: DataFrame, text: str = "text") -> Model:
    # copies give the same candidates, which are put into one, so that a text with many copies has no more weight
    different = _candidate_rows(docs, text).dropDuplicates(["h", "i"])
    back = F.pmod(F.shiftright("h", 24), F.lit(5)) == 0
    vectors = written(different.groupBy("kind", "base", "label", back.alias("back"), "x").agg(F.count(F.lit(1)).alias("n")), "pii-vectors")
    n, right = vectors.where("NOT back").agg(F.sum("n"), F.sum(F.when(F.col("label"), F.col("n")))).first()
    none = dict.fromkeys(KINDS, np.inf)
    n, right = n or 0, right or 0
    if n < 20 or right in (0, n):
        trees = Trees(_start(right / n if n else 0.5))
    else:
        cuts = _cuts(vectors.where("NOT back"))
        bins = written(_binned(vectors.where("NOT back"), cuts), "pii-bins")
        trees = boosted(right / n, cuts, _level(bins))
    return Model(trees, none | _precise(vectors.where("back AND NOT base"), trees))


def _applied(docs: DataFrame, model: Model, carry: list, schema: str, row) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield row(b, shipped.value)

    return docs.select(*carry).mapInPandas(mapped, schema)


def as_text(spans: list[tuple[int, int, str, bool]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)


def find(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, counts per kind, ``base_sha256`` and ``spans``."""
    kind = docs.schema[key].dataType.simpleString()

    def row(b: pd.DataFrame, m: Model) -> pd.DataFrame:
        found = [m.select(t) for t in b["_text"]]
        base = [[s for s in f if s[3]] for f in found]
        out = {key: b["_key"]}
        for k in KINDS:
            out[f"n_{k}"] = [sum(s[2] == k for s in f) for f in base]
        out["base_sha256"] = [hashlib.sha256(as_text(f).encode()).hexdigest() for f in base]
        out["spans"] = [as_text(f) for f in found]
        return pd.DataFrame(out)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return _applied(docs, model, [F.col(key).alias("_key"), F.col(text).alias("_text")], f"`{key}` {kind}, {counts}, base_sha256 string, spans string", row)


def redacted(text: str | None, spans: list[tuple[int, int, str, bool]]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind's mark."""
    if not text or not spans:
        return text
    out, last = [], 0
    for a, b, kind, _ in spans:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with chosen spans replaced by ``[KIND]`` in ``text``; other columns as they were."""
    from pyspark.sql import types as T

    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def cleaned(t: pd.Series) -> pd.Series:
        m = shipped.value
        return t.map(lambda x: redacted(x, m.select(x)), na_action="ignore")

    return docs.withColumn(text, cleaned(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
