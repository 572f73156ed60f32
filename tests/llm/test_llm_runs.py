"""Periodic runs against a brute-force search over every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures_llm import LONG, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from runlens.llm import period_runs as P


def brute(w, least=24, repeats=3):
    """Every maximal stretch by direct comparison, per period from the least on."""
    n, found = len(w), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - b + q >= max(least, repeats * q):
                found.setdefault((b, i + q), q)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def collapsed(w, runs):
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def text_of(rng):
    """Plain stretches and repeated ones, some of which touch, overlap or repeat a repetition."""
    w = []
    for _ in range(rng.randrange(1, 5)):
        alphabet = rng.choice([2, 3, 10, 1000])
        if rng.random() < 0.6:
            unit = [f"w{rng.randrange(alphabet)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 13, 17, 26, 27, 40, 41, 77]))]
            part = (unit * 9)[:rng.randrange(len(unit), 6 * len(unit) + 1)]
            if rng.random() < 0.2:
                part = (part + ["x"]) * 4
            w += part
        else:
            w += [f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(60))]
    return w


def test_runs_match_brute_force():
    rng = random.Random(4)
    texts = [text_of(rng) for _ in range(500)]
    runs, left = P.detect([" ".join(w).encode() for w in texts])
    assert sum(map(len, runs)) > 250
    for w, r, c in zip(texts, runs, left, strict=True):
        assert r == brute(w), w
        assert c.decode() == collapsed(w, r)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 14)), max_size=6))
def test_two_letter_texts(parts):
    w = [c for unit, times in parts for c in unit * times]
    assert P.detect([" ".join(w).encode()])[0][0] == brute(w)


@pytest.mark.parametrize("period", [1, 7, 8, 9, 12, 13, 19, 100, 1000, 12345])
@pytest.mark.parametrize("exponent", [2.99, 3.0, 3.4])
def test_every_scale_and_the_least_exponent(period, exponent):
    rng = np.random.default_rng(period)
    unit = [f"u{i}" for i in rng.permutation(period)]
    length = max(24, int(np.ceil(exponent * period))) if exponent >= 3 else int(exponent * period)
    body = (unit * (length // period + 1))[:length]
    w = ["left"] * 2 + body + ["right"]
    want = [(2, length, period)] if length >= max(24, 3 * period) else []
    assert P.detect([" ".join(w).encode()])[0][0] == want


def test_patterns_that_defeat_polynomial_hashes():
    """Thue-Morse words hold no cube, whatever their hashes; three copies of one are a run."""
    tm = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    runs, _ = P.detect([" ".join(tm).encode(), " ".join(tm * 3).encode()])
    assert runs[0] == []
    assert (0, 3 * 4096, 4096) in runs[1]


def test_runs_do_not_cross_texts_and_groups_agree(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(text_of(rng)).encode() for _ in range(60)] + [b"a " * 20, b"a " * 20, b"", None]
    together = P.detect(texts)
    alone = [P.detect([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and together[1] == [a[1][0] for a in alone]
    monkeypatch.setattr(P, "CHUNK", 64)  # words are cut in pieces
    assert P.detect(texts) == together


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = {(r.doc_id, r.text): (r.runs, r.collapsed) for r in P.periodic_runs(docs).collect()}
    assert P.periodic_runs(docs).count() == docs.count()
    assert got[(1, None)] == ([], "") and got[(2, "")] == ([], "") and got[(3, "   \n\t ")] == ([], "")
    assert got[(4, LONG)] == ([], LONG)
    assert P.periodic_runs(empty_docs(spark)).collect() == []
    clash = docs.withColumnRenamed("kept", "RUNS").withColumnRenamed("ids", "collapsed")
    assert P.periodic_runs(clash).where("size(runs) > 0").count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(text_of(rng)) if i % 3 else " ".join(f"z{rng.randrange(400)}" for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n"), (1, rows[1][1]), (None, "a " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = brute(w)
        best = max(r, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if r else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in r)), sha(collapsed(w, r))))
    assert got == sorted(want, key=str)
    assert sum(x[1] for x in want) > 100
