import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import edge_docs, empty_docs, rows
from pyspark.sql import functions as F
from runlens.llm import components, ngram_join
from runlens.llm import ngram_join as N


def sets_of(texts, size):
    out = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def brute(texts, size, percent):
    sets, index, parent = sets_of(texts, size), defaultdict(list), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        parent[d] = d
        for e, n in Counter(e for g in sets[d] for e in index[g]).items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for g in sets[d]:
            index[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(n=260, seed=6):
    """Groups of near copies, a passage that most texts share, short texts and copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(12)]
    bases = [[word() for _ in range(rng.choice([4, 20, 60, 150, 330]))] for _ in range(8)]
    out = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind < 3:
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(max(2, len(w) // 18))):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], [word()], [w[at], word()]])
        elif kind == 3:
            w = passage + [word() for _ in range(rng.randrange(30))]
        elif kind == 4:
            w = [word() for _ in range(rng.randrange(1, 4))]
        else:
            w = [word() for _ in range(rng.randrange(60))]
        out.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return out + [(n + i, out[i][1]) for i in range(20)]


@pytest.mark.parametrize(("size", "percent", "frequent", "hot", "probe"), [(3, 90, 1, 1_000_000, 64), (2, 80, 3, 1, 1), (2, 80, 1, 8, 2)])
def test_components_match_brute_force(spark, monkeypatch, size, percent, frequent, hot, probe):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # no key is hot, all are, some are
    monkeypatch.setattr(ngram_join, "PROBE", probe)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.with_components(df, size, percent).collect()}
    want = brute(texts, size, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


def test_a_group_of_near_copies_is_not_paired_member_by_member(spark, monkeypatch):
    """Every list's largest set links with nothing in it, so the stars find no link."""
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 200)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = [(i, " ".join([*base, f"own{i}", f"odd{rng.randrange(10**6)}"])) for i in range(120)]
    texts += [(1000 + i, " ".join([*base[i:i + 40], *(f"x{i}y{k}" for k in range(139))])) for i in range(0, 111)]
    pairs, plain = Counter(), ngram_join.written

    def counted(df, name):
        out = plain(df, name)
        pairs[name] += out.count() if name in ("star-pairs", "short-pairs", "forest", "rest-pairs") else 0
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda lists, law: lists.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.with_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute(texts, 3, 90) and len({c for d, (_, c) in got.items() if d < 1000}) == 1
    assert sum(pairs.values()) < 3 * len(texts), pairs  # 7,140 pairs of the group before


def test_a_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(7)
    law, maps, sets = N.Law(80), [], []
    for _ in range(6):
        tokens = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        sets += [np.delete(tokens, rng.choice(len(tokens), 5, replace=False)) for _ in range(25)]
    maps = [N.bitmap(x) for x in sets]
    n = np.array([len(x) for x in sets], dtype=np.int32)
    run = {"key": np.zeros(len(sets), dtype=np.int64), "id": rng.permutation(len(sets)).astype(np.int64), "n": n, "side": np.arange(len(sets)) % 2}
    run["comp"] = run["id"] // 2
    for across in (False, True):
        every = set(zip(*N._pairs_of(run, maps, [np.zeros(0, dtype=np.int64)] * len(sets), across, law), strict=True))
        for k in range(N.ROUNDS):
            some = set(zip(*N._forest_of(run, maps, across, law, k), strict=True))
            assert some <= every and len(some) < len(sets) < len(every)
            if k == 0:
                assert {x for p in some for x in p} == {x for p in every for x in p}


def test_thue_morse_texts_are_told_apart(spark):
    """Letters and words in patterns that collide under any polynomial modulo 2^64."""
    def tm(n, pair):
        return [pair[bin(i).count("1") % 2] for i in range(n)]

    letters = ["".join(tm(1024, p)) for p in ("ab", "ba")]
    sequences = [" ".join(tm(4096, p)) for p in (("x", "yy"), ("yy", "x"))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(letters + sequences)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.with_components(df, 3, 90).collect()}
    assert got[0] == 0 and got[1] == 1
    assert N.keep_one(df.where("doc_id < 2"), 3, 90).count() == 2
    nodes = [int(n[0]) for t in sequences for _, _, _, n in N.chunks(pa.array([t]))]
    assert nodes[0] != nodes[1]


def test_index_keys_meet_for_every_similar_pair():
    """The law of prefixes and combinations, without Spark."""
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for percent in (80, 90):
        law = N.Law(percent)
        often = np.sort(rng.choice(universe, 2500, replace=False))
        for _ in range(400):
            n = int(rng.choice([1, 2, 3, 9, 10, 11, 19, 20, 21, 38, 40, 45, 80, 160, 330]))
            x = np.sort(rng.choice(universe, n, replace=False))
            drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            y = np.delete(x, rng.choice(n, min(drop, n - 1), replace=False))
            y = np.unique(np.concatenate([y, rng.choice(universe, int(rng.integers(0, 2 + n // 20)))]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (n + len(y) - both):
                continue
            kx, ky = (law.keys(s, N._is_in(s, often)) for s in (x, y))
            assert len(np.intersect1d(kx, ky))
            bits = np.bitwise_count(N._folded([N.bitmap(x)], 32) ^ N._folded([N.bitmap(y)], 32)).sum()
            assert bits <= n + len(y) - 2 * both
            assert N._few_bits(np.array([bits]), np.array([n + len(y)]), law)[0]


def test_number_of_keys_grows_with_the_prefix():
    for n in (20, 200, 2000, 18000):
        tokens = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        tokens = np.unique(N._mixed(tokens))
        keys = N.Law(90).keys(tokens, np.ones(n, dtype=bool))
        assert len(keys) <= 12 * N.Law(90).prefix(n)


@pytest.mark.parametrize("block", [None, 20])
def test_components_of_chains_and_stars(spark, block):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5), (7, 3), (-4, -9)]
    random.Random(1).shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(16), "a", "b", block).collect()
    assert {r.id: r.label for r in found} == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {-4: -9, -9: -9}
    assert len(found) == len({r.id for r in found})
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b", block).count() == 0


def test_edges(spark):
    got = N.with_components(edge_docs(spark), 3, 90).collect()
    assert len(got) == len(rows())
    by_text = {(r.doc_id, r.n_shingles, r.component_id) for r in got}
    n = len(rows()[0][1].split()) - 2
    assert (0, n, 0) in by_text and (5, n, 0) in by_text and (None, n, 0) in by_text  # copies, one of them without an id
    assert {r.component_id for r in got if r.n_shingles == 0} == {r[0] for r in rows() if not (r[1] or "").split()}
    assert N.with_components(empty_docs(spark), 3, 90).count() == 0


def test_keep_one(spark):
    kept = N.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    texts = [r.text for r in kept.collect() if r.text and r.text.split()]
    assert sorted(texts) == sorted({r[1] for r in rows() if r[1] and r[1].split()})
    assert sum(not (r.text or "").split() for r in kept.collect()) == sum(not (r[1] or "").split() for r in rows())
    assert N.keep_one(empty_docs(spark)).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "  "]) for _ in range(rng.randrange(300))) for _ in range(50)]
    texts += ["x" * 500 + " y", " " * 400, "z" * 900, "", None, "tail " * 100]
    whole = [(h[of[i]:of[i + 1]].tolist(), int(n)) for _, h, of, node in N.chunks(pa.array(texts)) for i, n in enumerate(node)]
    assert [len(w) for w, _ in whole] == [len((t or "").encode().split()) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(ngram_join, "CHUNK", size)
        assert [(h[of[i]:of[i + 1]].tolist(), int(n)) for _, h, of, node in N.chunks(pa.array(texts)) for i, n in enumerate(node)] == whole
