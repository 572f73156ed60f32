import random
import re
from collections import Counter, defaultdict

from fixtures_llm import edge_docs, empty_docs
from runlens.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_query_matches_brute_force(spark):
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    index = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 4):
            index[tuple(w[k:k + 5])].add(i)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = words(r.text)
        n = Counter(i for g in {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i in index.get(g, ()))
        want |= {(r.doc_id, i) for i, c in n.items() if 2 * c >= len(items[i]) - 4}
    assert pairs(D.query(spark, SF)) == want and len(want) > 5


def planted(spark):
    rng = random.Random(9)
    word = lambda: f"q{rng.randrange(10_000)}"
    items = [[word() for _ in range(rng.choice([9, 15, 25, 60]))] for _ in range(12)]
    filler = lambda n: [word() for _ in range(n)]
    docs, leaks = [], set()
    for d in range(240):
        i = rng.randrange(len(items))
        it, kind = list(items[i]), d % 6
        if kind == 1:  # every eleventh word changed
            it = [word() if k % 11 == d % 11 else w for k, w in enumerate(it)]
        elif kind == 2 and len(it) > 20:  # a word put in and one left out
            it = it[:7] + [word()] + it[7:15] + it[16:]
        elif kind == 3:  # a third of the item only
            it = it[:max(3, len(it) // 3)]
        elif kind == 4:
            it = []
        elif kind == 5:  # the item's words in another order
            rng.shuffle(it)
        if kind < 3:
            leaks.add((d, i))
        docs.append((d, " ".join(filler(rng.randrange(40)) + it + filler(rng.randrange(40))).title()))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), leaks)


def test_changed_words_are_tolerated_and_clean_documents_left(spark):
    docs, items, leaks = planted(spark)
    assert pairs(D.leaks(docs, items)) == leaks
    kept = {r.doc_id for r in D.clean(docs, items).collect()}
    assert kept == set(range(240)) - {d for d, _ in leaks}


def test_a_large_benchmark_gives_the_same(spark):
    docs, items, leaks = planted(spark)
    assert pairs(D.leaks(docs, items, bound=0)) == leaks


def test_diagonals_are_united_and_long_parts_count(spark):
    w = lambda a, n: [f"w{a}x{k}" for k in range(n)]
    item = {1: w(1, 38), 2: w(2, 59), 3: [*w(3, 9), *["the", "of"] * 20]}
    docs = {
        0: [*item[1][:19], "put", "in", "here", *item[1][19:]],  # halves on two diagonals
        1: [*w(7, 30), *item[1][:13], *w(8, 40), *item[1][13:26], *w(9, 5), *item[1][26:]],
        2: [*w(7, 5), *item[2][10:45], *w(8, 5)],  # 35 of 59 words
        3: [*w(7, 5), *item[2][:20], *w(8, 5)],  # a third
        4: [x for k in range(40) for x in [*item[3][:9], *["the", f"z{k}", f"y{k}", "of", f"v{k}"] * 2, *["a"] * (k % 5)]],  # lone words agree by chance
        5: item[1][:19],
    }
    a = spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in item.items()], "item_id long, text string")
    for bound in (D.BROADCAST_SEEDS, 0):
        got = {(r.doc_id, r.item_id): (r.matched, r.n_words) for r in D.leaks(a, b, bound).collect()}
        assert got == {(0, 1): (38, 38), (1, 1): (38, 38), (2, 2): (35, 59)}
    assert {r.doc_id for r in D.clean(a, b).collect()} == {3, 4, 5}


def test_short_items_are_found_whole(spark):
    rng = random.Random(21)
    items = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(1, D.SPAN))]) for i in range(30)] + [(90, []), (91, [f"z{k}" for k in range(20)])]
    docs = [(d, [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]) for d in range(80)] + [(500, items[-1][1])]
    want = {(d, i) for d, t in docs for i, w in items if w and any(t[k:k + len(w)] == w for k in range(len(t) - len(w) + 1))}
    a = spark.createDataFrame([(d, " ".join(t).upper()) for d, t in docs] + [(600, None)], "doc_id long, text string")
    b = spark.createDataFrame([(i, "; ".join(w)) for i, w in items] + [(92, None)], "item_id long, text string")
    for bound in (D.BROADCAST_SEEDS, 0):
        assert pairs(D.leaks(a, b, bound)) == want
    n = {i: len(w) for i, w in items}
    assert pairs(D.leaks(a, b, least=5)) == {(d, i) for d, i in want if n[i] >= 5}
    assert {r.doc_id for r in D.clean(a, b, least=5).collect()} == {d for d, _ in docs} - {d for d, i in want if n[i] >= 5} | {600}
    plan = D.leaks(a, b)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_masks_tolerate_any_one_change():
    for changed in range(D.SPAN):
        assert any(changed not in m for m in D.MASKS)


def test_edges(spark):
    text = "the quick brown fox jumps over the lazy dog and runs to the river bank"
    items = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "too short", "x"), (1, text, "x")], "item_id long, text string, key string")
    got = sorted((str(r.doc_id), r.item_id) for r in D.leaks(edge_docs(spark), items).collect())
    assert got == [("0", 1), ("0", 1), ("5", 1), ("None", 1)]
    clean = D.clean(edge_docs(spark), items)
    assert clean.columns == edge_docs(spark).columns and clean.count() == edge_docs(spark).count() - 4
    assert D.leaks(empty_docs(spark), items).count() == 0
    assert D.leaks(edge_docs(spark), items.where("false")).count() == 0


def test_plan(spark):
    docs, items, _ = planted(spark)
    plan = D.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
