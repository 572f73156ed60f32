from collections import Counter

import numpy as np
from fixtures_llm import edge_docs, empty_docs, rows
from pyspark.sql import functions as F
from runlens.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    got = L.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert set(got["lang_pred"]) <= {"en", "de", "fr", "es", "und"}
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert not (got["lang_pred"] == "und").any() or all(not L.text_words(t) for t in got.loc[got["lang_pred"] == "und", "text"])


def test_model_distributions_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").limit(200)
    counts = L._counts(L.sample(docs))
    model = L.estimate(counts)
    alphabet = sorted(counts.loc[counts["n"] == 1, "gram"].unique())
    assert len(alphabet) > 20
    for context in ("\x02\x02\x02\x02", "\x02\x02\x02t", "tion", "\x02the", "zqxw"):
        total = np.zeros(len(model.langs))
        for c in [*alphabet, "一"]:
            total += np.exp(event(model, context + c))
        assert np.allclose(total, 1.0, atol=1e-4), (context, total)


def event(model, gram):
    cp = np.frombuffer(gram.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    at, out = np.array([len(cp) - 1]), np.zeros(len(model.langs))
    for n in range(L.ORDER, 0, -1):
        hit, row = L._find(model.grams[n - 1], L._hashes(cp, at, n))
        if hit[0]:
            return out + model.logs[n - 1][row[0]]
        if n > 1:
            hit, row = L._find(model.contexts[n - 2], L._hashes(cp, at - 1, n - 1))
            if hit[0]:
                out = out + model.backoffs[n - 2][row[0]]
    return out + model.floor


def test_continuation_counts_are_distinct_left_neighbours(spark):
    docs = spark.createDataFrame([("x", "ab cb cb ab eb", 1)], "lang string, text string, h long").select("lang", "text")
    chosen = docs.withColumn("h", F.lit(1024))  # not held back
    counts = L._counts(chosen).set_index(["n", "gram"])
    assert counts.loc[(1, "b"), "cont"] == 3 and counts.loc[(1, "b"), "raw"] == 5


def test_sample_is_bounded_and_deduplicated(spark):
    rows_ = [("en", f"text number {i}") for i in range(300)] + [("en", "the same text")] * 400 + [("de", "ein text")] * 3
    df = spark.createDataFrame(rows_, "lang string, text string")
    got = L.sample(df, per_lang=50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got}["en"] <= 50 and {r.lang: r["count"] for r in got}["de"] == 1


def test_copies_do_not_thin_out_the_sample(spark):
    rows_ = [("en", f"text number {i}") for i in range(300)] + [("en", "the same text")] * 8000 + [("de", "ein text")] * 8000
    got = L.sample(spark.createDataFrame(rows_, "lang string, text string"), per_lang=50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 50, "de": 1}


def brute_entropies(texts, word):
    """Cross-entropy of ``word`` by the definition of interpolated Kneser-Ney, from plain dictionaries."""
    top = L.ORDER
    counts = {}
    for lang, words in texts.items():
        raw = [Counter() for _ in range(top + 1)]
        for w in words:
            s = "\x02" * (top - 1) + w + L._END
            for i in range(top - 1, len(s)):
                for n in range(1, top + 1):
                    raw[n][s[i - n + 1:i + 1]] += 1
        used = [None, *({} for _ in range(top))]
        for n in range(1, top + 1):
            for g, c in raw[n].items():
                before = {x[0] for x in raw[n + 1] if x[1:] == g} if n < top else ()
                used[n][g] = c if n == top or g[0] == "\x02" else len(before)
        counts[lang] = used
    floor = 1 / (len({g for u in counts.values() for g in u[1]}) + 1)
    out = {}
    for lang, used in counts.items():
        def p(g, used=used):
            if not g:
                return floor
            level = used[len(g)]
            once, twice = (sum(v == k for v in level.values()) for k in (1, 2))
            cut = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            beside = {x: v for x, v in level.items() if x[:-1] == g[:-1]}
            if not beside:
                return p(g[1:])
            total = sum(beside.values())
            return max(beside.get(g, 0) - cut, 0) / total + cut * len(beside) / total * p(g[1:])

        s = "\x02" * (top - 1) + word + L._END
        out[lang] = -sum(np.log(p(s[i - top + 1:i + 1])) for i in range(top - 1, len(s))) / (len(word) + 1)
    return out


def test_entropies_match_the_definition(spark):
    texts = {"en": "the then there other mother hot".split(), "de": "der den dem oder mutter heiss".split()}
    chosen = spark.createDataFrame([(lang, " ".join(w), 1024) for lang, w in texts.items()], "lang string, text string, h long")
    scorer = L.Scorer(L.estimate(L._counts(chosen)))
    for word in ("the", "mother", "oder", "mutter", "zebra", "x", "heisst"):
        want = brute_entropies(texts, word)
        got = dict(zip(scorer.model.langs, scorer.entropies(word), strict=True))
        assert all(np.isclose(got[x], want[x], rtol=1e-4) for x in want), (word, got, want)


def test_edges(spark):
    model = L.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text"))
    got = L.predict(edge_docs(spark), model, carry=(F.col("doc_id"), F.col("key")), schema="doc_id long, key string").collect()
    assert len(got) == len(rows())
    assert sum(r.lang_pred == "und" for r in got) == sum(not L.text_words(r[1]) for r in rows())
    assert L.predict(empty_docs(spark), model, carry=(F.col("doc_id"),), schema="doc_id long").count() == 0


def test_without_labelled_rows_everything_is_und(spark):
    model = L.train(empty_docs(spark).select("lang", "text"))
    got = L.predict(edge_docs(spark), model, carry=(F.col("doc_id"),), schema="doc_id long").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
