import random
import re
from collections import Counter

from fixtures_llm import edge_docs, empty_docs, rows
from runlens.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    wins = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {p for i in range(len(ws) - 4) if wins[tuple(ws[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    out = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 10 or 100 * out[4] > 20 * out[0])


def measured(df):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.orderBy("doc_id").collect()]


def test_measures_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        vocab = [rng.choice(["a", "bb", "c#", "<d>", "\x1c", " ", "é"]) + str(rng.randrange(3)) for _ in range(rng.choice([2, 5, 40]))]
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "  ", "\x0b", "\r\n"]) for _ in range(rng.randrange(80))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert measured(Q.assess(df)) == [brute(t) for t in texts]


def test_edges(spark):
    got = Q.assess(edge_docs(spark))
    assert sorted((r.n_words, r.base_failed, r.kept) for r in got.collect()) == sorted(
        (b[0], b[5], not b[5]) for b in (brute(r[1]) for r in rows()))
    kept = Q.keep(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(r.text for r in kept.collect()) == sorted(r[1] for r in rows() if not brute(r[1])[5])
    assert Q.assess(empty_docs(spark)).count() == 0 and Q.keep(empty_docs(spark)).count() == 0


def test_plan_is_one_projection(spark):
    plan = Q.assess(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Python", "Arrow", "Aggregate"))


def test_rules_table_is_what_decides(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    lax = tuple(r for r in Q.RULES if r.name != "too_few_words")
    assert [r.kept for r in Q.assess(df).collect()] == [False]
    assert [r.kept for r in Q.assess(df, rules=lax).collect()] == [True]


def test_clean_documents_with_a_repeated_short_line_stay(spark):
    line = lambda a, n: " ".join(["the", *(f"w{a}x{k}" for k in range(n))])
    texts = {
        1: "\n".join([line(1, 4), line(1, 4), line(2, 100)]),  # 1 of 3 lines, few of the words
        2: "\n".join([line(1, 3), line(1, 3), line(2, 40), line(1, 3), line(3, 40)]),
        3: "\n".join([line(k // 2, 3) for k in range(40)]),  # half of the text twice
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rules = tuple(r for r in Q.KEEP_RULES if not r.base)
    assert sorted(r.doc_id for r in Q.keep(df, rules=rules).collect()) == [1, 2]

    sf = "/root/testdata/sf0.1"
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(clean, "doc_id", "left_semi")
    base = {r.doc_id for r in Q.assess(docs).where("NOT base_failed").collect()}
    assert {30, 3314, 3326} <= base and {r.doc_id for r in Q.keep(docs).collect()} == base


def test_clean_texts_of_other_languages_and_in_capitals_stay(spark):
    polish = ("Każdego ranka stary rybak wypływa łodzią na spokojne jezioro, gdzie mgła powoli znika nad wodą. Jego syn naprawia sieci, "
              "liczy złowione ryby i opowiada sąsiadom, jaka pogoda będzie jutro. ")
    russian = "Каждое утро старый рыбак выходит на озеро, чинит сети и рассказывает соседям, какая погода будет завтра. "
    finnish = "Vanha kalastaja lähtee joka aamu järvelle, korjaa verkkoja ja kertoo naapureille, millainen sää huomenna tulee. "
    english = "The old man walks to the river in the morning, and he is mending nets for the boats that were lost at sea. "
    numbered = lambda t, n: " ".join(f"{t}{i}" for i in range(n))
    vary = lambda t, k: " ".join(f"{w}" if i % 4 else f"{w} {numbered('x', 0)}{chr(97 + (i * 7 + j) % 26)}{chr(97 + (i + 5 * j) % 26)}" for j in range(k) for i, w in enumerate(t.split()))
    salad = " ".join(f"{a}{b}{c}ing" for a in "bdfgk" for b in "aeiou" for c in ("rt", "nd", "lk", "mp", "st"))
    texts = {1: vary(polish, 7), 2: vary(russian, 12), 3: vary(finnish, 12), 4: vary(english, 8).upper(), 5: salad, 6: vary(english, 8)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert all(len(t.split()) >= 100 for t in texts.values())
    rules = tuple(r for r in Q.KEEP_RULES if not r.base)
    assert sorted(r.doc_id for r in Q.keep(df, rules=rules).collect()) == [1, 2, 3, 4, 6]
