import hashlib
import random
import re

import numpy as np
from fixtures_llm import edge_docs, empty_docs, rows
from runlens.llm import pii as P

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        n = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and n % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    return sorted((m.start(), P.KINDS.index(k), m.end()) for k, r in RULES.items() for m in re.finditer(r, text or "") if passes(k, m.group()))


def some_texts(n=400):
    rng = random.Random(8)
    parts = ["a.b", "joe", "@", "@@", "mail.example.com", "x-y.org", ".", "..", " ", "-", "+1 (415) 555-2671", "+", "1.2.3.4", "300.1.1.1", "0255.1.2.3", "4111 1111 1111 1111", "4111111111111111",
             "4111-1111-1111-1112", "12", "7", "(", ")", "é\U0001F642", "\n", "phone: ", "3.76.85.226.9", "+49 30 1234567890123", "joe (at) site (dot) org"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def base(model, text):
    return sorted((a, P.KINDS.index(k), b) for a, b, k, is_base in model.select(text) if is_base)


def test_base_spans_match_brute_force():
    none = P.Model(P.Trees(), dict.fromkeys(P.KINDS, np.inf))
    for t in some_texts():
        assert base(none, t) == brute(t), repr(t)


def test_long_runs_are_linear():
    none = P.Model(P.Trees(), dict.fromkeys(P.KINDS, np.inf))
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        assert isinstance(none.select(t), list)


def test_trees_learn_and_additions_never_touch_base_spans(spark):
    rng = np.random.default_rng(1)
    x = rng.random((2000, P.FEATURES))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((P.fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame(list(enumerate(some_texts(1500))), "doc_id long, text string")
    model = P.train(df)
    assert len(model.trees.splits) == P.ROUNDS
    for t in some_texts(200):
        spans = model.select(t)
        assert base(model, t) == brute(t)
        added = [s for s in spans if not s[3]]
        assert all(s[1] <= o[0] or o[1] <= s[0] for s in added for o in spans if o is not s)


def test_other_notations_are_added_and_redacted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 9)))
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))

    def card():
        d = digits(15)
        return d + next(c for c in "0123456789" if P.luhn(d + c))

    def wrong():
        d = card()
        return d[:-1] + str((int(d[-1]) + 1) % 10)

    makes = [lambda: f"{word()}.{digits(2)}@mail.{word()}.org", lambda: f"+1 ({digits(3)}) 555-{digits(4)}", card, wrong, lambda: f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", lambda: digits(7)]
    # what is looked for stands in the corpus too, and often
    other = ["joe (at) site (dot) org", "(415) 555-2671", "212-555-0187", "4111.1111.1111.1111", "phone: 030 1234 5678"]
    texts = [" ".join([*(word() for _ in range(8)), *([other[i % 5]] if i % 3 == 0 else [rng.choice(makes)()]), *(word() for _ in range(8))]) for i in range(1200)]
    model = P.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    clean = {"joe (at) site (dot) org. Next": "[EMAIL]. Next", "(415) 555-2671, ok": "[PHONE], ok", "212-555-0187. 3 of": "[PHONE]. 3 of", "4111.1111.1111.1111 x": "[CARD] x",
             "4111.1111.1111.1112 x": None, "2024-01-15 17 rows": None, "1234567 rows": None, "4111111111111112 x": None, "100 200 3000 x": None}
    df = spark.createDataFrame([(f"and so it is {t}",) for t in clean], "text string")
    assert [r.text for r in P.redact(df, model).collect()] == [f"and so it is {w or t}" for t, w in clean.items()]


def test_copies_do_not_fill_the_sample(spark):
    rng = random.Random(8)
    same = "write to a.b1@mail.org or call +1 (212) 555-0187 at 10.0.0.1"
    others = [f"{t} number {rng.randrange(10**6)}" for t in some_texts(300)]
    df = spark.createDataFrame([(t,) for t in [*others, *[same] * 30_000]], "text string")
    one = spark.createDataFrame([(t,) for t in [*others, same]], "text string")
    many, once = P.train(df), P.train(one)
    assert many.thresholds == once.thresholds and many.trees.start == once.trees.start and len(many.trees.splits) == P.ROUNDS


def test_all_candidates_are_fitted(spark):
    """More of them than the 20,000 that were taken before; the trees are those of all rows at hand."""
    texts = [f"{t} no {i}, write to u{i}@mail.org, (212) 555-{i % 10000:04d}" for i, t in enumerate(some_texts(4500))]
    model = P.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    h = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS h").collect()]
    rows = [c for x, t in zip(h, texts, strict=True) if (x >> 24) % 5 for c in P.examples(t)]
    assert len(rows) > 30_000
    x, y = np.array([c[4] for c in rows], dtype=float), np.array([c[3] for c in rows], dtype=float)
    plain = P.fit(x, y)
    assert model.trees.start == plain.start and len(model.trees.splits) == P.ROUNDS
    assert np.allclose(model.trees.margin(x), plain.margin(x))


def test_features_have_a_fixed_width():
    assert {len(P.features(t, a, b, k)) for t in some_texts(100) for a, b, k, _ in P.proposals(t)} == {P.FEATURES}


def test_query_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    n = 0
    for r in P.query(spark, "/root/testdata/sf0.01").collect():
        want = brute(docs[r.doc_id])
        n += len(want)
        text = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[1] == i for w in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert n > 20


def test_redaction_and_edges(spark):
    assert P.redacted("a joe@x.org b 1.2.3.4", [(2, 11, "email", True), (14, 21, "ip", True)]) == "a [EMAIL] b [IP]"
    assert P.redacted("xx+4111", [(2, 7, "phone", True), (3, 7, "card", True)]) == "xx[PHONE]"
    model = P.train(edge_docs(spark))
    clean = P.redact(edge_docs(spark), model)
    assert clean.columns == edge_docs(spark).columns
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={r[0]}, text={r[1]!r})" for r in rows())
    assert P.find(edge_docs(spark), model).count() == len(rows())
    assert P.find(empty_docs(spark), P.train(empty_docs(spark))).count() == 0
