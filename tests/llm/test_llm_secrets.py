import random
import re

from fixtures_llm import edge_docs, empty_docs, rows
from runlens.llm import secret_scan as S
from runlens.llm import trigrams as G


def brute(text):
    out = []
    for no, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), no, r.kind, m.end()))
    return sorted(out)


def some_texts():
    rng = random.Random(11)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "=", ": ", " = \"", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 4,
             "g" * 3, "ghp_" + "a1" * 20, "xoxb-1234567890-abcdefghij", "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", " ", "\n", "é\U0001F642", "/+_.-", "pass", "word", "tok"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, [(s.start, s.kind_no, s.kind, s.end) for s in r.spans]) for r in df.collect())


def test_spans_match_brute_force(spark):
    ts = some_texts()
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = found(S.scan(df))
    assert got == [(i, brute(t)) for i, t in enumerate(ts)]
    assert sum(len(s) for _, s in got) > 200


def test_many_admitted_keys_give_the_same(spark):
    ts = some_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts * 2)], "doc_id long, text string")
    assert found(S.scan(df, bound=0)) == [(i, brute(t)) for i, t in enumerate(ts * 2)]


def test_no_text_is_exchanged(spark):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    plan = S.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_trigram_queries_never_lose_a_match():
    for t in some_texts():
        for r in S.RULES:
            if re.search(r.pattern, t):
                assert G.admits(r.pattern, t), (r.kind, t)


def test_queries_are_what_the_patterns_demand():
    q = {r.kind: G.trigram_query(r.pattern) for r in S.RULES}
    assert q["hex"] == G.ANY and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"pas", "ass", "ssw", "swd"}) in q["assign"] and frozenset({"tok", "oke", "ken"}) in q["assign"]
    assert G.trigram_query("abc|abd") == G._least([frozenset({"abc"}), frozenset({"abd"})])
    assert G.trigram_query("(x|abc)y*") == G.ANY and G.trigram_query("foo.*bar") == [frozenset({"foo", "bar"})]


def test_candidates_come_from_the_postings(spark):
    df = spark.createDataFrame([(1, "my password"), (2, "AKIA"), (3, "kia aki"), (4, "pass word")], "doc_id long, text string")
    by = {r.key: sorted(r.admitted) for r in S.candidates(S.index(df)).collect()}
    assert sorted(by.values()) == [[0], [1], [1]]


def test_edges(spark):
    got = found(S.scan(edge_docs(spark)))
    assert got == sorted((r[0] if r[0] is not None else -1, brute(r[1])) for r in rows())
    assert S.scan(empty_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = S.scan(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD [rule", "CartesianProduct", "NestedLoop"))


def test_rule_lists_without_trigrams(spark):
    hexes = tuple(r for r in S.RULES if r.kind == "hex")
    df = spark.createDataFrame([(1, "x" + "ab" * 12), (2, None)], "doc_id long, text string")
    assert found(S.scan(df, hexes)) == [(1, [(1, 0, "hex", 25)]), (2, [])]
