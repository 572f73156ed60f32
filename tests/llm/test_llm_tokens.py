import random

import public_tokenizers
from fixtures_llm import edge_docs, empty_docs, rows
from runlens.llm import token_counts as T
from runlens.llm.common import scratch
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_pieces_add_up_to_the_library_count():
    rng, lib = random.Random(2), library()
    counter = T.PieceCounter(open(PATH, encoding="utf-8").read())
    parts = ["the", "don't", "'s", " ", "  ", "\n", "\n\n ", "\t", " ", " ", "\x1c", "\x85", "123", "...", "éè", "\U0001F642", "<|endoftext|>", "日本", "a" * 40]
    for _ in range(600):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(16)))
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_query_matches_the_library(spark):
    lib = library()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in T.query(spark, "/root/testdata/sf0.001").collect():
        n = len(lib.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(text[r.doc_id].encode()))


def test_cache_is_read_and_appended(spark, monkeypatch):
    cache, lib = scratch(spark, "cache-test"), library()
    docs = edge_docs(spark)
    want = sorted((r[0] if r[0] is not None else -1, len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    got = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in df.collect())
    few = docs.where("doc_id < 3")
    assert len(got(T.count_tokens(few, PATH, cache))) == few.count()
    first = spark.read.parquet(cache).count()
    assert first == 2  # one text, and the empty one that null counts as
    assert got(T.count_tokens(docs, PATH, cache)) == want
    after = spark.read.parquet(cache).count()
    assert after == len({r[1] or "" for r in rows()})
    assert got(T.count_tokens(docs, PATH, cache)) == want
    assert spark.read.parquet(cache).count() == after  # nothing was missing
    other = public_tokenizers.path("word_bpe_49k.json")
    T.count_tokens(docs, other, cache)
    assert spark.read.parquet(cache).count() == 2 * after  # another tokenizer has its own entries


def test_two_writers_do_not_double_rows(spark):
    cache = scratch(spark, "cache-test")
    docs = edge_docs(spark)
    n = T.count_tokens(docs, PATH, cache).count()
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    assert T.count_tokens(docs, PATH, cache + "-twice").count() == n


def test_empty(spark):
    assert T.count_tokens(empty_docs(spark), PATH, scratch(spark, "cache-test")).count() == 0
