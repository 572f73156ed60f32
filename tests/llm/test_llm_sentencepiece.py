import hashlib
import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from fixtures_llm import edge_docs, empty_docs, rows
from pyspark.sql import functions as F
from runlens.llm import sentencepiece_lattice as S

ODD = ["Hello  world\n x", " a", "a ", "日本\U0001F642 ﬁ x　y z", "\t x", "a   b", "<s>hi</s>", "  ", "a▁b", "x²...", " ▁▁ ", "don't (foo) --- ...\n\n\n 123 456", "é ü", "<0x41> a", "", "²a1²"]


@pytest.fixture(scope="module")
def pieces():
    return S.load(S.model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def test_in_task_lattice_is_the_library(pieces, library):
    rng = random.Random(4)
    parts = [*ODD, "the", "tion", "▁", " ", "ß", "…", "''", "\x00"]
    coder = S.Coder(pieces, {})
    for t in ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(500)]:
        ids = np.frombuffer(coder.encode(t), dtype="<i4").tolist()
        assert ids == library.encode(t), repr(t)
        assert pieces.decode(ids) == library.decode(ids) if ids else True


def test_spark_lattice_is_the_in_task_lattice(spark, pieces):
    words = sorted({w for t in ODD for w in pieces.split(t)} | {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in pieces.split(r.text)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: [i for p in r.parts for i in pieces.ids_of(p)] for r in S.encode_words(df, pieces).collect()}
    assert got == {w: pieces.encode_word(w) for w in words}


@pytest.mark.parametrize("most", [0, 50, S.MOST_WORDS])
def test_encode_matches_the_library_whatever_the_bound(spark, pieces, library, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = S.encode(docs, pieces, [F.col("doc_id")], "doc_id long", most=most)
    for r in got.collect():
        ids = library.encode(text[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_ok
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest()
    for r in S.decode(got, pieces).collect():
        assert r.text == text[r.doc_id].replace(S.MARK, " ")


def test_unigram_models_take_the_best_path(spark):
    rng = random.Random(7)
    letters = "abc"
    names = ["".join(x) for n in (1, 2, 3) for x in itertools.product(letters, repeat=n) if n == 1 or rng.random() < 0.5]
    unigram = S.Pieces([(p, i, -rng.uniform(1, 9) - len(p)) for i, p in enumerate(names)], {}, True, [p.encode() for p in names], unknown=999)
    score = {p: s for p, _, s in unigram.entries}
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(60)]

    def best(w):
        cuts = (c for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k))
        ways = ([w[a:b] for a, b in zip((0, *c), (*c, len(w)), strict=True)] for c in cuts)
        return max((sum(score[p] for p in way), way) for way in ways if all(p in score for p in way))[1]

    got = {r.word: r.parts for r in S.encode_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), unigram).collect()}
    total = lambda way: round(sum(score[p] for p in way), 6)  # noqa: E731  other paths may tie
    for w in words:
        assert "".join(got[w]) == w and total(got[w]) == total(best(w)) == total(unigram._best_path(w))
    odd = S.encode_words(spark.createDataFrame([("azzb",)], "word string"), unigram).first().parts
    assert odd == ["a", "z", "z", "b"] == unigram._best_path("azzb")


def test_edges(spark, pieces, library):
    got = S.encode(edge_docs(spark), pieces, [F.col("doc_id"), F.col("key")], "doc_id long, key string").collect()
    want = sorted(len(library.encode(r[1] or "")) for r in rows())
    assert sorted(r.n_tokens for r in got) == want and all(r.decoded_ok for r in got)
    assert S.encode(empty_docs(spark), pieces, [F.col("doc_id")], "doc_id long").count() == 0


@pytest.mark.parametrize("most", [0, S.MOST_WORDS])
def test_every_word_goes_through_the_lattice(spark, library, most):
    rng = random.Random(11)
    pieces = S.load(S.model_path())
    pieces.parts = None  # no task can encode a word by itself
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    long = [letters(n, "etaoin") for n in (64, 65, 79, 80, 128, 129, 700)] + ["a" * 1000, "=" * 300, "日本語の" * 40, "é" * 65]
    once = [f"rare{letters(9, 'abcdefgh')} the" for _ in range(30)]
    texts = [*once, " ".join(long), *(f"the {w}  {w} x" for w in long), f"twice {long[0]}", "the the the", "", None]
    data = [(i // 2 if i % 3 else None, t) for i, t in enumerate(texts)] + [(7, once[0])] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = S.encode(docs, pieces, [F.col("doc_id"), F.col("text").alias("whole")], "doc_id long, whole string", most=most).collect()
    assert sorted((str(r.doc_id), str(r.whole)) for r in got) == sorted((str(d), str(t)) for d, t in data)
    assert all(list(r.ids) == library.encode(r.whole or "") and r.decoded_ok for r in got)


def test_long_words_are_folded_over_their_edges(spark, pieces):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinsh") for _ in range(n)) for n in (63, 64, 65, 66, 127, 128, 129, 143, 144, 145, 3000)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.parts for r in S.encode_words(df, pieces).collect()}
    assert got == {w: pieces.parts(w) for w in words}
    unigram = S.Pieces([(p, i, -float(len(p)) ** 0.5 - i / 97) for i, p in enumerate(["e", "t", "a", "o", "et", "ta", "eta", "oin", "in", "ao", "sh"])], {}, True, [], unknown=99)
    got = {r.word: r.parts for r in S.encode_words(df, unigram).collect()}
    assert got == {w: unigram.parts(w) for w in words}


def test_pieces_that_are_late_are_merged_step_by_step(spark):
    # "abc" scores better than "ab", which is made before it, where "b" and "c" do not join
    late = S.Pieces([(p, i, -float(i)) for i, p in enumerate(["cd", "abc", "ab", "aa", "aaa", "abcd", "dd"])], {}, False, [], unknown=99)
    assert "abc" in late.late and "dd" not in late.late
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(300)} | {"abc" * 21 + "d", "abcd" * 16, "abcd" * 17})
    got = {r.word: r.parts for r in S.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), late).collect()}
    assert got == {w: late.parts(w) for w in words}


def test_pieces_of_equal_score_are_late(pieces, library):
    assert pieces.late and all(set(p) == {S.MARK} for p in pieces.late)
    assert all(pieces.encode_word(S.MARK * n) == library.encode(" " * (n - 1)) for n in range(2, 40))


def test_letters_beyond_the_basic_plane_split_like_other_characters(spark, library):
    texts = ["a\U00010400b \U00010400\U00010401 x", "\U0001D49Cé \U00020000語", "b\U00010400"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = S.encode(docs, S.load(S.model_path()), [F.col("doc_id")], "doc_id long", most=0).collect()
    assert len(got) == len(texts) and all(list(r.ids) == library.encode(texts[r.doc_id]) and r.decoded_ok for r in got)


def test_texts_meet_their_words_by_bucket(spark, pieces):
    """No join brings words to single rows; texts are exchanged as compressed bytes."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(8)) for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    plan = S.encode(docs, pieces, [F.col("doc_id")], "doc_id long", most=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" in plan and "Join LeftOuter, (_row" not in plan and "by_bucket" in plan


def test_one_worker_to_a_task_deals_and_folds_the_tail(spark, pieces):
    """An executor holds a Python worker for each Python step of a stage and core, so a stage has one."""
    docs = spark.createDataFrame([(1, "the rarest " + "x" * 80)], "doc_id long, text string")
    plan = S.encode(docs, pieces, [F.col("doc_id")], "doc_id long", most=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan


def test_workers_do_not_load_pandas():
    code = "import sys, runlens.llm.sentencepiece_lattice; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(S.__file__).parents[2]).returncode == 0


def test_many_texts_are_decoded_like_one(pieces, library):
    texts = [*ODD, "a\0b \0", "", "퟿\U0001F642"]
    packed = [np.array(library.encode(t), dtype="<i4").tobytes() for t in texts]
    assert pieces.decode_all(packed) == [library.decode(library.encode(t)) if t else "" for t in texts]
    assert pieces.decode_all([b"", b""]) == ["", ""] and pieces.decode_all([]) == []


@pytest.mark.parametrize("text", ["a\0b c", "a  b", "a▁b", " a", "the the, x", "the\nthe"])
def test_rare_words_are_those_that_encoding_asks_for(pieces, text):
    coder = S.Coder(pieces, {" the": b"0000", " a": b"1111"})
    assert sorted(coder.rare(text)) == sorted(set(pieces.spaced(text)) - {" the", " a"})


def test_runs_are_counted_by_their_words(spark, pieces):
    docs = spark.createDataFrame([("the the, the▁x  x.",), ("once",), ("",), (None,), ("x the",)], "text string").coalesce(1)
    got = {r.word: r.n for r in S.word_counts(docs, pieces).collect()}
    assert got == {"▁the": 3, "▁x": 2, "": 27}  # "the," and "x." are met but once
    assert {r.word: r.n for r in S.word_counts(docs.limit(0), pieces).collect()}.get("", 0) == 0
