import corpus_pipeline as C
import sentencepiece
from fixtures_llm import edge_docs
from runlens.llm import sentencepiece_lattice as S
from runlens.llm.common import written
from test_llm_decontam import words
from test_llm_ngram import brute
from test_llm_pii import brute as personal
from test_llm_quality import brute as quality

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), "pipeline-test")
        seen[name] = (before, docs.collect())
        if name != C.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["quality_rules"]
    failed = {r.doc_id for r in before if quality(r.text)[5]}
    assert failed and not failed & {r.doc_id for r in after} and len(after) > 0.7 * len(before)

    before, after = seen["ngram_jaccard_join"]
    want = brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in after} == {d for d, (_, c) in want.items() if d == c}

    before, after = seen["benchmark_decontamination"]
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not any(i in " ".join(words(r.text)) for i in items)}

    before, after = seen["pii"]
    text = {r.doc_id: r.text for r in after}
    for r in before:
        assert not personal(text[r.doc_id]) and (personal(r.text) or text[r.doc_id] == r.text)
    assert all(r.n_chars == len(r.text) for r in after) and len(before) == len(after)

    before, after = seen["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    assert {r.doc_id: list(r.ids) for r in after} == {r.doc_id: library.encode(r.text) for r in before}

    assert sorted((r.doc_id, r.ids_sha256) for r in C.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in after)


def test_stages_take_odd_rows(spark):
    docs = edge_docs(spark)
    for _, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "pipeline-test")
        assert docs.columns == edge_docs(spark).columns
    assert C.STAGES[-1][1](spark, docs, SF).count() == docs.count() == 2
