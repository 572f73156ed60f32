"""Registered queries of the subpackage: against their SQL, and their columns."""

import __spark_entry__ as E
import duckdb
import pytest
from runlens.llm import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "labels")
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_ok": "boolean"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op9_decontamination": {"doc_id": "bigint", "item_id": "bigint", "matched": "bigint", "n_words": "bigint"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_period_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_columns_and_rows(spark, name):
    df = E.queries()[name](spark, SF)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    n = {"op12_whitening": lambda: 16 * spark.read.parquet(f"{SF}/embeddings.parquet").count(), "op8_chat_format": lambda: spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1}
    if name != "op9_decontamination":  # a row per document and item found
        assert df.count() == n.get(name, lambda: spark.read.parquet(f"{SF}/documents.parquet").count())()


def test_all_are_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(E.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 14))
