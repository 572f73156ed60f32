"""Rows that every operator of the subpackage must take."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i} the" for i in range(30_000))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n_words string, spans string, shard string, id string, key string, size string, component_id string, ids string, _row string, kept string")


def rows():
    texts = [
        "the quick brown fox jumps over the lazy dog and runs to the river bank", None, "", "   \n\t ", LONG,
        "the quick brown fox jumps over the lazy dog and runs to the river bank", "x", "Été \U0001F642 naïve",
    ]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[0], out[1], (None, texts[0], None, None, None), (None, None, None, None, None), (7, "same id again", "en", "s", 13)]


def edge_docs(spark):
    clash = ("1", "a", "b", "c", "d", "e", "f", "g", "h", "i")
    return spark.createDataFrame([r + clash for r in rows()], SCHEMA)


def empty_docs(spark):
    return edge_docs(spark).where(F.lit(False))
