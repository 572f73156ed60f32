"""Token counts through a digest cache.

The cache is a table (tokenizer digest, content digest, token count).  Documents
are joined to it by the SHA-256 of their text and of the tokenizer file; only the
distinct texts that it lacks are encoded, and their counts are appended to it.  A
second run over the same texts encodes nothing; another tokenizer file has
entries of its own.

Content is normalised as far as counts allow: null is the empty text, nothing
else, since this tokenizer counts every space and line break.

Inside a task, a text is cut before each single space between two characters that
are not white space.  The byte-level pattern never matches across such a place,
so the count of the text is the sum of the counts of its pieces, and each distinct
piece is encoded once per worker (a bounded memo).  Texts that hold an added
token's string, and tokenizers of another form, are encoded whole.

Defined results: null text counts as empty (no tokens); copies share one
encoding; an empty table gives an empty table and leaves the cache alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, written

LIMIT = 512
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Distinct pieces that a worker remembers.
MEMO = 400_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_WORKER: dict = {}


class PieceCounter:
    """Counts of texts by one tokenizer, with the memo of one Python worker."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        own = json.loads(spec)
        self.added = [x["content"] for x in own.get("added_tokens") or []]
        pre = own.get("pre_tokenizer") or {}
        self.by_pieces = own.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.memo: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.by_pieces or any(a in text for a in self.added):
            return self.whole([text])[0]
        pieces = _CUT.split(text) if text else []
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        fresh = list({p for p in pieces if p not in memo})
        if fresh:
            memo.update(zip(fresh, self.whole(fresh), strict=True))
        return sum(map(memo.__getitem__, pieces))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _cached(spark, cache: str, version: str) -> DataFrame | None:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # two writers may have appended the same text
    return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_misses(distinct: DataFrame, spec: str, version: str) -> DataFrame:
    """Counts of distinct ``(digest, text)`` rows, as rows of the cache."""
    shipped = distinct.sparkSession.sparkContext.broadcast(spec)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if version not in _WORKER:
            _WORKER[version] = PieceCounter(shipped.value)
        counter = _WORKER[version]
        for b in batches:
            yield pd.DataFrame({"tokenizer": version, "digest": b["digest"], "n_tokens": [counter.count(t) for t in b["text"]]})

    return distinct.mapInPandas(counted, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``n_bytes`` and ``n_tokens``; appends what was missing to the table at ``cache``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    texts = docs.select(digest, content.alias("text"))
    known = _cached(spark, cache, version)
    if known is not None:
        texts = texts.join(known, "digest", "left_anti")
    # one text per digest: copies are combined before the exchange
    encode_misses(texts.groupBy("digest").agg(F.first("text").alias("text")), spec, version).write.mode("append").parquet(cache)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.octet_length(content).cast("long").alias("n_bytes"), digest)
    # a written table on that side leaves the planner free to split a digest that very many rows have
    return rows.join(written(_cached(spark, cache, version), "token-counts"), "digest").select("_row.*", "n_bytes", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``, through a cache of its own that begins empty."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = count_tokens(table(spark, sf_dir, "documents"), path, scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
