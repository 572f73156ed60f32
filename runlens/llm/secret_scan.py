r"""Secret scan over a trigram inverted index; DataFrame functions only.

1. Each rule's regular expression gives a Boolean query of mandatory trigrams
   (``trigrams.trigram_query``); rules without one (hex runs) scan every text.
2. ``index`` makes the postings (trigram, content key) of the trigrams that the
   queries name.  The content key is the MD5 of the text, so copies share postings.
3. ``candidates`` intersects postings: a clause holds for a key that has all of its
   trigrams, a rule holds if a clause does.
4. Texts meet the rules whose query holds, and only those rules' regular expressions
   run.  The admitted keys, counted first, are broadcast up to ``BROADCAST_KEYS``, so no
   text is exchanged.  Beyond that bound a text travels only if it holds, for some clause, the
   trigram of the clause that has the fewest postings: without it the clause cannot hold.

The postings and the admitted keys are written once to the shared checkpoint folder.

Spans are cut natively: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) give the positions, in code points.  A match that fails
the rule's length test is dropped after matching, without a retry.

Defined results: null text counts as empty (no spans); copies, repeated rows and
repeated keys are scanned row by row; an empty table gives an empty table.  Only
the columns named in ``carry`` come back, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import has_at_most
from .common import let, table, written
from .trigrams import ANY, needed, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of ``group`` that a match needs
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]+", 24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
#: Keys and rule numbers: at most some 50 bytes a row.
BROADCAST_KEYS = 500_000
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, no: int) -> Column:
    """The rule's spans in ``text`` as ``SPAN``."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+") and pattern.startswith("["):
        pattern = pattern[:-1] + "{%d,}" % rule.least  # a run of one class: its maximal runs that are long enough

    def cut(pieces: Column, found: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, m: Column) -> Column:
            start = a["at"] + F.length(F.get(pieces, a["i"]))
            end = start + F.length(m)
            inner = m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)
            span = F.array(F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end")))
            out = F.when(F.length(inner) >= rule.least, F.concat(a["out"], span)).otherwise(a["out"])
            return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), out.alias("out"))

        return F.aggregate(found, none, step, lambda a: a["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: cut(p, m))).otherwise(F.array().cast(SPAN)))
    return F.coalesce(whole, F.array().cast(SPAN))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _present(low: Column, trigrams: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Postings ``(trigram, key)``: trigram by its number in the rules' list."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = needed([r.pattern for r in rules])
    # bound, as a generator's argument would lower the text once for each trigram
    present = let(F.lower(t), lambda low: _present(low, names)) if names else F.array().cast("array<int>")
    return (docs.select(_key(t).alias("key"), F.explode(present).alias("trigram"))
            .groupBy("trigram", "key").agg(F.count(F.lit(1)).alias("copies")).select("trigram", "key"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, admitted)``: the numbers of the rules whose query holds, from the postings alone."""
    number = {t: i for i, t in enumerate(needed([r.pattern for r in rules]))}
    clauses = [(no, c, number[t], len(clause)) for no, r in enumerate(rules) if trigram_query(r.pattern) != ANY
               for c, clause in enumerate(trigram_query(r.pattern)) for t in clause]
    # as many rows as the rules have trigrams
    if not clauses:
        return postings.select("key", F.array().cast("array<int>").alias("admitted")).where(F.lit(False))
    fields = ("rule", "clause", "trigram", "n")
    named = postings.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, c, strict=True)]) for c in clauses])))
    held = (postings.join(F.broadcast(named), "trigram").groupBy("key", "rule", "clause", "n").agg(F.count(F.lit(1)).alias("c"))
            .where("c = n"))
    return held.groupBy("key").agg(F.collect_set("rule").alias("admitted"))


def _rarest(postings: DataFrame, rules: tuple[Rule, ...]) -> list[str]:
    """Of each clause the trigram with the fewest postings; as many numbers reach the driver as the rules have trigrams."""
    names = needed([r.pattern for r in rules])
    held = {names[r.trigram]: r.n for r in postings.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}
    clauses = [c for r in rules if trigram_query(r.pattern) != ANY for c in trigram_query(r.pattern)]
    return sorted({min(sorted(c), key=lambda t: held.get(t, 0)) for c in clauses})


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", carry: tuple[str, ...] = ("doc_id",), bound: int = BROADCAST_KEYS) -> DataFrame:
    """``carry`` and ``spans`` (``SPAN``), by start and then by the rules' order."""
    queries = [trigram_query(r.pattern) for r in rules]
    postings = written(index(docs, rules, text), "postings")
    admitted = written(candidates(postings, rules), "admitted")
    near = has_at_most(admitted, bound)
    t = F.coalesce(F.col(text), F.lit(""))
    hit = F.lit(False)
    for x in _rarest(postings, rules):
        hit = hit | F.contains(F.col("_low"), F.lit(x))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")
    d = docs.select(carried, t.alias("_text"), F.lower(t).alias("_low")).withColumn("_hit", hit)
    full = [spans_of(F.col("_text"), r, no) for no, (r, q) in enumerate(zip(rules, queries, strict=True)) if q == ANY]
    # a row that cannot be admitted needs no key but to spread it in an exchange; "_held" is a name
    # of its own, as an alias "_text" would also be met inside the lambdas beside it
    other = F.lit(None).cast("binary") if near else F.unhex(F.hex(F.xxhash64("_row", "_text")))
    d = d.select(
        "_row", F.when(F.col("_hit"), F.col("_text")).alias("_held"), F.when(F.col("_hit"), _key(F.col("_text"))).otherwise(other).alias("key"),
        F.concat(F.array().cast(SPAN), *full).alias("_full"))
    d = d.join(F.broadcast(admitted) if near else admitted, "key", "left")
    some = [F.when(F.array_contains("admitted", no), spans_of(F.col("_held"), r, no)).otherwise(F.array().cast(SPAN))
            for no, (r, q) in enumerate(zip(rules, queries, strict=True)) if q != ANY]
    return d.select("_row.*", F.sort_array(F.concat("_full", *some)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every whole text of ``documents``."""
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in base],
        F.sha2(as_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _sql_rule(no: int, r: Rule) -> str:
    pattern, kind = r.pattern.replace("'", "''"), r.kind
    inner = "m" if r.group == 0 else f"regexp_extract(m, '{pattern}', {r.group})"
    return f"""
  SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, {str(r.base).lower()} AS base, s, s + length(m) AS e FROM (
    SELECT doc_id, m, length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS s
    FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps
                FROM documents WHERE text IS NOT NULL)))
  WHERE length({inner}) >= {r.least}"""


ORACLE_SQL = f"""
WITH sp AS ({" UNION ALL ".join(_sql_rule(no, r) for no, r in enumerate(RULES))}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (base), '') AS b,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans
  FROM sp GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
