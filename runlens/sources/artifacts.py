"""Truth files and submissions (S8, S9, S10) and trajectories.

Truth sets are small by nature (a benchmark's questions); submissions are one
JSON document per generation.  Both are parsed from text into VARIANT and then
exploded into canonical long tables, so a single job reads every generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.csv import csv_fields, csv_records
from ..functions.json import json_kind, strict_json, variant_elements, variant_entries
from ..functions.solution import py_str_of_json, solution_from_json
from ..functions.text import py_strip
from ..operators.sequence import first_per_group

GEN = ["run_id", "gen"]
TREE_GEN = ["run_name", "run_id", "gen_name", "gen"]   # tree-level keys (see sources.tree)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its text (truth files are single JSON documents)."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.decode("content", "UTF-8").alias("text"))


def _int_key(v: Column) -> Column:
    """Python ``int(x)`` of a JSON key / value text: surrounding whitespace,
    sign and digit underscores accepted; NULL when it would raise."""
    s = py_strip(v)
    ok = s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    return F.when(ok, F.regexp_replace(s, "_", "").try_cast("decimal(38,0)").try_cast("bigint"))


def _numeric_id(v: Column) -> Column:
    """A JSON id as Python dict lookups see it: ints, integral floats and bools
    equal the int; strings never do (``"1" != 1``)."""
    kind = json_kind(v)
    as_double = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "int", F.try_variant_get(v, "$", "bigint"))
        .when((kind == "float") & (as_double == F.floor(as_double)), as_double.try_cast("bigint"))
        .when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("bigint"))
    )


def truth_mc_from_docs(docs: DataFrame, task: Column) -> DataFrame:
    """S8 (multiple choice): skip a null id or a falsy letter; the last
    duplicate id wins; ``domain``/``subdomain`` are ``N/A`` only when the key
    is absent (a JSON null stays NULL)."""
    items = docs.select(task.alias("task"), F.posexplode(variant_elements(F.col("doc"))).alias("pos", "q"))
    qid = _numeric_id(F.try_variant_get("q", "$.id", "variant"))
    letter = F.try_variant_get("q", "$.correct_answer_letter", "string")

    def meta(key: str) -> Column:
        v = F.try_variant_get("q", f"$.{key}", "variant")
        return F.when(v.isNull(), F.lit(C.DOMAIN_ABSENT)).otherwise(F.try_variant_get("q", f"$.{key}", "string"))

    rows = items.select("task", "pos", qid.alias("question_id"), letter.alias("correct_answer"),
                        meta("domain").alias("domain"), meta("subdomain").alias("subdomain"))
    rows = rows.where(F.col("question_id").isNotNull() & (F.coalesce(F.col("correct_answer"), F.lit("")) != ""))
    last = first_per_group(rows, ["task", "question_id"], [F.col("pos").desc()])
    return last.select("task", "question_id", "correct_answer", "domain", "subdomain")


def load_truth_mc(spark: SparkSession, path: str, task: str) -> DataFrame:
    docs = _whole_files(spark, path).select(strict_json(F.col("text")).alias("doc"))
    return truth_mc_from_docs(docs, F.lit(task))


def load_truth_label(spark: SparkSession, path: str, task: str) -> DataFrame:
    """S8 (labels): CSV ``id,label`` with an explicit schema."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType())])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return df.select(F.lit(task).alias("task"), "id", "label")


def truth_open_from_docs(docs: DataFrame, task: Column) -> DataFrame:
    """S8 (open answers): a JSON object question_id -> answer (string or list)."""
    e = docs.select(task.alias("task"), F.explode(variant_entries(F.col("doc"))).alias("question_id", "v"))
    return e.select("task", "question_id", solution_from_json(F.col("v")).alias("expected"))


def load_truth_open(spark: SparkSession, path: str, task: str) -> DataFrame:
    docs = _whole_files(spark, path).select(strict_json(F.col("text")).alias("doc"))
    return truth_open_from_docs(docs, F.lit(task))


def explode_submission(subs: DataFrame) -> DataFrame:
    """Multiple-choice answers from a submission document, any of three shapes.

    ``subs``: task, run_id, gen, doc (VARIANT).  ``details[]`` wins (ids kept
    with their JSON kind: a string id never equals an int truth id); else
    ``answers{}`` (integer-like keys only); else top-level keys minus the 11
    reserved ones (integer-like only).  ``pos`` orders duplicates: the last wins
    when graded.  Object keys come back sorted (VARIANT), so duplicate ids
    spelled differently ("1", "01") resolve by key order, not file order.
    """
    doc = F.col("doc")
    has_details = F.try_variant_get(doc, "$.details", "variant").isNotNull()
    has_answers = F.try_variant_get(doc, "$.answers", "variant").isNotNull()
    keys = ["task", *GEN]

    d = subs.where(has_details).select(*keys, F.posexplode(variant_elements(
        F.try_variant_get(doc, "$.details", "variant"))).alias("pos", "e"))
    qv = F.try_variant_get("e", "$.question_id", "variant")
    av = F.try_variant_get("e", "$.model_answer", "variant")
    details = d.where(qv.isNotNull() & ~F.coalesce(F.is_variant_null(qv), F.lit(False))).select(
        *keys, _numeric_id(qv).alias("question_id"), F.coalesce(py_str_of_json(av), F.lit("")).alias("answer"),
        F.col("pos").cast("bigint").alias("pos"))

    a = subs.where(~has_details & has_answers).select(*keys, F.posexplode(variant_entries(
        F.try_variant_get(doc, "$.answers", "variant"))).alias("pos", "k", "v"))
    answers = a.select(*keys, _int_key(F.col("k")).alias("question_id"), py_str_of_json(F.col("v")).alias("answer"),
                       F.col("pos").cast("bigint").alias("pos")).where(F.col("question_id").isNotNull())

    f = subs.where(~has_details & ~has_answers).select(*keys, F.posexplode(variant_entries(doc)).alias("pos", "k", "v"))
    flat = f.where(~F.col("k").isin(*C.RESERVED_SUBMISSION_KEYS)).select(
        *keys, _int_key(F.col("k")).alias("question_id"), py_str_of_json(F.col("v")).alias("answer"),
        F.col("pos").cast("bigint").alias("pos")).where(F.col("question_id").isNotNull())
    return details.where(F.col("question_id").isNotNull()).unionByName(answers).unionByName(flat)


def resolve_label_column(df: DataFrame) -> DataFrame:
    """``label`` if present, else the last column, renamed ``pred_label``.

    A schema-level (driver-side) decision: no data is read.
    """
    col = "label" if "label" in df.columns else df.columns[-1]
    return df.withColumnRenamed(col, "pred_label")


def load_label_submission(spark: SparkSession, path: str) -> DataFrame:
    """A label submission CSV with whatever columns it has; ``id`` as BIGINT."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = resolve_label_column(df)
    return df.select(F.col("id").try_cast("bigint").alias("id"), "pred_label")


# --------------------------------------------------------------------------- #
# Trajectories: P5, P6
# --------------------------------------------------------------------------- #
def block_text(b: Column) -> Column:
    """One content block to text (compact JSON where the reference indents)."""
    kind = json_kind(b)
    btype = F.try_variant_get(b, "$.type", "string")
    has_text = F.try_variant_get(b, "$.text", "variant").isNotNull()
    text_of = F.coalesce(py_str_of_json(F.try_variant_get(b, "$.text", "variant")), F.lit(""))
    name = F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("?"))
    inp = F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}"))
    content = F.try_variant_get(b, "$.content", "variant")
    content_text = F.when(json_kind(content) == "string", F.try_variant_get(content, "$", "string")).when(
        json_kind(content) == "array",
        F.array_join(F.transform(variant_elements(content), lambda x: F.coalesce(
            F.try_variant_get(x, "$.text", "string"), py_str_of_json(x))), "\n"),
    ).otherwise(F.coalesce(F.to_json(content), F.lit("null")))
    return (
        F.when(kind == "string", F.try_variant_get(b, "$", "string"))
        .when(kind != "object", py_str_of_json(b))
        .when((btype == "text") | has_text, text_of)
        .when(btype == "tool_use", F.concat(F.lit("[tool_use: "), name, F.lit("]\n"), inp))
        .when(btype == "tool_result", F.concat(F.lit("[tool_result]\n"), content_text))
        .otherwise(F.to_json(b))
    )


def normalize_turn(msg: Column) -> Column:
    """P5: ``{role, text}`` of one message: role defaults to ``unknown``; string
    content as is; a block list joined by blank lines and stripped; NULL -> ''."""
    role = F.coalesce(py_str_of_json(F.try_variant_get(msg, "$.role", "variant")), F.lit("unknown"))
    content = F.try_variant_get(msg, "$.content", "variant")
    kind = json_kind(content)
    text = (
        F.when(content.isNull() | (kind == "null"), F.lit(""))
        .when(kind == "string", F.try_variant_get(content, "$", "string"))
        .when(kind == "array", py_strip(F.array_join(F.transform(variant_elements(content), block_text), "\n\n")))
        .otherwise(py_str_of_json(content))
    )
    return F.struct(role.alias("role"), text.alias("text"))


def trajectory_turns(executions: DataFrame) -> DataFrame:
    """Turns of every trajectory file: one row per message object, in order."""
    rows = executions.where(F.col("status") == "ok").select(
        *TREE_GEN, "file", F.regexp_extract("file", C.EXEC_FILE_PATTERN, 1).try_cast("int").alias("question_id"),
        F.posexplode(variant_elements(F.col("doc"))).alias("turn", "msg"))
    rows = rows.where(F.schema_of_variant("msg").startswith("OBJECT"))
    t = normalize_turn(F.col("msg"))
    return rows.select(*TREE_GEN, "question_id", "file", "turn", t["role"].alias("role"), t["text"].alias("text"),
                       F.col("msg").alias("content"))



def label_submissions(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """S4 + S10 over a tree: each generation's label submission
    (``submission.csv`` before ``predictions.csv``), parsed with its own header.

    Every file keeps its own column choice (``label`` if present, else the last
    column), so one job reads generations whose files differ.  Rows:
    run_id, gen, file, id, pred_label, bad_reason (``NO_ID_COLUMN``, ``EMPTY``,
    ``UNREADABLE``; NULL when fine).  Quoted fields may hold commas, quotes
    and line ends (``functions.csv``).
    """
    from . import tree as S

    names = C.LABEL_SUBMISSION_NAMES
    cand = S.named_texts(spark, files, root, names).where(
        F.col("gen").isNotNull() & F.col("rel_path").isin(*names))
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("rel_path"))
    t = first_per_group(cand, TREE_GEN, [rank])
    lines = csv_records(F.col("text"))
    header = F.transform(csv_fields(F.try_element_at(lines, F.lit(1))), lambda x: py_strip(x))
    label_ix = F.coalesce(F.nullif(F.array_position(header, F.lit("label")), F.lit(0)), F.size(header))
    id_ix = F.coalesce(F.array_position(header, F.lit("id")), F.lit(0))
    parsed = t.select(*TREE_GEN, F.col("rel_path").alias("file"), lines.alias("lines"), label_ix.alias("li"),
                      id_ix.alias("ii"), F.col("text").isNull().alias("unreadable"))
    reason = (F.when(F.col("unreadable"), F.lit("UNREADABLE"))
              .when(F.size("lines") == 0, F.lit("EMPTY")).otherwise(F.lit("NO_ID_COLUMN")))
    bad = parsed.where(F.col("unreadable") | (F.col("ii") == 0)).select(
        *TREE_GEN, "file", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("pred_label"),
        reason.alias("bad_reason"))
    rows = parsed.where(~F.col("unreadable") & (F.col("ii") > 0)).select(
        *TREE_GEN, "file", "li", "ii", F.explode(F.slice("lines", 2, 1 << 30)).alias("line"))
    rows = rows.select(*TREE_GEN, "file", "li", "ii", csv_fields(F.col("line")).alias("cells"))
    cells = F.col("cells")
    good = rows.select(
        *TREE_GEN, "file", _int_key(F.try_element_at(cells, F.col("ii").cast("int"))).alias("id"),
        F.nullif(F.try_element_at(cells, F.col("li").cast("int")), F.lit("")).alias("pred_label"),
        F.lit(None).cast("string").alias("bad_reason"))
    return good.unionByName(bad)
