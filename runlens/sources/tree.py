"""Runs-tree sources.

The tree is ``<root>/run_<id>/gen_<n>/<artifact>`` plus run-level files
(``context.md``, ``profiles.json``).  One ``binaryFile`` scan lists every file
with its size and modification time; ``content`` is read lazily, only for the
rows and columns a query keeps, and size caps are pushed into the scan as a
``length`` filter so oversize files are never opened.

At scale the tree is many small files: scan it once, keep the parsed rows as
parquet partitioned by ``run_id`` (``ingest``), and run analytics from there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.json import json_bad_reason, strict_json
from ..functions.text import WS_CLASS, line_count, py_strip
from ..operators.joins import small_side
from ..operators.sequence import first_per_group

BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])

FILES_COLUMNS = ["run_name", "run_id", "gen_name", "gen", "rel_path", "name", "path", "mtime", "length"]
# A generation is keyed by its directory names (T27: gen_1 and gen_01 are two
# generations sharing index 1); the numeric indexes ride along as attributes.
GEN = ["run_name", "run_id", "gen_name", "gen"]
RUN = ["run_name", "run_id"]

# Python's str.splitlines() separators.
_SPLITLINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _layout(df: DataFrame, root: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Derive run/gen keys and the path inside the generation from ``path``."""
    root_uri = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root_uri.split(":", 1)[-1]) + "/", "")
    parts = F.split(rel, "/")
    run_name = parts.getItem(0)
    second = F.when(F.size(parts) > 2, parts.getItem(1))
    gen_ok = second.rlike(C.GEN_DIR_PATTERN)
    gen_name = F.when(gen_ok, second)
    inner = F.when(gen_ok, F.array_join(F.slice(parts, 3, 1_000_000), "/")).otherwise(
        F.array_join(F.slice(parts, 2, 1_000_000), "/"))
    return df.select(
        run_name.alias("run_name"),
        F.regexp_extract(run_name, C.RUN_DIR_PATTERN, 1).try_cast("int").alias("run_id"),
        gen_name.alias("gen_name"),
        F.regexp_extract(gen_name, C.GEN_DIR_PATTERN, 1).try_cast("int").alias("gen"),
        inner.alias("rel_path"),
        F.try_element_at(parts, F.lit(-1)).alias("name"),
        F.col("path"),
        F.col("modificationTime").alias("mtime"),
        F.col("length"),
        *extra,
    ).where(F.col("run_name").rlike(C.RUN_DIR_PATTERN))


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def binary_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """The raw ``binaryFile`` scan of a tree, empty when nothing matches.

    The tree is loaded as ``<root>/run_*`` -- one path per run -- so listing a
    tree of millions of files is spread over a Spark job (parallel partition
    discovery) instead of one recursive walk on the driver.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    try:
        return r.load(root.rstrip("/") + "/run_*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a wrong scheme or no permission is no empty tree
            raise
        return spark.createDataFrame([], BINARY_FILE_SCHEMA)


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``run_<id>/``; other names are ignored; a missing root is empty.

    ``run_07`` and ``run_7`` share index 7 but stay apart by ``run_name``;
    ``gen`` is NULL for run-level files.
    """
    return _layout(binary_files(spark, root), root)


#: Paths of trajectory files that are broadcast with their numbers (some 200 bytes each).
MAX_BROADCAST_PATHS = 500_000
#: Paths that one scan is given; more make several scans of one union.
MAX_PATHS = 50_000


def _literal_path(path: str) -> str:
    """A path as a load path: glob characters stand for themselves."""
    return "".join("\\" + ch if ch in "\\*?[]{}^" else ch for ch in path)


def with_content(spark: SparkSession, files: DataFrame, root: str, max_bytes: int) -> DataFrame:
    """Attach ``content`` to file rows, reading only those files, within the cap, once.

    The chosen paths become the file list of the scan (which the driver holds for any
    file scan), so nothing else is opened; rows meet their bytes by a broadcast of the
    same list, so no exchange carries ``content``.  Files over the cap have none.
    """
    small = files.where(F.col("length") <= max_bytes)
    paths = sorted(set(small.select("path").toArrow().column(0).to_pylist()))
    out = files.where(F.col("length").isNull() | (F.col("length") > max_bytes)).withColumn("content", F.lit(None).cast("binary"))
    for at in range(0, len(paths), MAX_PATHS):
        part = paths[at:at + MAX_PATHS]
        read = spark.read.format("binaryFile").load([_literal_path(p) for p in part])
        body = read.where(F.col("length") <= max_bytes).select(F.col("path").alias("_path"), "content")
        chosen = small if len(paths) <= MAX_PATHS else small.where(F.col("path").between(part[0], part[-1]))
        met = body.join(F.broadcast(chosen), F.col("_path") == F.col("path"))
        out = out.unionByName(met.select(*files.columns, "content"))
    return out


def read_text_capped(spark: SparkSession, files: DataFrame, root: str,
                     max_bytes: int = C.MAX_CONTEXT_FILE_SIZE) -> DataFrame:
    """UTF-8 text (malformed bytes replaced) of files up to the cap; above
    it ``text`` is NULL and ``bad_reason`` is ``TOO_LARGE``.  A file exactly at
    the cap is kept."""
    if "text" in files.columns:  # the ingested table
        names = [c for c in files.columns if c not in ("text", "bad_reason")]
        over = F.col("length") > max_bytes
        return files.select(*names, F.when(~over, F.col("text")).alias("text"), F.when(over, F.lit("TOO_LARGE")).alias("bad_reason"))
    t = with_content(spark, files, root, max_bytes)
    return t.select(
        *files.columns,
        F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")).alias("text"),
        F.when(F.col("length") > max_bytes, F.lit("TOO_LARGE")).alias("bad_reason"),
    )


def read_capped(spark: SparkSession, root: str, name_glob: str,
                max_bytes: int = C.MAX_CONTEXT_FILE_SIZE) -> DataFrame:
    """S2 in one pass for files chosen by name: only files whose name matches
    ``name_glob`` are listed, only those within the cap are opened (the cap is
    a pushed ``length`` filter) and oversize files come from a metadata-only
    read.  No join back to a file list."""
    def load(with_body: bool) -> DataFrame:
        raw = binary_files(spark, root, name_glob)
        if with_body:
            return raw.where(F.col("length") <= max_bytes)
        return raw.where(F.col("length") > max_bytes).select(
            "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))

    both = load(True).unionByName(load(False))
    laid = _layout(both, root, extra=("content",))
    return laid.select(
        *FILES_COLUMNS,
        F.when(F.col("length") <= max_bytes, F.decode("content", "UTF-8")).alias("text"),
        F.when(F.col("length") > max_bytes, F.lit("TOO_LARGE")).alias("bad_reason"),
    )


def named_texts(spark: SparkSession, files: DataFrame, root: str, names: tuple[str, ...] | list[str] | None = None,
                pattern: str | None = None, max_bytes: int = C.MAX_CONTEXT_FILE_SIZE) -> DataFrame:
    """Text of the files with the given names (or a ``*`` name pattern).

    When ``files`` is the ingested table (it carries ``text``), rows are only
    filtered and the reader's cap applied -- no listing, no scan.  Otherwise one
    name-filtered ``binaryFile`` scan of the tree (``read_capped``).
    """
    if "text" in files.columns:
        cond = F.col("name").isin(*names) if names else F.col("name").rlike(_glob(pattern))
        return files.where(cond).select(
            *FILES_COLUMNS,
            F.when(F.col("length") <= max_bytes, F.col("text")).alias("text"),
            F.when(F.col("length") > max_bytes, F.lit("TOO_LARGE"))
            .otherwise(F.col("bad_reason") if "bad_reason" in files.columns else F.lit(None)).alias("bad_reason"),
        )
    glob = ("{" + ",".join(names) + "}") if names else pattern
    return read_capped(spark, root, glob, max_bytes)


def read_json_capped(spark: SparkSession, files: DataFrame, root: str,
                     max_bytes: int = C.MAX_CONTEXT_FILE_SIZE) -> DataFrame:
    """S3: parsed JSON (VARIANT) or NULL with a reason: too large, unreadable, invalid."""
    t = read_text_capped(spark, files, root, max_bytes)
    return t.select(
        *[c for c in files.columns if c not in ("text", "bad_reason")],
        strict_json(F.col("text")).alias("doc"),
        F.coalesce(F.col("bad_reason"), json_bad_reason(F.col("text"))).alias("bad_reason"),
    )


def pick_by_priority(files: DataFrame, names: tuple[str, ...] | list[str], keys: list[str] = GEN) -> DataFrame:
    """Per key, the first existing file of ``names`` (in that order)."""
    cand = files.where(F.col("rel_path").isin(*names))
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("rel_path"))
    return first_per_group(cand, keys, [rank])


def _glob(pattern: str) -> str:
    """fnmatch-style ``*`` glob of one path segment as an anchored regexp."""
    return "^" + "".join("[^/]*" if ch == "*" else _escape(ch) for ch in pattern) + "$"


def discover_submission(files: DataFrame, open_task: bool = False) -> DataFrame:
    """The submission file of each generation.

    Tiers: newest ``results/*.json``; (open task) ``responses.json``; newest
    match of the first pattern among ``results*``, ``submission*``,
    ``output*`` (``.json``); newest ``*.json``.  Ties on mtime break by path.
    """
    rel = F.col("rel_path")
    top_json = ~rel.contains("/") & rel.endswith(".json")
    tier = F.when(rel.rlike(r"^results/[^/]*\.json$"), F.lit(0))
    if open_task:
        tier = tier.when(rel == C.OPEN_TASK_RESPONSES, F.lit(1))
    for i, pat in enumerate(C.SUBMISSION_PATTERNS):
        tier = tier.when(rel.rlike(_glob(pat)), F.lit(2 + i))
    tier = tier.when(top_json, F.lit(9))
    cand = files.where(F.col("gen").isNotNull()).withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = first_per_group(cand, GEN, [F.col("tier"), F.col("mtime").desc(), F.col("path")])
    return best.select(*GEN, "path", "rel_path", "mtime", "length", "tier")


def load_executions(spark: SparkSession, files: DataFrame, root: str,
                    max_bytes: int = C.MAX_EXECUTION_LOG_SIZE) -> DataFrame:
    """Execution logs with format detection, one row per outcome.

    The ``agent_execution/`` folder wins over ``agent_execution.json``.  Rows:
    run_id, gen, is_multi, file, ord, doc (VARIANT), status, size, raw_preview,
    file_chars.  Status: ``ok``, ``too_large``, ``bad_json``, ``empty_folder``,
    ``not_found``.  (A folder is seen through the files in it: an empty
    directory is invisible to a file scan.)
    """
    rel = F.col("rel_path")
    in_dir = files.where(F.col("gen").isNotNull() & rel.startswith(C.AGENT_EXECUTION_DIR + "/"))
    dir_gens = in_dir.select(*GEN).distinct()
    traj = in_dir.where(F.col("name").rlike(r"^execution_q[^/]*\.json$") & (F.size(F.split(rel, "/")) == 2))
    traj_t = named_texts(spark, files, root, pattern="execution_q*.json", max_bytes=max_bytes).where(
        F.col("gen").isNotNull() & rel.startswith(C.AGENT_EXECUTION_DIR + "/") & (F.size(F.split(rel, "/")) == 2))
    # paths alone are numbered, so no document is sorted; broadcast behind a count, so none is exchanged either
    w = Window.partitionBy(*GEN).orderBy("name")
    ords = small_side(traj.select("path", F.row_number().over(w).alias("ord")), MAX_BROADCAST_PATHS)
    doc = strict_json(F.col("text"))
    multi = traj_t.join(ords, "path").select(
        *GEN, F.lit(True).alias("is_multi"), F.col("name").alias("file"), "ord", doc.alias("doc"),
        F.when(F.col("bad_reason") == "TOO_LARGE", "too_large").when(doc.isNull(), "bad_json")
        .otherwise("ok").alias("status"),
        F.col("length").alias("size"), F.lit(None).cast("string").alias("raw_preview"),
        F.lit(None).cast("bigint").alias("file_chars"),
    )
    empty = dir_gens.join(traj.select(*GEN), GEN, "left_anti").select(
        *GEN, F.lit(True).alias("is_multi"), F.lit(None).cast("string").alias("file"), F.lit(1).alias("ord"),
        F.lit(None).cast("variant").alias("doc"), F.lit("empty_folder").alias("status"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("raw_preview"),
        F.lit(None).cast("bigint").alias("file_chars"),
    )
    single = files.where(F.col("gen").isNotNull() & (rel == C.AGENT_EXECUTION_JSON)).join(dir_gens, GEN, "left_anti")
    single_t = named_texts(spark, files, root, (C.AGENT_EXECUTION_JSON,), max_bytes=max_bytes) \
        .where(rel == C.AGENT_EXECUTION_JSON) \
        .join(dir_gens, GEN, "left_anti")
    sdoc = strict_json(F.col("text"))
    single_rows = single_t.select(
        *GEN, F.lit(False).alias("is_multi"), F.col("name").alias("file"), F.lit(1).alias("ord"), sdoc.alias("doc"),
        F.when(F.col("bad_reason") == "TOO_LARGE", "too_large").when(sdoc.isNull(), "bad_json")
        .otherwise("ok").alias("status"),
        F.col("length").alias("size"),
        F.when(sdoc.isNull() & F.col("text").isNotNull(), F.substring("text", 1, 1000)).alias("raw_preview"),
        F.when(sdoc.isNull() & F.col("text").isNotNull(), F.length("text").cast("bigint")).alias("file_chars"),
    )
    all_gens = files.where(F.col("gen").isNotNull()).select(*GEN).distinct()
    have = dir_gens.unionByName(single.select(*GEN)).distinct()
    missing = all_gens.join(have, GEN, "left_anti").select(
        *GEN, F.lit(False).alias("is_multi"), F.lit(None).cast("string").alias("file"), F.lit(1).alias("ord"),
        F.lit(None).cast("variant").alias("doc"), F.lit("not_found").alias("status"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("raw_preview"),
        F.lit(None).cast("bigint").alias("file_chars"),
    )
    return multi.unionByName(empty).unionByName(single_rows).unionByName(missing)


def trajectory_ids(files: DataFrame) -> DataFrame:
    """Trajectory ids of each generation, numerically sorted."""
    qid = F.regexp_extract("name", C.EXEC_FILE_PATTERN, 1)
    t = files.where(F.col("rel_path").startswith(C.AGENT_EXECUTION_DIR + "/") & (qid != "")
                    & (F.size(F.split("rel_path", "/")) == 2))
    return t.groupBy(*GEN).agg(F.sort_array(F.collect_list(qid.try_cast("int"))).alias("trajectories"))


def source_stats(spark: SparkSession, files: DataFrame, root: str, name: str = "target_agent.py") -> DataFrame:
    """Bytes and line count of one artefact per generation; unreadable -> (0, 0)."""
    t = named_texts(spark, files, root, (name,)).where(F.col("gen").isNotNull() & (F.col("rel_path") == name))
    return t.select(*GEN, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("length")).alias("size"),
                    F.coalesce(line_count(F.col("text")), F.lit(0)).alias("lines"))


def artifact_matrix(files: DataFrame) -> DataFrame:
    """Which known artefacts each generation has (stdout log under either name)."""
    rel = F.col("rel_path")
    cols = []
    for label, fname in C.TEXT_ARTIFACTS.items():
        cond = rel.isin(*C.STDOUT_LOG_NAMES) if label == "stdout_log" else rel == fname
        cols.append(F.bool_or(cond).alias(f"has_{label}"))
    cols.append(F.bool_or(rel.startswith(C.OPENHANDS_DIR + "/")).alias("has_openhands"))
    return files.where(F.col("gen").isNotNull()).groupBy(*GEN).agg(*cols)


def execution_type(files: DataFrame) -> DataFrame:
    """P20: ``Multi-trajectory`` when the generation has an ``agent_execution/`` folder."""
    is_dir = F.col("rel_path").startswith(C.AGENT_EXECUTION_DIR + "/")
    return files.where(F.col("gen").isNotNull()).groupBy(*GEN).agg(
        F.when(F.bool_or(is_dir), F.lit("Multi-trajectory")).otherwise(F.lit("Single")).alias("execution_type"))


def parse_context(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """The ``**Key**: value`` header of each run's context.md.

    Lines up to the first line starting with ``## `` (after strip); keys are
    lower-cased and the last occurrence wins; ``max generations`` becomes an
    int or NULL.
    """
    ctx = named_texts(spark, files, root, (C.CONTEXT_FILE,)).where(
        F.col("gen").isNull() & (F.col("rel_path") == C.CONTEXT_FILE))
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), _SPLITLINES, -1), lambda x: py_strip(x))
    ix = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    cut = F.coalesce(F.try_element_at(F.filter(ix, lambda e: e["x"].startswith("## ")), F.lit(1))["i"], F.size(lines))
    pat = r"^\*\*([^*]+)\*\*:" + WS_CLASS + r"*(.*)$"
    entries = F.transform(
        F.filter(F.col("_head"), lambda e: e["x"].rlike("(?s)" + pat)),
        lambda e: F.struct(
            F.lower(py_strip(F.regexp_extract(e["x"], "(?s)" + pat, 1))).alias("k"),
            py_strip(F.regexp_extract(e["x"], "(?s)" + pat, 2)).alias("v"),
        ),
    )

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(F.col("_e"), lambda e: e["k"] == key), F.lit(-1))["v"]

    out = ctx.select("run_name", "run_id", ix.alias("_ix"), cut.alias("_cut")) \
        .select("run_name", "run_id", F.filter("_ix", lambda e: e["i"] < F.col("_cut")).alias("_head")) \
        .select("run_name", "run_id", entries.alias("_e"))
    mg = last("max generations")
    return out.select(
        "run_name", "run_id",
        last("task").alias("task"), last("meta model").alias("meta_model"), last("task model").alias("task_model"),
        last("agent impl").alias("agent_impl"), last("started").alias("started"),
        F.when(py_strip(mg).rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
               F.regexp_replace(py_strip(mg), "_", "").try_cast("int")).alias("max_generations"),
        F.col("_e").alias("entries"),
    )


def agent_events(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """OpenHands events: sessions sorted, events in file-name order, only
    ``.json`` files, only JSON objects."""
    rel = F.col("rel_path")
    parts = F.split(rel, "/")
    ev = files.where(rel.startswith(C.OPENHANDS_DIR + "/") & (F.size(parts) == 4)
                     & (F.try_element_at(parts, F.lit(3)) == "events") & F.col("name").endswith(".json"))
    t = named_texts(spark, files, root, pattern="*.json").where(
        rel.startswith(C.OPENHANDS_DIR + "/") & (F.size(parts) == 4) & (F.try_element_at(parts, F.lit(3)) == "events"))
    doc = strict_json(F.col("text"))
    rows = t.select(*GEN, parts.getItem(1).alias("session"), F.col("name").alias("event_file"), doc.alias("event")) \
        .where(F.schema_of_variant("event").startswith("OBJECT"))
    w = Window.partitionBy(*GEN, "session").orderBy("event_file")
    return rows.withColumn("ord", F.row_number().over(w))


def eval_summaries(spark: SparkSession, files: DataFrame, root: str, as_reference: bool = False) -> DataFrame:
    """The evaluation summary of each generation (``evaluation_results.json`` >
    ``results.json``) in one canonical schema, whichever of the three layouts
    wrote it (T5):

    * flat with ``details`` (multiple choice): the fields as written;
    * flat with ``per_class`` (labels): ``correct``/``total`` from
      ``n_correct``/``n_total``;
    * ``{summary, results}`` (open answers): fields from ``summary``; its
      ``accuracy`` is already a percent (T4) and ``results`` are the details.

    ``total`` follows T15 (``total_questions`` unless 0, else ``total``).
    ``as_reference=True`` reads only the flat names, reproducing the NULLs a
    reader of the flat layout gets for the other two.
    """
    from ..functions.json import accuracy_percent

    cand = named_texts(spark, files, root, C.EVAL_RESULT_NAMES).where(
        F.col("gen").isNotNull() & F.col("rel_path").isin(*C.EVAL_RESULT_NAMES))
    rank = F.array_position(F.array(*(F.lit(n) for n in C.EVAL_RESULT_NAMES)), F.col("rel_path"))
    chosen = first_per_group(cand, GEN, [rank]).select(*GEN, "rel_path", "text", "bad_reason")
    docs = chosen.select(*GEN, "rel_path", strict_json(F.col("text")).alias("doc"))
    d = F.col("doc")
    is_obj = F.schema_of_variant(d).startswith("OBJECT")

    def num(path: str) -> Column:
        return F.try_variant_get(d, path, "bigint")

    flat_total = F.coalesce(F.nullif(num("$.total_questions"), F.lit(0)), num("$.total"))
    flat_pct = accuracy_percent(d)
    if as_reference:
        total, correct, pct = flat_total, num("$.correct"), flat_pct
        incorrect, missing = num("$.incorrect"), num("$.missing")
        details = F.try_variant_get(d, "$.details", "variant")
    else:
        nested = F.try_variant_get(d, "$.summary", "variant").isNotNull()
        total = F.when(nested, F.coalesce(F.nullif(num("$.summary.total_questions"), F.lit(0)),
                                          num("$.summary.total"))).otherwise(F.coalesce(flat_total, num("$.n_total")))
        correct = F.when(nested, num("$.summary.correct")).otherwise(F.coalesce(num("$.correct"), num("$.n_correct")))
        incorrect = F.when(nested, num("$.summary.wrong_answer")).otherwise(num("$.incorrect"))
        missing = F.when(nested, num("$.summary.failed_inference")).otherwise(num("$.missing"))
        pct = F.when(nested, F.try_variant_get(d, "$.summary.accuracy", "double")).otherwise(flat_pct)
        details = F.coalesce(F.try_variant_get(d, "$.details", "variant"), F.try_variant_get(d, "$.results", "variant"))
    return docs.select(
        *GEN, F.col("rel_path").alias("eval_file"), d.alias("doc"),
        F.when(is_obj, total).alias("total"),
        F.when(is_obj, correct).alias("correct"),
        F.when(is_obj, incorrect).alias("incorrect"),
        F.when(is_obj, missing).alias("missing"),
        F.when(is_obj, num("$.invalid")).alias("invalid"),
        F.when(is_obj, pct).alias("accuracy_percent"),
        F.when(is_obj, details).alias("details"),
    )


def _keys_of(df: DataFrame) -> list[str]:
    """The generation keys a table carries (tree tables have the names too)."""
    return [c for c in GEN if c in df.columns]


def eval_details(summaries: DataFrame) -> DataFrame:
    """The per-question rows of an evaluation summary (NULL unless a list), exploded."""
    arr = F.try_variant_get("details", "$", "array<variant>") if "details" in summaries.columns else \
        F.try_variant_get("doc", "$.details", "array<variant>")
    return summaries.select(*_keys_of(summaries), F.posexplode(arr).alias("pos", "detail"))


def domain_stats_from_details(details: DataFrame) -> DataFrame:
    """A4 over stored details: domain falsy -> ``Unknown``; sorted by name by the reader."""
    dom = F.try_variant_get("detail", "$.domain", "string")
    falsy = dom.isNull() | (dom == "")
    ok = F.coalesce(F.try_variant_get("detail", "$.is_correct", "boolean"), F.lit(False))
    obj = F.schema_of_variant("detail").startswith("OBJECT")
    return details.where(obj).groupBy(*_keys_of(details),
                                      F.when(falsy, F.lit(C.DOMAIN_FALSY)).otherwise(dom).alias("domain")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(ok).cast("bigint").alias("correct")) \
        .withColumn("accuracy_percent", F.round(F.col("correct") * 100.0 / F.col("total"), 6))


def evaluation_outcome(spark: SparkSession, files: DataFrame, root: str, has_evaluator: bool = True,
                       timeout: int = C.EVALUATOR_TIMEOUT) -> DataFrame:
    """Per generation, how its evaluation ended, and why.

    * ``skipped`` -- the task has no evaluator (``has_evaluator=False``), or nothing of the
      generation shows that one ran: no ``evaluation.log`` and no ``results.json``;
    * ``error`` -- it ran and failed.  The log is what the evaluator printed: one that ends in
      an uncaught exception (a traceback header and, as its last line, an exception's name), or
      names a non-zero exit, is ``exit``.  An evaluator that is stopped writes no log, so a
      generation without log or results whose submission is older by more than ``timeout``
      seconds than its newest file is ``timeout``;
    * ``success`` -- it did not fail and ``results.json`` is there;
    * ``warning`` -- it ran to its end and left no ``results.json``.

    Rows: the generation's keys, ``status``, ``reason``.
    """
    rel = F.col("rel_path")
    here = files.where(F.col("gen").isNotNull())
    seconds = F.col("mtime").cast("timestamp").cast("double")
    submission = rel.rlike(_glob("submission*")) | rel.rlike(_glob("predictions*")) | (rel == C.OPEN_TASK_RESPONSES)
    facts = here.groupBy(*GEN).agg(
        F.max(F.when(rel == "results.json", seconds)).alias("results_at"),
        F.max(F.when(rel == C.EVAL_LOG, seconds)).alias("log_at"),
        F.min(F.when(submission, seconds)).alias("submitted_at"), F.max(seconds).alias("last_at"))
    # the zero-byte log of a silent evaluator is not listed, so a log that is there has text
    logs = named_texts(spark, files, root, (C.EVAL_LOG,)).where(F.col("gen").isNotNull() & (rel == C.EVAL_LOG))
    last = py_strip(F.element_at(F.split(py_strip(F.col("text")), "\n"), -1))
    raised = F.col("text").contains("Traceback (most recent call last):") & last.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Exit|Interrupt|Warning)\b(:|$)")
    exited = F.regexp_extract("text", r"(?i)exit(?:ed with)?\s+(?:code|status)[:\s=]+(-?[0-9]+)", 1)
    ends = logs.select("run_name", "gen_name", F.coalesce(raised | ~exited.isin("", "0"), F.lit(False)).alias("failed"))
    j = facts.join(ends, ["run_name", "gen_name"], "left")
    ran, has = F.col("log_at").isNotNull(), F.col("results_at").isNotNull()
    stuck = ~ran & ~has & (F.col("last_at") - F.col("submitted_at") > timeout)
    reason = (F.when(F.lit(not has_evaluator), "no evaluator").when(F.coalesce(F.col("failed"), F.lit(False)), "exit")
              .when(F.coalesce(stuck, F.lit(False)), "timeout").when(~ran & ~has, "not run")
              .when(ran & ~has, "no results"))
    status = (F.when(F.col("reason").isin("no evaluator", "not run"), "skipped").when(F.col("reason").isin("exit", "timeout"), "error")
              .when(F.col("reason") == "no results", "warning").otherwise("success"))
    return j.select(*GEN, reason.alias("reason")).select(*GEN, status.alias("status"), "reason")
