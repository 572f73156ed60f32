r"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own whose context is all earlier
turns and whose only trainable part is that reply.

``expanded`` explodes the assistant turns of a formatted conversation into example
rows ``(conv_id, example, input, loss_start, loss_end)``: the input holds all earlier
turns and the reply, ``formatted[0:loss_end]``, and the loss mask is ``[loss_start,
loss_end)``, code points.  The inputs of a conversation grow with the square of its
turns; they are made row by row and no exchange carries them.  The registered query
makes all example rows and reads the conversations back from them (``gathered``): the
turns from the longest input and what follows it, the trainable text from each
example's own input under its own mask.

Template: each turn is ``<|im_start|>`` role ``\n`` text ``<|im_end|>\n``.
Control strings inside texts get a backslash after their first character, and one
that has ``k`` backslashes there already gets one more; ``unescape`` takes one
away, so the round trip is exact for every text.  In roles, line breaks and
backslashes are escaped too.

Defined results: null text and null role count as empty; rows with equal
(conv_id, turn) are ordered by role and text; null conv_id is a conversation of
its own; null turns come first; an empty table gives an empty table.  Extra input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed values (none holds "<" or "[", so matches cannot overlap): what follows the first character of each control string.
_REST = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>"
_ESCAPE = rf"([<\[])(\\*)(?={_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # "\\" stands for a backslash and "\n" for a line break; pieces between doubled backslashes hold no other pair
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``targets``, the
    masked spans of its assistant turns as array<struct<loss_start, loss_end>>."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = conversations.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<loss_start:int,loss_end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.alias("loss_start"), end.alias("loss_end"))
        spans = F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return convs.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("ts", none, step, lambda a: a["spans"]).alias("targets"))


def expanded(form: DataFrame) -> DataFrame:
    """One row per assistant turn, ``conv_id, example, input, loss_start, loss_end, rest``:
    ``input`` is all that stands before the end of the reply, and ``rest``, in the last
    example's row only, all that follows it; a conversation without assistant turns has one
    row with a null ``example`` and ``input`` and all its text as ``rest``."""
    rows = form.select("conv_id", "formatted", F.size("targets").alias("n"), F.posexplode_outer("targets").alias("example", "s"))
    end = F.coalesce(F.col("s.loss_end"), F.lit(0))
    return rows.select(
        "conv_id", "example", F.when(F.col("example").isNotNull(), F.substring("formatted", F.lit(1), end)).alias("input"),
        F.col("s.loss_start").alias("loss_start"), F.col("s.loss_end").alias("loss_end"),
        F.when(F.coalesce("example", F.col("n") - 1) == F.col("n") - 1, F.substring("formatted", end + 1, F.lit(2**31 - 1))).alias("rest"))


def examples(form: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, loss_start, loss_end``."""
    return expanded(form).where("example IS NOT NULL").drop("input", "rest")


def gathered(rows: DataFrame) -> DataFrame:
    """The rows of ``expanded`` back by conversation: ``conv_id``, ``formatted`` (the longest
    input and what follows it), ``targets``, the masked spans of its examples by their order,
    and ``replies``, what each example's input holds under its mask."""
    reply = F.substring("input", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    span = F.when(F.col("example").isNotNull(), F.struct("example", "loss_start", "loss_end", reply.alias("reply")))
    convs = rows.groupBy("conv_id").agg(
        F.max_by("input", "example").alias("longest"), F.first("rest", ignorenulls=True).alias("rest"), F.sort_array(F.collect_list(span)).alias("es"))
    spans = F.transform("es", lambda e: F.struct(e["loss_start"].alias("loss_start"), e["loss_end"].alias("loss_end")))
    whole = F.concat(F.coalesce("longest", F.lit("")), F.coalesce("rest", F.lit("")))
    return convs.select("conv_id", whole.alias("formatted"), spans.alias("targets"), F.transform("es", lambda e: e["reply"]).alias("replies"))


def materialise(form: DataFrame) -> DataFrame:
    """The examples alone: ``conv_id, example, input, loss_start, loss_end``."""
    return expanded(form).where("example IS NOT NULL").drop("rest")


def read_back(form: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and the masked spans alone (or the
    examples' ``replies``, where gathered): the ``turns`` as array<struct<role, text>> and
    ``loss``, all trainable text."""

    def turn(x: Column) -> Column:
        body = F.substring(x, len(START) + 1, 2**31 - 1)
        cut = F.instr(body, "\n")
        return F.struct(unescape_role(F.left(body, cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.lit(2**31 - 1))).alias("text"))

    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    if "replies" in form.columns:
        masked = F.transform("replies", unescape)
    else:
        masked = F.transform("targets", lambda s: unescape(F.substring(F.col("formatted"), s["loss_start"] + 1, s["loss_end"] - s["loss_start"])))
    return form.select(
        "conv_id", "formatted",
        let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn)).alias("turns"),
        F.array_join(masked, "").alias("loss"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts are control strings."""
    probe = conversations.sparkSession.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') v(t, r)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all examples of all conversations, gathered by conversation and read back."""
    back = read_back(gathered(expanded(formatted(with_probe(table(spark, sf_dir, "conversations"))))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_SQL_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
_SQL_ESC = r"regexp_replace({0}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')"

ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS joined,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length('{START}') + length({_SQL_ESC.format(_SQL_ROLE)}) + 1 + length({_SQL_ESC.format('text')}) + length('<|im_end|>') + 1) AS fc
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(joined) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, fc::BIGINT AS formatted_chars
FROM g
"""
