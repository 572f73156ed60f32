"""Token usage and cost.

Sums are taken in DECIMAL so totals do not depend on the order rows are
added (the same job on 8 or 8000 tasks gives the same cents); the result is
converted to DOUBLE once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small_side

TOKENS = "decimal(20,2)"
PRICE = "decimal(12,4)"   # USD per million tokens


def token_cost(inp: Column, out: Column, reasoning: Column, price_in: Column, price_out: Column) -> Column:
    """``in/1e6 * p_in + (out + reasoning)/1e6 * p_out`` (prices per million)."""
    return (inp * price_in + (out + reasoning) * price_out) / F.lit(1_000_000.0)


def usage_totals(calls: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens, cost and error count per key (a run, a submission).

    ``calls``: keys + model, input_tokens, output_tokens, reasoning_tokens, success.
    ``prices``: model, input_price, output_price (per million tokens); checked
    for size before it is broadcast.
    """
    p = small_side(prices.select("model", F.col("input_price").cast(PRICE).alias("pi"),
                                 F.col("output_price").cast(PRICE).alias("po")))
    c = calls.join(p, "model", "left")
    i, o, r = (F.col(x).cast(TOKENS) for x in ("input_tokens", "output_tokens", "reasoning_tokens"))
    pi, po = F.coalesce(F.col("pi"), F.lit(0).cast(PRICE)), F.coalesce(F.col("po"), F.lit(0).cast(PRICE))
    agg = c.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("calls"),
        F.count_if(~F.coalesce(F.col("success"), F.lit(False))).cast("bigint").alias("errors"),
        F.sum(i).alias("_in"), F.sum(o).alias("_out"), F.sum(r).alias("_reason"),
        F.sum(i * pi + (o + r) * po).alias("_cost_micro"),
    )
    return agg.select(
        *keys, "calls", "errors",
        F.col("_in").cast("double").alias("total_input_tokens"),
        F.col("_out").cast("double").alias("total_output_tokens"),
        F.col("_reason").cast("double").alias("total_reasoning_tokens"),
        F.round(F.col("_cost_micro").cast("double") / F.lit(1_000_000.0), 6).alias("total_cost_usd"),
    )


def inference_summary(responses: DataFrame, keys: list[str]) -> DataFrame:
    """A10: successes, failures, prompt/completion tokens and elapsed seconds."""
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_questions"),
        F.count_if(F.col("success")).cast("bigint").alias("successful"),
        F.count_if(~F.col("success")).cast("bigint").alias("failed"),
        F.sum(F.coalesce(F.col("prompt_tokens"), F.lit(0))).cast("bigint").alias("total_prompt_tokens"),
        F.sum(F.coalesce(F.col("completion_tokens"), F.lit(0))).cast("bigint").alias("total_completion_tokens"),
        F.round(F.sum(F.col("elapsed_seconds").cast("decimal(20,6)")).cast("double"), 6).alias("total_elapsed_seconds"),
    )
