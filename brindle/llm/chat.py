"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered once with that speaker as the assistant, the others as
named users, and a loss mask on the assistant's own text. One row is one turn under one perspective,
with the place of its segment in the rendered dialogue: a dialogue of any length is spread over rows,
never gathered in one value. The concatenation of `segment` by `position` is the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Consecutive turn numbers in a block; a dialogue's sums are taken within blocks, then over blocks.
BLOCK = 64


def running(df: DataFrame, block: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums within a dialogue, in two levels: no task holds a whole long dialogue.

    df needs conv_id and perspective; blocks must follow the order.
    """
    key = ["conv_id", "perspective", "block"]
    parts = df.withColumn("block", block)
    inner = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block")).rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy(*key).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    totals = totals.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in sums))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    joined = parts.join(totals, same[0] & same[1] & same[2])
    return joined.withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})


def rotate_perspectives(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Render each dialogue from the view of each of its speakers.

    conversations needs conv_id, turn, role, text; other columns are left out. Speakers are the distinct
    roles but `system`; a null role is the speaker `unknown`. A system turn is rendered as system under
    every perspective. Null text is empty. Turns go by turn number (null first), then role, then text;
    equal rows keep both copies, one after the other. A dialogue of system turns alone has no speaker
    and gives no row, an empty table neither. Returns conv_id, perspective, turn, position (from 0),
    speaker, role (assistant, user or system), name (the speaker's where role is user), segment
    (`<|role name|>` newline, text, newline), char_start, char_end (of the segment in the rendered
    dialogue), mask_start, mask_end (of the text that is trained on, null but for the assistant). Roles and
    texts are rendered as they are: one that holds `<|` looks like a header, which only the offsets tell apart.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.filter("speaker <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit("<|"), F.concat_ws(" ", "role", "name"), F.lit("|>\n"))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit("\n")))
    placed = running(seen, F.floor(F.col("turn") / block), ["turn", "speaker", "text"], {"position": F.lit(1).cast("long"), "char_start": F.length("segment").cast("long")})
    spoken = F.col("role") == "assistant"
    start = F.col("char_start") + F.length("head")
    return placed.select(
        "conv_id", "perspective", "turn", "position", "speaker", "role", "name", "segment", "char_start",
        (F.col("char_start") + F.length("segment")).alias("char_end"),
        F.when(spoken, start).alias("mask_start"), F.when(spoken, start + F.length("text")).alias("mask_end"),
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
roles AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns t JOIN speakers s USING (conv_id)),
named AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name FROM roles),
headed AS (SELECT *, '<|' || concat_ws(' ', role, name) || '|>' || chr(10) AS head FROM named),
segments AS (SELECT *, head || text || chr(10) AS segment FROM headed),
placed AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text))
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position, speaker, role, name, segment, CAST(char_start AS BIGINT) AS char_start,
  CAST(char_start + length(segment) AS BIGINT) AS char_end,
  CAST(CASE WHEN role = 'assistant' THEN char_start + length(head) END AS BIGINT) AS mask_start,
  CAST(CASE WHEN role = 'assistant' THEN char_start + length(head) + length(text) END AS BIGINT) AS mask_end
FROM placed
"""
