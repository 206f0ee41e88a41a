"""Multi-party chat formatting by perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive turns whose lengths are summed together before conversations are summed.
TURNS = 64
# Fixed values of the rendered format.
OPEN, CLOSE, SYSTEM, UNNAMED = "<|im_start|>", "<|im_end|>\n", "system", "unknown"


def _ahead(frame: DataFrame, keys: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """``frame`` with the sum of ``size`` over the rows before each, by ``order`` within ``keys``."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn(name, F.coalesce(F.sum(size).over(window), F.lit(0)))


def _same(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    """Join on ``keys``, null equal to null; the keys come once, from the left."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on, kind).drop(*[f"_{k}" for k in keys])


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every conversation once per participant, with that speaker as assistant and the others as named users.

    A participant is any distinct role but ``system``. One row per (conversation, perspective, turn), as a dialogue
    can be of any length: conv_id, perspective, turn, name, role (assistant, user or system), rendered (the
    turn as it stands in the dialogue), char_start and char_end (its place in the whole dialogue), mask_start and
    mask_end (what is trained: the assistant's own text with its end mark; else both null) and trained. Joining ``rendered`` by
    char_start gives the dialogue. Offsets are sums in three levels (64 turns, one speaker in a turn, equal turns), so no task
    holds a whole long conversation.

    A null role speaks as ``unknown``; a null text is empty; null conversation ids form one conversation; null turns
    come first; equal turns are ordered by role and text; repeated rows are rendered each. Conversations with only
    system turns have one perspective, null, with nothing trained. Other columns are not read.
    """
    lines = conversations.select(
        conversations[conv_col].alias("conv_id"),
        conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit(UNNAMED)).alias("name"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("content"),
    )
    speakers = lines.filter(F.col("name") != SYSTEM).select("conv_id", F.col("name").alias("perspective")).distinct()
    rows = _same(lines, speakers, ["conv_id"], "left")
    own: Column = F.coalesce(F.col("name") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("name") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("role", role).withColumn("head", head).withColumn("rendered", F.concat("head", "content", F.lit(CLOSE)))
    rows = rows.withColumn("size", F.length("rendered").cast("long")).withColumn("far", F.floor(F.col("turn") / TURNS))
    talk, near = ["conv_id", "perspective", "far"], ["conv_id", "perspective", "far", "turn", "name"]
    some = rows.groupBy(*near).agg(F.sum("size").alias("own"))
    most = some.groupBy(*talk).agg(F.sum("own").alias("whole"))
    most = _ahead(most, talk[:2], ["far"], "whole", "ahead_far").drop("whole")
    some = _ahead(some, talk, ["turn", "name"], "own", "ahead_near").drop("own")
    base = _same(some, most, talk).select(*near, (F.col("ahead_far") + F.col("ahead_near")).alias("base"))
    rows = _same(_ahead(rows, near, ["content"], "size", "ahead"), base, near)
    start = F.col("base") + F.col("ahead")
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "perspective", "turn", "name", "role", "rendered",
        start.alias("char_start"), (start + F.col("size")).alias("char_end"),
        F.when(trained, start + F.length("head")).alias("mask_start"),
        F.when(trained, start + F.col("size") - 1).alias("mask_end"),
        trained.alias("trained"),
    )


ORACLE = f"""
WITH lines AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS name, coalesce(text, '') AS content FROM conversations),
speakers AS (SELECT DISTINCT conv_id, name AS perspective FROM lines WHERE name <> '{SYSTEM}'),
named AS (
  SELECT l.conv_id, perspective, turn, name, content,
    CASE WHEN name = perspective THEN 'assistant' WHEN name = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS role
  FROM lines l LEFT JOIN speakers s ON l.conv_id IS NOT DISTINCT FROM s.conv_id),
headed AS (SELECT *, '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM named),
sized AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sized)
SELECT conv_id, perspective, CAST(turn AS BIGINT) AS turn, name, role, rendered,
  CAST(a AS BIGINT) AS char_start, CAST(a + length(rendered) AS BIGINT) AS char_end,
  CASE WHEN role = 'assistant' THEN CAST(a + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN CAST(a + length(rendered) - 1 AS BIGINT) END AS mask_end,
  role = 'assistant' AS trained
FROM placed
"""
