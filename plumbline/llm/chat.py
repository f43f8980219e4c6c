"""Chat formatting: the same dialogue from every participant's point of view.

For each participant of a conversation one example is rendered, in which the participant's turns are the assistant's and everyone
else's are users' with their names; system turns stay the system's. The mask lists the character spans that a model should
learn to produce: the contents of the participant's turns with their end marks, and nothing else.

A turn reads "<|role|>content<|end|>" and a line feed; for users "<|user:name|>". The marks' characters in a text or name are
kept apart by a zero-width joiner after "<|", so no text can open or close a turn.

Cost: one shuffle by conversation, partially combined; an example is a row, so a conversation has to fit a task, as it has to fit its reader.

Defined cases: a null conv_id groups nothing: its rows are left out. A null role is the participant "unknown"; a null text is an empty one. Turns are
in order of turn, then role, then text, with nulls last; repeated rows are repeated turns. Roles are compared as they are written. A conversation that has
only system turns gives no example. Further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>"
GUARD = "<|‍"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit(GUARD))


def perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = SYSTEM) -> DataFrame:
    """(conv_id, speaker, n_turns, n_learned, text, mask): an example for each participant; mask is an array of (begin, end), in characters of text, end exclusive, in order."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).isNull().alias("none"),
            F.col(turn_col).alias("turn"),
            _plain(F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN))).alias("role"),
            _plain(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    ).where("conv_id IS NOT NULL")
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    each = whole.withColumn("speaker", F.explode(F.array_distinct(F.filter(F.transform("turns", lambda x: x["role"]), lambda r: r != system_role))))

    def head(x: Column) -> Column:
        return F.when(x["role"] == system_role, F.lit("<|system|>")).when(x["role"] == F.col("speaker"), F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user:"), x["role"], F.lit("|>")))

    made = each.withColumn("parts", F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END + "\n")).alias("body"), (x["role"] == F.col("speaker")).alias("mine"))))
    # spans: the characters before each turn are summed along the way
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("begin"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(p["mine"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    made = made.withColumn("mask", F.aggregate("parts", zero, step)["mask"])
    return made.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("mask").cast("long").alias("n_learned"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))), ",").alias("mask"),
    )


PERSPECTIVES_SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<|' || chr(8205)) AS role, replace(coalesce(text, ''), '<|', '<|' || chr(8205)) AS text
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k FROM t
), p AS (
  SELECT s.conv_id, s.speaker, k, n.role = s.speaker AS mine, text || '<|end|>' || chr(10) AS body,
    CASE WHEN n.role = 'system' THEN '<|system|>' WHEN n.role = s.speaker THEN '<|assistant|>' ELSE '<|user:' || n.role || '|>' END AS head
  FROM s JOIN n ON s.conv_id = n.conv_id
), q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS past FROM p
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_learned, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(past - length(body) AS BIGINT) || '-' || CAST(past - 1 AS BIGINT), ',' ORDER BY k) FILTER (WHERE mine), '') AS mask
FROM q GROUP BY conv_id, speaker
"""
