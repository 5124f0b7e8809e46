"""Multi-party perspective rotation: for every participant of a conversation the
dialogue is rendered with that speaker as assistant and the others as named
users; the mask marks the characters the speaker wrote, which a model is to
learn.  Roles in ``CONTEXT`` are no participants: their turns stay as context.

A long conversation comes in blocks of ``BLOCK_TURNS`` turn numbers, so no row
grows with its length.  All built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = ("system",)
BLOCK_TURNS = 512
END = "<|end|>\n"


def rotate(turns: DataFrame, context=CONTEXT, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, block, n_turns, text, mask (``start:stop`` in code
    points, joined by commas) and n_masked.

    Turns are ordered by number, then role and text; repeated rows are turns of
    their own.  A null role is the speaker ``unknown``, a null text is empty, a
    null turn comes first (block -1); rows with a null conv_id form one
    conversation.  A conversation of context alone gives no row.
    """
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long"))
    speakers = (t.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker"))
                .distinct())
    blocks = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def head(m):
        return (F.when(m["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
                .when(m["role"].isin(*context), F.concat(F.lit("<|"), m["role"], F.lit("|>\n")))
                .otherwise(F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n"))))

    parts = F.transform("turns", lambda m: F.struct(
        F.concat(head(m), m["text"], F.lit(END)).alias("out"), F.length(head(m)).alias("skip"),
        (m["role"] == F.col("speaker")).alias("own")))

    def step(a, p):
        start, stop = a["at"] + p["skip"], a["at"] + F.length(p["out"])
        return F.struct(stop.alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"))))).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
                        step, lambda a: a["spans"])
    seen = seen.withColumn("parts", parts).withColumn("spans", spans)
    return seen.select(
        "conv_id", "speaker", "block", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("text"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_masked"))


#: The same in DuckDB.
ROTATE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
             coalesce(CAST(floor(turn / 512.0) AS BIGINT), -1) AS block,
             row_number() OVER (ORDER BY conv_id, turn, role, text) AS n FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.*, p.speaker, role = speaker AS own,
        CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
             ELSE '<|user name=' || role || '|>' || chr(10) END AS head FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS part,
        coalesce(sum(length(head || text || '<|end|>' || chr(10))) OVER (PARTITION BY conv_id, block, speaker ORDER BY n
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r)
SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(part, '' ORDER BY n) AS text,
  coalesce(string_agg(CAST(CAST(off + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(off + length(part) AS BIGINT) AS VARCHAR), ','
    ORDER BY n) FILTER (WHERE own), '') AS mask,
  CAST(coalesce(sum(length(part) - length(head)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM s GROUP BY conv_id, speaker, block
"""
