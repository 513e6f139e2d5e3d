"""Chat formatting: multi-party perspective rotation, with DataFrame functions only.

Every speaker (role) of a conversation in turn becomes the assistant.  For that perspective the
dialogue is rendered in turn order: the speaker's turns as ``assistant``, all others as
``user name=<role>``; the mask marks the spans (start, length in characters) of the assistant's
contents and end marks, on which a model would be trained.

A turn is masked in its own role's perspective only, where all headers before it are as in the plain dialogue but for those of the
role's earlier turns, each shorter or longer by one constant.  So one window a conversation, in turn order, gives every span;
no perspective folds over its turns.  The turns and the spans of a conversation are then packed side by side, so it is shuffled once
however many speakers it has.  Each result holds a whole dialogue, which is one training example; nothing else is gathered.

Edge cases: null texts render as empty; a null role speaks as ``unknown``, but is a participant of its own (its perspective is null)
beside one of that name; turns with equal numbers are ordered by role, then text, nulls first; repeated rows are repeated turns; a row
without conv_id is a conversation of one turn, as nothing tells what it belongs to (so they meet in no task); no rows give no
rows.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, n_turns, n_masked (turns trained on), rendered, mask (array of start, length)."""
    named = lambda c: F.col(f"`{c}`")
    said = conversations.select(named(conv).alias("conv_id"), named(turn).alias("turn"), named(role).alias("role"), F.coalesce(named(text), F.lit("")).alias("text"))
    own, other = F.lit(OPEN + "assistant\n"), lambda r: F.concat(F.lit(OPEN + "user name="), F.coalesce(r, F.lit(UNKNOWN)), F.lit("\n"))
    body = F.concat(F.col("text"), F.lit(CLOSE))
    said = said.select("*", other(F.col("role")).alias("head"), body.alias("body"))

    def packed(rows: DataFrame, before: Column, earlier: Column) -> DataFrame:
        """Rows with the length of the plain dialogue before them and the number of the role's earlier turns."""
        start = before + earlier * (F.length(own) - F.length("head")) + F.length(own)
        return rows.select("conv_id", F.struct("turn", "role", "text", "head", "body", start.cast("int").alias("start")).alias("said"))

    together, order = Window.partitionBy("conv_id"), ["turn", "role", "text"]
    so_far = F.sum(F.length("head") + F.length("body")).over(together.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")) - 1
    placed = said.where("conv_id IS NOT NULL").withColumn("so_far", F.coalesce(so_far, F.lit(0))).withColumn("nth", nth)
    whole = packed(placed, F.col("so_far"), F.col("nth")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    alone = packed(said.where("conv_id IS NULL"), F.lit(0), F.lit(0)).select("conv_id", F.array("said").alias("turns"))
    whole = whole.union(alone)
    each = whole.select("conv_id", "turns", F.explode(F.array_distinct(F.transform("turns", lambda t: t["role"]))).alias("perspective"))
    is_own = lambda t: t["role"].eqNullSafe(F.col("perspective"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(F.when(is_own(t), own).otherwise(t["head"]), t["body"])), "")
    mask = F.transform(F.filter("turns", is_own), lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).alias("length")))
    return each.select("conv_id", "perspective", F.size("turns").cast("long").alias("n_turns"), F.size(mask).cast("long").alias("n_masked"), rendered.alias("rendered"), mask.alias("mask"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["length"])
    trained = F.array_join(F.transform("mask", lambda m: F.substring("rendered", m["start"] + 1, m["length"])), "")
    return out.select("conv_id", "perspective", "n_turns", "n_masked", F.length("rendered").cast("long").alias("n_chars"), masked.alias("n_masked_chars"), F.sha2(F.col("rendered"), 256).alias("rendered_sha256"), F.sha2(trained, 256).alias("trained_sha256"), "rendered")


OP5_SQL = """
WITH s AS (SELECT CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT alone, conv_id, role AS perspective FROM s),
r AS (
  SELECT p.alone, p.conv_id, p.perspective, s.turn, s.role, s.text, s.role IS NOT DISTINCT FROM p.perspective AS own,
    CASE WHEN s.role IS NOT DISTINCT FROM p.perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || coalesce(s.role, 'unknown') || chr(10) END AS head,
    s.text || '<|im_end|>' || chr(10) AS body
  FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.alone IS NOT DISTINCT FROM p.alone)
SELECT conv_id, perspective, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE own)::BIGINT AS n_masked,
  sum(length(head || body))::BIGINT AS n_chars, sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS n_masked_chars,
  sha256(string_agg(head || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS rendered_sha256,
  sha256(string_agg(CASE WHEN own THEN body ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS trained_sha256,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rendered
FROM r GROUP BY alone, conv_id, perspective
"""
