"""Preference formatting of conversations, in DataFrame functions only.

Method: chosen and rejected conversations of a pair are laid side by side by turn position; the longest common
turn prefix is the turns before the first position at which role or text differ or one side has ended. It is
rendered once as the prompt; what follows on each side is that side's completion, with a mask of the code-point
spans [start, end) that carry loss: the text and end marker of assistant turns.

All windows and the final grouping share one exchange by the pair id, whose turns meet in one row anyway,
because a rendered conversation is one string.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role counts as 'user', a null text
as empty; rows with a null id form one conversation; equal conversations have an empty completion on both
sides, one that is a prefix of the other has one on its side; repeated rows are turns of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Markers around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def _rendered() -> Column:
    return F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))


def _joined(when: Column, value: str) -> Column:
    """The values of rows that meet the condition, in order of position."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", F.col(value).alias("v"))))), lambda x: x["v"])


def format_sides(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side 'chosen' or 'rejected', pos from 1, role, text) → one row per pair."""
    within = Window.partitionBy("pair_id", "side").orderBy("pos")
    pair = Window.partitionBy("pair_id")
    across = pair.orderBy("pos", "side")
    same = lambda near: (near("pos").over(across) == F.col("pos")) & (near("role").over(across) == F.col("role")) & (near("text").over(across) == F.col("text"))
    rows = (
        turns.withColumn("twin", F.coalesce(F.when(F.col("side") == "chosen", same(F.lead)).otherwise(same(F.lag)), F.lit(False)))
        .withColumn("common", F.coalesce(F.min(F.when(~F.col("twin"), F.col("pos"))).over(pair) - 1, F.max("pos").over(pair)))
        .withColumn("turn_text", _rendered())
        .withColumn("own", F.when(F.col("pos") > F.col("common"), F.char_length("turn_text")).otherwise(0))
        .withColumn("end", F.sum("own").over(within))
        .withColumn("start", F.col("end") - F.char_length("text") - (len(END) + 1))
        .withColumn("span", F.when(F.col("role") == "assistant", F.concat_ws(":", F.col("start").cast("string"), (F.col("end") - 1).cast("string"))))
    )
    side = lambda name: (F.col("side") == name) & (F.col("pos") > F.col("common"))
    text = lambda when: F.concat_ws("", _joined(when, "turn_text"))
    spans = lambda name: F.concat_ws(",", _joined(side(name), "span"))
    return rows.groupBy("pair_id").agg(
        F.first("common").cast("long").alias("n_prompt_turns"),
        text((F.col("side") == "chosen") & (F.col("pos") <= F.col("common"))).alias("prompt"),
        text(side("chosen")).alias("chosen"), spans("chosen").alias("chosen_mask"),
        text(side("rejected")).alias("rejected"), spans("rejected").alias("rejected_mask"),
    )


def _ordered(turns: DataFrame, *keys: str) -> DataFrame:
    clean = turns.withColumns({"role": F.coalesce("role", F.lit("user")), "text": F.coalesce("text", F.lit(""))})
    return clean.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("turn"), "role", "text")))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Two tables (pair_id, turn, role, text) of the chosen and the rejected conversation of each pair."""
    sides = [df.select("pair_id", F.lit(name).alias("side"), "turn", "role", "text") for df, name in ((chosen, "chosen"), (rejected, "rejected"))]
    both = sides[0].unionByName(sides[1]).repartition("pair_id")
    return format_sides(_ordered(both, "pair_id", "side"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen as it is; rejected with the last assistant turn replaced by the assistant
    turn before it, or left out where there is none. Without an assistant turn both sides are equal."""
    turns = _ordered(conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"), "pair_id")
    before = Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "assistant", F.col("text"))
    turns = turns.withColumns({
        "last": F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(Window.partitionBy("pair_id")) == F.col("pos"), F.lit(False)),
        "earlier": F.last(said, ignorenulls=True).over(before),
    })
    sides = turns.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    changed = F.col("last") & (F.col("side") == "rejected")
    sides = sides.where(~changed | F.col("earlier").isNotNull()).withColumn("text", F.when(changed, F.col("earlier")).otherwise(F.col("text")))
    again = Window.partitionBy("pair_id", "side").orderBy("pos")
    return sides.select("pair_id", "side", F.row_number().over(again).alias("pos"), "role", "text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_sides(reply_pairs(table(spark, sf_dir, "conversations"))).withColumnRenamed("pair_id", "conv_id")


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations),
a AS (
  SELECT *, coalesce(pos = max(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY conv_id), false) AS last,
         last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER
           (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM t),
r AS (
  SELECT conv_id, role, CASE WHEN last THEN earlier ELSE text END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS pos
  FROM a WHERE NOT last OR earlier IS NOT NULL),
m AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
         min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.pos, r.pos) END) - 1 AS differ, max(coalesce(c.pos, r.pos)) AS whole
  FROM a c FULL JOIN r ON c.conv_id = r.conv_id AND c.pos = r.pos GROUP BY 1),
s AS (
  SELECT conv_id, 'chosen' AS side, pos, role, text FROM a UNION ALL SELECT conv_id, 'rejected', pos, role, text FROM r),
p AS (
  SELECT s.*, coalesce(differ, whole) AS common, '{START}' || role || chr(10) || text || '{END}' || chr(10) AS full_text
  FROM s JOIN m USING (conv_id)),
e AS (
  SELECT *, sum(CASE WHEN pos > common THEN length(full_text) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY pos) AS fin FROM p),
g AS (
  SELECT *, CASE WHEN role = 'assistant' THEN cast(fin - length(text) - {len(END) + 1} AS varchar) || ':' || cast(fin - 1 AS varchar) END AS span FROM e)
SELECT conv_id, cast(any_value(common) AS bigint) AS n_prompt_turns,
       coalesce(string_agg(full_text, '' ORDER BY pos) FILTER (side = 'chosen' AND pos <= common), '') AS prompt,
       coalesce(string_agg(full_text, '' ORDER BY pos) FILTER (side = 'chosen' AND pos > common), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'chosen' AND pos > common), '') AS chosen_mask,
       coalesce(string_agg(full_text, '' ORDER BY pos) FILTER (side = 'rejected' AND pos > common), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'rejected' AND pos > common), '') AS rejected_mask
FROM g GROUP BY conv_id
"""
