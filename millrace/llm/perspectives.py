"""Multi-party dialogues as chat training data, once from every participant's side.

For each participant of a conversation, the dialogue is rendered with that speaker as ``assistant`` and all
others as named ``user``s; the loss mask covers what the assistant says, with its end mark. System turns are
system messages in every rendering and no participants. DataFrame operations only.

The result has a row for each turn of each rendering, with its text and its place in the rendering's
characters, so no task or row holds a whole conversation whose turns are numbered: offsets are sums over blocks of turns, then
within a block. Concatenating ``rendered`` by ``start`` gives the whole.

Defined results: a null role speaks as ``unknown``; a null text is empty; a null turn comes last; equal turns
are ordered by role, then text; repeated rows are turns of their own; turns with a null conv_id form one
conversation; a conversation of system turns only has no rendering; an empty table gives an empty result. Nothing
is escaped: marks and line breaks within a text or name stay as they are, so a trainer that reads marks must take turns
from ``start``, ``length`` and the mask's span, which such texts don't move, and not by parsing ``rendered``. Turns that are null or equal lie in
one block, so a conversation of only such turns, or all those with a null conv_id, has one task sort each of its perspectives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotate(turns: DataFrame, turns_a_block: int = 1024) -> DataFrame:
    """perspective, turn by turn: role, name, rendered, start, length and the span mask_start to mask_end where mask = 1."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = said.where("speaker <> 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    system = F.col("speaker") == "system"
    role = F.when(system, "system").when(own, "assistant").otherwise("user")
    name = F.when(~system & ~own, F.col("speaker"))
    head = F.concat(F.lit("<|im_start|>"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    each = each.withColumns({"role": role, "name": name, "head": F.length(head), "mask": own.cast("int"), "rendered": F.concat(head, F.col("text"), F.lit("<|im_end|>\n"))})
    each = each.withColumn("length", F.length("rendered").cast("bigint")).withColumn("block", F.floor(F.coalesce("turn", F.lit(2**62)) / turns_a_block))
    dialogue = ["conv_id", "perspective"]
    blocks = each.groupBy(*dialogue, "block").agg(F.sum("length").alias("size"))
    blocks = blocks.withColumn("before", F.sum("size").over(Window.partitionBy(*dialogue).orderBy("block")) - F.col("size"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), "before")
    order = [F.asc_nulls_last("turn"), "speaker", "text"]
    within = Window.partitionBy(*dialogue, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("within", F.sum("length").over(within) - F.col("length"))
    placed = each.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("before") + F.col("within")
    masked = lambda c: F.when(F.col("mask") == 1, c)
    return placed.select(
        *dialogue, "turn", "speaker", "role", "name", "rendered", start.alias("start"), "length", "mask",
        masked(start + F.col("head")).alias("mask_start"), masked(start + F.col("length") - 1).alias("mask_end"),
    )


ORACLE_SQL = """
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), speakers as (
  select distinct conv_id as of, speaker as perspective from said where speaker <> 'system'
), each as (
  select s.*, p.perspective,
    case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
    case when speaker <> 'system' and speaker <> perspective then speaker end as name
  from said s join speakers p on s.conv_id is not distinct from p.of
), headed as (
  select *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) as head from each
), placed as (
  select *, head || text || '<|im_end|>' || chr(10) as rendered, cast(length(head || text || '<|im_end|>' || chr(10)) as bigint) as length,
    cast(speaker = perspective as integer) as mask
  from headed
), summed as (
  select *, cast(sum(length) over (partition by conv_id, perspective order by turn nulls last, speaker, text rows unbounded preceding) - length as bigint) as start from placed
)
select conv_id, perspective, turn, speaker, role, name, rendered, start, length, mask,
  case when mask = 1 then start + length(head) end as mask_start, case when mask = 1 then start + length - 1 end as mask_end
from summed
"""
