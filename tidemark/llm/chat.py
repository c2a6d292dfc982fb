"""Multi-party perspective rotation: a dialogue, once from each participant's seat.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the loss mask covers the assistant's turns. ``system``
turns are no participant's: they stay as they are in every rendering.

``rotate`` gives one row for each turn of each rendering, with its place in the rendered text, so
that even a conversation with most of the rows is spread over many tasks: places come from prefix
sums over ranges of turns. ``rendered`` puts renderings together as texts with spans, for
conversations that fit a row.

Defined cases: a null role is the speaker ``unknown``; a null text is empty; turns with equal numbers
are ordered by role and text, and repeated rows are repeated turns; a null turn comes first; rows
without conv_id are one conversation; a conversation of system turns alone has no rendering; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Turns of one conversation that share a range, that is, a task.
RANGE = 256


def _user_head(role: Column) -> Column:
    return F.concat(F.lit("<|user name="), role, F.lit("|>\n"))


_ASSISTANT, _SYSTEM = "<|assistant|>\n", "<|system|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """The turns with key (never null), range, and base: a turn's size where it isn't the assistant's."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head = F.when(F.col("role") == "system", F.lit(_SYSTEM)).otherwise(_user_head(F.col("role")))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    rows = rows.withColumn("range", F.expr(f"coalesce(turn, -1) div {RANGE}"))
    return rows.withColumn("base", (F.length(head) + F.length("text") + 1).cast("long"))


def seats(rows: DataFrame) -> DataFrame:
    """key, range, chars and turns before the range, and each speaker's own turns before it. Texts take no part."""
    counts = rows.groupBy("key", "range", "role").agg(F.count("*").alias("n"), F.sum("base").alias("base"))
    run = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("key", "range").agg(F.sum("n").alias("n"), F.sum("base").alias("base"))
    ranges = ranges.select("key", "range", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("turns"), F.coalesce(F.sum("base").over(run), F.lit(0)).alias("chars"))
    speakers = counts.filter("role <> 'system'").select("key", F.col("role").alias("speaker")).distinct()
    own = counts.select("key", "range", F.col("role").alias("speaker"), "n")
    upto = Window.partitionBy("key", "speaker").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = ranges.select("key", "range").join(speakers, "key").join(own, ["key", "range", "speaker"], "left")
    each = each.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    each = each.groupBy("key", "range").agg(F.collect_list(F.struct("speaker", "before")).alias("seats"))
    return ranges.join(each, ["key", "range"])


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, nth, rendered_role, name, segment, start, end, mask_start, mask_end.

    Places count characters of the rendered text; mask_start and mask_end are null where the turn
    isn't the assistant's. A text is shuffled once, however many speakers there are: a place is that
    of a rendering without assistant, less what the speaker's own shorter or longer headers change.
    """
    rows = turns_of(conversations)
    inner = Window.partitionBy("key", "range").orderBy("turn", "role", "text")
    ahead = inner.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in", F.coalesce(F.sum("base").over(ahead), F.lit(0))).withColumn("k", F.row_number().over(inner) - 1).withColumn("roles", F.collect_list("role").over(ahead))
    seated = placed.join(seats(rows), ["key", "range"]).select("*", F.explode("seats").alias("seat")).withColumn("speaker", F.col("seat.speaker"))
    own = F.col("role") == F.col("speaker")
    mine = F.col("seat.before") + F.size(F.filter("roles", lambda r: r == F.col("speaker")))
    change = F.lit(len(_ASSISTANT)) - F.length(_user_head(F.col("speaker")))
    start = (F.col("chars") + F.col("in") + mine * change).cast("long")
    head = F.when(F.col("role") == "system", F.lit(_SYSTEM)).when(own, F.lit(_ASSISTANT)).otherwise(_user_head(F.col("role")))
    segment = F.concat(head, F.col("text"), F.lit("\n"))
    return seated.select(
        "conv_id", "speaker", "turn", (F.col("turns") + F.col("k")).cast("long").alias("nth"),
        F.when(F.col("role") == "system", "system").when(own, "assistant").otherwise("user").alias("rendered_role"),
        F.when(~own & (F.col("role") != "system"), F.col("role")).alias("name"),
        segment.alias("segment"), start.alias("start"), (start + F.length(segment)).alias("end"),
        F.when(own, start + F.length(head)).alias("mask_start"), F.when(own, start + F.length(segment)).alias("mask_end"),
    )


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, text, spans (mask_start, mask_end): one row for each rendering. A rendering must fit a row."""
    turns = F.array_sort(F.collect_list(F.struct("nth", "segment", "mask_start", "mask_end")))
    out = rotate(conversations).groupBy("conv_id", "speaker").agg(turns.alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return out.select("conv_id", "speaker", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), spans.alias("spans"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all renderings, with a checksum for the segment."""
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("segment_md5", F.md5(F.encode("segment", "utf-8"))).drop("segment")


QUERIES = {"op3_perspective_rotation": op3_perspective_rotation}
SQL = {
    "op3_perspective_rotation": r"""
with r as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
s as (select distinct conv_id, role as speaker from r where role <> 'system'),
j as (select r.*, speaker, case when role = 'system' then '<|system|>' when role = speaker then '<|assistant|>' else '<|user name='||role||'|>' end || chr(10) as head
      from r join s on r.conv_id is not distinct from s.conv_id),
p as (select *, row_number() over o - 1 as nth, coalesce(sum(length(head) + length(text) + 1) over (partition by conv_id, speaker order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from j window o as (partition by conv_id, speaker order by turn nulls first, role, text))
select conv_id, speaker, turn, nth, case when role = 'system' then 'system' when role = speaker then 'assistant' else 'user' end as rendered_role,
  case when role <> speaker and role <> 'system' then role end as name, start, start + length(head) + length(text) + 1 as "end",
  case when role = speaker then start + length(head) end as mask_start, case when role = speaker then start + length(head) + length(text) + 1 end as mask_end,
  md5(head || text || chr(10)) as segment_md5
from p
""",
}
