"""Multi-party perspective rotation: each participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

SYSTEM, OURS, END = "system", "<|assistant|>\n", "<|end|>\n"
SPREAD = 64


def _other(role: Column, system: str) -> Column:
    """The head of a turn of another than the perspective."""
    name = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r'[<>|"\n]', "_")
    return F.when(role == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit('<|user name="'), name, F.lit('"|>\n')))


def rotate(turns: DataFrame, scratch: C.Scratch, system: str = SYSTEM) -> DataFrame:
    """Every dialogue of `turns` (conv_id, turn, role, text) once from the view of each participant.

    A result row is one turn in one view: conv_id, perspective, seq (0, 1, ... in the view), turn,
    speaker, segment (the turn as rendered), start (its place in the view's transcript, which is the
    segments in order of seq), mask_start and mask_end (what is learned of the transcript: the
    assistant's words and the end mark after them; null in other turns).

    The perspective's turns are rendered as the assistant's, those of role `system` as such, all
    others as users with their names. Participants are the roles other than system and null; a
    dialogue without any has no view. A null role speaks as user "unknown". A null text is empty. Turns
    are ordered by turn (null first), role, text; repeated rows are turns of their own. A null conv_id
    is one dialogue. Extra columns are ignored. An empty table gives an empty one.

    No dialogue is gathered. Turns are numbered within ranges of SPREAD turn numbers and written once;
    views and places are then made of their lengths alone, and meet the texts in one last join. A
    place is what all turns before take as others' turns, and for each of the perspective's own
    the difference between the two heads; both are sums in two levels over the ranges, so that a dialogue of a third of
    all rows is spread as well.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.withColumns({"part": F.coalesce(F.floor(F.col("turn") / SPREAD), F.lit(-(2**62))), "long": F.length(F.concat(_other(F.col("role"), system), "text", F.lit(END))).cast("long")})
    w = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text"))
    t = scratch.table(t.withColumns({"at": F.row_number().over(w), "own": F.sum("long").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("long")}), "turns")
    narrow = t.select("conv_id", "part", "at", "role", "own")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("conv_id", "part").agg(F.sum("long").alias("n"), F.count("*").alias("k"))
    parts = parts.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    people = narrow.where(F.col("role") != system).select(F.col("conv_id").alias("c3"), F.col("role").alias("perspective")).distinct()
    people = parts.join(people, F.col("c2").eqNullSafe(F.col("c3"))).drop("c3")  # for each range of the dialogue, so that its turns meet them range by range
    views = narrow.join(people, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
    views = views.select("conv_id", "perspective", "part", "at", F.col("role").eqNullSafe(F.col("perspective")).cast("long").alias("ours"), (F.col("first") + F.col("at") - 1).alias("seq"), (F.col("base") + F.col("own")).alias("place"))
    views = C.running_sum(views, ["conv_id", "perspective"], "part", ["at"], "ours", "mine")
    gain = F.lit(len(OURS)) - F.length(_other(F.col("perspective"), system))
    views = views.select(F.col("conv_id").alias("c4"), F.col("part").alias("p4"), F.col("at").alias("a4"), "perspective", "seq", (F.col("ours") == 1).alias("ours"), (F.col("place") + F.col("mine") * gain).cast("long").alias("start"))
    both = t.join(views, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("part") == F.col("p4")) & (F.col("at") == F.col("a4")))
    head = F.when(F.col("ours"), F.lit(OURS)).otherwise(_other(F.col("role"), system))
    both = both.withColumns({"head": head, "segment": F.concat(head, "text", F.lit(END))})
    begin, end = F.col("start") + F.length("head"), F.col("start") + F.length("segment") - 1
    mask = lambda c: F.when(F.col("ours"), c).cast("long")
    return both.select("conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", F.col("role").alias("speaker"), "segment", "start", mask(begin).alias("mask_start"), mask(end).alias("mask_end"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(C.read(spark, sf_dir, "conversations"), C.Scratch(spark, "chat"))


OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
h AS (SELECT t.*, p.perspective, t.role IS NOT DISTINCT FROM p.perspective AS ours,
  CASE WHEN t.role IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
  ELSE '<|user name="' || regexp_replace(coalesce(t.role, 'unknown'), '[<>|"\n]', '_', 'g') || '"|>' || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment, length(head || text || '<|end|>' || chr(10)) AS n FROM h),
w AS (SELECT *, (sum(n) OVER q - n)::BIGINT AS start, row_number() OVER q - 1 AS seq FROM s
  WINDOW q AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, seq, turn, role AS speaker, segment, start,
  CASE WHEN ours THEN start + length(head) END AS mask_start, CASE WHEN ours THEN start + n - 1 END AS mask_end
FROM w
"""
