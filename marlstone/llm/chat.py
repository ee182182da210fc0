"""Chat formatting by perspective rotation.

Every participant of a dialogue (a speaker whose role is no system role) gets a
rendering of the whole dialogue in which that participant is the assistant, the
others are named users and system turns stay system turns.  The mask lists the
character spans to learn from: the assistant's texts with their end marks.

A turn is rendered as `<|im_start|>HEADER\\nTEXT<|im_end|>\\n`, HEADER being
`assistant`, `user name=SPEAKER` or `system`.  A mark inside a text or a name is
broken by a space (`<|im_` becomes `< |im_`), so no text can forge a turn.

Long dialogues.  A line's place is the number of characters before it as someone who
never speaks would see the dialogue; a row of the result has the lines of one
perspective whose places divided by `part_chars` have the same whole part.  A dialogue
of up to `part_chars` characters is thus one row.  Of a longer one, which may hold a
third of all rows, each part is a row and a unit of work; `start` says where the part's text
begins in the whole rendering, and mask spans count from the start of the whole rendering, so
parts joined in order are the rendering and its mask.  Places come from a range partitioning,
which divides one conversation, one turn number and one repeated row alike.

Defined results.  Turns are ordered by turn number (null first), speaker and the MD5
sum of the text; repeated rows are repeated turns.  A null or blank role is the speaker
`unknown`; a null text is empty; a null conv_id is one conversation.  A dialogue
with system turns only has no participant and gives no rows.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ESCAPED, ESCAPE = "<|im_", "< |im_"
SYSTEM_ROLES = ("system",)
PART_CHARS = 1 << 18


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(ESCAPE))


def _header(system: Column, speaker: Column, own: Column | None = None) -> Column:
    others = F.when(system, "system").otherwise(F.concat(F.lit("user name="), speaker))
    return others if own is None else F.when(own, "assistant").otherwise(others)


def _in_parts(said: DataFrame, part_chars: int) -> DataFrame:
    """said with the column part."""
    ordered = said.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "speaker", "tie", "row")
    slices = materialize(ordered.withColumn("slice", F.spark_partition_id()), "chat-slices")
    sums = slices.groupBy("conv_id", "slice").agg(F.sum("chars").alias("sum"))  # a row for each conversation and task
    before = sums.select(F.col("conv_id").alias("of"), F.col("slice").alias("of_slice"), (F.sum("sum").over(Window.partitionBy("conv_id").orderBy("slice")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn", "speaker", "tie", "row")
    placed = slices.withColumn("place", F.sum("chars").over(inside) - F.col("chars"))
    placed = placed.join(before, placed.conv_id.eqNullSafe(before["of"]) & (placed.slice == before["of_slice"]))
    return placed.withColumn("part", F.floor((F.col("before") + F.col("place")) / part_chars)).select(*said.columns, "part")


def _starts(said: DataFrame) -> DataFrame:
    """(of, in_part, perspective, start) for every part and every speaker of its conversation."""
    spoken = said.groupBy("conv_id", "part", "speaker", "system").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    parts = spoken.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = spoken.where(~F.col("system")).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    each = parts.join(speakers, parts.conv_id.eqNullSafe(speakers["of"])).select("of", F.col("part").alias("in_part"), "perspective", "chars")
    own = spoken.where(~F.col("system")).select("conv_id", "part", "speaker", "n")
    each = each.join(own, each["of"].eqNullSafe(own.conv_id) & (each.in_part == own.part) & (each.perspective == own.speaker), "left")
    shorter = F.length(F.concat(F.lit("user name="), "perspective")) - len("assistant")
    size = F.col("chars") - F.coalesce("n", F.lit(0)) * shorter
    upto = F.sum(size).over(Window.partitionBy("of", "perspective").orderBy("in_part"))  # a row for each part
    return each.select("of", "in_part", "perspective", (upto - size).alias("start"))


def rotate_perspectives(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: Sequence[str] = SYSTEM_ROLES,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(conv_id, perspective, part, start, n_turns, text, mask): mask is an array of (start, stop) character spans."""
    role = F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit("")))
    text = _clean(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        _clean(F.when(role == "", "unknown").otherwise(role)).alias("speaker"),
        role.isin(*system_roles).alias("system"),
        text.alias("said"),
        F.md5(text).alias("tie"),
    ).withColumn("chars", F.length("said") + F.length(_header(F.col("system"), F.col("speaker"))) + len(OPEN) + 1 + len(CLOSE))
    line = F.struct("turn", "speaker", "tie", "said", "system")
    long = materialize(said.groupBy("conv_id").agg(F.sum("chars").alias("chars")).where(F.col("chars") > part_chars).select(F.col("conv_id").alias("of")), "chat-long")
    here = said.conv_id.eqNullSafe(long["of"])
    whole = said.join(long, here, "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("turns"))
    names = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["system"]), lambda t: t["speaker"]))
    seen = whole.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"), F.explode(names).alias("perspective"), "turns")
    if not long.isEmpty():
        cut = materialize(_in_parts(said.join(long, here, "left_semi"), part_chars), "chat-parts")
        parts, starts = cut.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(line)).alias("turns")), _starts(cut)
        cut = parts.join(starts, parts.conv_id.eqNullSafe(starts["of"]) & (parts.part == starts.in_part))
        seen = seen.unionByName(cut.select("conv_id", "part", "start", "perspective", "turns"))

    def rendered(t: Column) -> Column:
        own = ~t["system"] & (t["speaker"] == F.col("perspective"))
        head = F.concat(F.lit(OPEN), _header(t["system"], t["speaker"], own), F.lit("\n"))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.concat(head, t["said"], F.lit(CLOSE)).alias("text"))

    drawn = seen.withColumn("drawn", F.transform("turns", rendered))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(state: Column, t: Column) -> Column:
        start, stop = state["at"] + t["head"], state["at"] + F.length(t["text"])
        span = F.struct(start.alias("start"), (stop - 1).alias("stop"))  # the line end after the mark is no part of the turn
        return F.struct(stop.alias("at"), F.when(t["own"], F.concat(state["mask"], F.array(span))).otherwise(state["mask"]).alias("mask"))

    mask = F.aggregate("drawn", F.struct(F.col("start").alias("at"), nothing.alias("mask")), add, lambda s: s["mask"])
    return drawn.select(
        "conv_id", "perspective", "part", "start", F.size("drawn").alias("n_turns"), F.array_join(F.transform("drawn", lambda t: t["text"]), "").alias("text"), mask.alias("mask")
    )


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")


def chat_sql() -> str:
    """The rows of rotate_perspectives, its mask as text, in DuckDB SQL over `conversations`."""
    clean = f"replace({{}}, '{ESCAPED}', '{ESCAPE}')"
    return f"""
WITH said AS (
  SELECT *, sum(length('{OPEN}') + length(CASE WHEN is_system THEN 'system' ELSE 'user name=' || speaker END) + 1 + length(said) + {len(CLOSE)}) OVER w
    - (length('{OPEN}') + length(CASE WHEN is_system THEN 'system' ELSE 'user name=' || speaker END) + 1 + length(said) + {len(CLOSE)}) AS before,
    row_number() OVER w AS place
  FROM (SELECT conv_id, turn, {clean.format("CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END")} AS speaker,
    trim(coalesce(role, '')) IN ({", ".join(f"'{r}'" for r in SYSTEM_ROLES)}) AS is_system, {clean.format("coalesce(text, '')")} AS said FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(said) ROWS UNBOUNDED PRECEDING)),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE NOT is_system),
seen AS (
  SELECT s.*, p.perspective, before // {PART_CHARS} AS part, NOT is_system AND speaker = p.perspective AS own,
    '{OPEN}' || CASE WHEN is_system THEN 'system' WHEN speaker = p.perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
drawn AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS line FROM seen),
placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS UNBOUNDED PRECEDING) AS stop FROM drawn)
SELECT conv_id, perspective, part::BIGINT AS part, min(stop - length(line))::BIGINT AS "start", count(*)::INTEGER AS n_turns, string_agg(line, '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(line) + length(head))::BIGINT::VARCHAR || '-' || (stop - 1)::BIGINT::VARCHAR END, ',' ORDER BY place), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
