"""Chat formatting (operator 4): multi-party perspective rotation.

Column functions only.  For every participant the dialogue is rendered with that speaker as the assistant and the others as
named users; masks are the character spans of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a part: a long conversation is rendered in parts of consecutive turns, so that no row or task holds it whole.
PART_TURNS = 1024
SYSTEM = "system"
NOBODY = "unknown"
# The marks around a turn.
BEGIN = "<|im_start|>"
END = "<|im_end|>\n"


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv, speaker, part, n_turns, start, text, masks.

    Participants are the distinct speakers except ``system``, whose turns stay system turns.  ``text`` is the part's
    rendering, ``start`` the place of its first character in the whole rendering, ``masks`` the spans ``start:end``
    (code points of the whole rendering, end exclusive, comma-joined) of the participant's words and their end mark.

    Turns are in order of number, then speaker, then text; a part has the turns of ``part_turns`` consecutive numbers.
    Null speakers are ``unknown``, null texts empty, null turn numbers come last in a part of their own, null conversations
    are one conversation.  Whole copies of a turn count once.  A conversation of system turns only has no row.
    """
    c = F.col
    rows = turns.select(
        c(conv_col).alias("conv"),
        F.floor(c(turn_col) / part_turns).cast("long").alias("part"),
        c(turn_col).alias("turn"),
        F.coalesce(c(role_col).cast("string"), F.lit(NOBODY)).alias("by"),
        F.coalesce(c(text_col), F.lit("")).alias("said"),
    ).distinct()
    people = rows.where(c("by") != SYSTEM).select(c("conv").alias("of"), c("by").alias("speaker")).distinct()
    told = rows.join(people, rows["conv"].eqNullSafe(people["of"])).drop("of")
    own = c("by") == c("speaker")
    head = F.when(c("by") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), c("by")))
    told = told.withColumn("head", F.concat(F.lit(BEGIN), head, F.lit("\n"))).withColumn("last", c("turn").isNull())
    one = F.struct("last", "turn", "by", "said", "head", own.alias("own"))
    parts = told.groupBy("conv", "speaker", "part").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    texts = F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<a:bigint,b:bigint>>)").alias("spans"))

    def step(a, t):
        begin = a["at"] + F.char_length(t["head"])
        end = begin + F.char_length(t["said"]) + len(END)
        span = F.struct(begin.alias("a"), end.alias("b"))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    rendered = parts.select("conv", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(texts, "").alias("text"), F.aggregate("turns", zero, step).alias("m"))
    before = Window.partitionBy("conv", "speaker").orderBy(c("part").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rendered.select("conv", "speaker", "part", "n_turns", "text", "m.spans", c("m.at").alias("size"))
    placed = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    masks = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", (s["a"] + c("start")).cast("string"), (s["b"] + c("start")).cast("string"))), ",")
    return placed.select(c("conv").alias(conv_col), "speaker", "part", "n_turns", "start", "text", masks.alias("masks"))
