"""Chat formatting with multi-party perspective rotation.

Each speaker of a conversation is the assistant once: the dialogue is rendered with that speaker's
turns as the assistant's and everyone else's as a named user's, and masks mark the characters to
learn from. System turns keep their role and are nobody's perspective. A rendering comes in consecutive pieces of
``part_turns`` turn numbers, so that a conversation of any length is many small groups: put together in the order of
their parts, the pieces are the whole dialogue, and masks count characters from its start. Turns are gathered once and
rotated after the shuffle: the copies for the speakers never cross the network. Where a piece starts follows from the
lengths of the pieces before it, which are one small row for each of a conversation's parts and speakers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import written

PART_TURNS = 256
ASSISTANT, END = "<|assistant|>\n", "<|end|>\n"


def escaped(role: Column) -> Column:
    """A role that cannot end its header: without line breaks and the marks of headers."""
    return F.regexp_replace(F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), r"[\r\n]", " ")


def _header(role: Column) -> Column:
    """The header of a turn of somebody else."""
    return F.when(role == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped(role), F.lit("|>\n")))


def _before(said: DataFrame, speakers: DataFrame) -> DataFrame | None:
    """(_k, _p, _m, _before): of conversations with several parts, the characters before each part for each speaker; None if
    there are no such conversations. Lengths alone are summed: a row for each of a conversation's parts and roles."""
    several = said.groupBy("_conv").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_lo < _hi").select(F.col("_conv").alias("_l"))
    several = written(several, "long-dialogues")
    if several.isEmpty():
        return None
    same = lambda c: F.col("_conv").eqNullSafe(F.col(c))
    lengths = said.join(several, same("_l"), "left_semi").groupBy("_conv", "part", "_role").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("_text")).alias("_chars"))
    whole = lengths.groupBy("_conv", "part").agg(F.sum(F.col("_chars") + F.col("_n") * (len(END) + F.length(_header(F.col("_role"))))).alias("_all"))
    gain = (F.length(_header(F.col("_role"))) - len(ASSISTANT)) * F.col("_n")
    own = lengths.filter("_role <> 'system'").select(F.col("_conv").alias("_oc"), F.col("part").alias("_om"), F.col("_role").alias("_op"), gain.alias("_gain"))
    each = whole.join(speakers, same("_c")).join(own, same("_oc") & (F.col("part") == F.col("_om")) & (F.col("perspective") == F.col("_op")), "left")
    earlier = Window.partitionBy("_conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.col("_all") - F.coalesce("_gain", F.lit(0))).over(earlier)
    return each.select(F.col("_conv").alias("_k"), F.col("perspective").alias("_p"), F.col("part").alias("_m"), size.alias("_before")).filter("_before > 0")


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, perspective, part, n_turns, n_own, text, masks): a consecutive piece of the dialogue as rendered for a
    speaker of the conversation; ``masks`` are the spans [start, end) of characters of the whole rendering that the
    speaker wrote in it, end marks included, as start-end joined by commas.

    Parts are numbered by turn // part_turns; a conversation with turns below ``part_turns`` is one
    part, 0. Rows of the same turn stand in the order of role and text, repeated rows are kept. A null
    text is empty; a null role is the speaker ``unknown``; a null turn counts as the first, in part 0;
    rows with a null conversation are one conversation, null. ``<|`` inside a text becomes ``< |``, so that
    no text can end its own turn; in a role, ``|>`` and line breaks are replaced, too, so that it cannot end its header.
    A conversation of system turns only has no rows; other columns are not read.
    """
    said = df.select(
        F.col(conv_col).alias("_conv"),
        F.coalesce(F.floor(F.col(turn_col) / F.lit(part_turns)), F.lit(0)).cast("long").alias("part"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("_role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("_text"),
    )
    parts = said.groupBy("_conv", "part").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    speakers = said.filter("_role <> 'system'").select(F.col("_conv").alias("_c"), F.col("_role").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("_conv").eqNullSafe(F.col("_c")))
    head: Column = lambda t: F.when(t["_role"] == F.col("perspective"), F.lit(ASSISTANT)).otherwise(_header(t["_role"]))
    pieces = F.transform("_turns", lambda t: F.struct(head(t).alias("h"), F.concat(t["_text"], F.lit(END)).alias("t"), (t["_role"] == F.col("perspective")).alias("own")))

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["h"])
        end = start + F.length(p["t"])
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(F.struct(start.alias("s"), end.alias("e"))))).otherwise(a["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"))
    found = both.withColumn("_pieces", pieces).withColumn("_placed", F.aggregate("_pieces", start, add))
    sizes = _before(said, speakers)
    if sizes is None:
        placed, before = found, F.lit(0)
    else:
        placed = found.join(sizes, F.col("_conv").eqNullSafe(F.col("_k")) & (F.col("perspective") == F.col("_p")) & (F.col("part") == F.col("_m")), "left")
        before = F.coalesce("_before", F.lit(0))
    spans = F.transform("_placed.spans", lambda x: F.concat((before + x["s"]).cast("string"), F.lit("-"), (before + x["e"]).cast("string")))
    return placed.select(
        F.col("_conv").alias(conv_col),
        "perspective",
        "part",
        F.size("_turns").cast("long").alias("n_turns"),
        F.size("_placed.spans").cast("long").alias("n_own"),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["h"], p["t"])), "").alias("text"),
        F.array_join(spans, ",").alias("masks"),
    )
