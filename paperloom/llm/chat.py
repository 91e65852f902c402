"""Multi-party perspective rotation of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.ranks import running_sum, source_key

#: Turns rendered into one row; longer dialogues give several parts.
PART_TURNS = 64
#: Turn numbers of one ordering bucket.
TURN_BUCKET = 256
SYSTEM = "system"
END = "<|end|>"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Every dialogue of ``turns`` (conv_id, turn, role, text) once for each participant.

    Result: conv_id, perspective, part, offset, n_turns, n_own, n_chars,
    own_chars, rendered, masks.  The participant in ``perspective`` speaks as assistant,
    every other one as a user with its name, and system turns stay system turns
    (the system is no participant).  ``masks`` lists the [start, end) characters
    of ``rendered`` to train on: the assistant's words and its end mark.  A
    dialogue of more than ``part_turns`` turns is split into parts, so no task
    ever holds a whole long one.  ``masks`` count from the part's first
    character, ``offset`` is the number of the dialogue's characters before the
    part: the parts joined in order, with masks moved by their offsets, are the
    whole dialogue with its masks, whatever ``part_turns`` is.

    Turns are ordered by number (null last), then role and text.  A null role is
    the participant "unknown", a null text an empty one; repeated rows are turns
    of their own; conversations without id form one dialogue of their own.
    Control marks inside a text are broken up (``<|`` becomes ``< |``).
    Conversations of system turns only have no participant and give no row.
    Other columns are ignored.
    """
    rows = turns.select("conv_id", source_key(F.col("conv_id").cast("string")).alias("key"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURN_BUCKET), F.lit((1 << 62))))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    # in a file: the lengths of parts are summed from it without ordering the turns again
    placed = cut(running_sum(rows, ["key"], "bucket", order, F.lit(1), "place").drop("bucket"), "turns")
    speakers = rows.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("perspective")).distinct()
    seen = placed.join(speakers, "key")
    head = F.when(F.col("role") == F.col("perspective"), F.lit("<|assistant|>")).when(F.col("role") == SYSTEM, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>")))
    seen = seen.select("conv_id", "key", "perspective", F.expr(f"place div {part_turns}").alias("part"), "place", (F.col("role") == F.col("perspective")).alias("own"), F.concat(head, F.lit("\n")).alias("head"), F.concat("text", F.lit(END)).alias("body"))
    group = ["key", "perspective", "part"]
    seen = running_sum(seen, group[:-1], "part", [F.col("place")], F.length("head") + F.length("body") + 1, "before")
    made = seen.groupBy("conv_id", *group).agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "own", "before"))).alias("turns"), F.min("before").alias("offset"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    own = F.filter("turns", lambda t: t["own"])
    start = lambda t: t["before"] - F.col("offset") + F.length(t["head"])
    masks = F.transform(own, lambda t: F.struct(start(t).cast("int").alias("start"), (start(t) + F.length(t["body"])).cast("int").alias("end")))
    made = made.select("conv_id", "perspective", "part", "offset", F.size("turns").alias("n_turns"), rendered.alias("rendered"), masks.alias("masks"))
    return made.select("conv_id", "perspective", "part", "offset", "n_turns", F.size("masks").alias("n_own"), F.length("rendered").alias("n_chars"), F.aggregate("masks", F.lit(0), lambda a, m: a + m["end"] - m["start"]).alias("own_chars"), "rendered", "masks")
