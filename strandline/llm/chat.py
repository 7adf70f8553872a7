"""Preference pairs: the turns two conversations begin with alike, once, and their different ends with masks.

For each pair of a chosen and a rejected conversation, the longest common prefix of their turns (role and text) is
the prompt, rendered once; what follows is rendered as two completions, with a span of characters for each assistant
turn, which alone are learned from. Pairs are given as a table, or made by ``pairs_by_opening``: of conversations
that begin with the same turn the preferred one (most turns, then most characters, then least conv_id) is chosen over
every other one, so that a group of n gives n - 1 pairs.

Edge cases: turns with null conv_id belong to no conversation; a null role or text counts as empty; turns are ordered by
turn, then role and text, and of repeated turns (the same number, role and text) one counts; pairs with an unknown
conversation give no row; copies of a whole conversation give empty completions; texts of any length are rendered
whole; an empty table gives no pairs; other columns play no part, whatever their names. One conversation is one
value, so its own turns are gathered in one row; groups of conversations never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.scratch import stored

# How a turn is rendered.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n"
LEARNED = "assistant"


def rendered(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def learned_spans(turns: Column) -> Column:
    """Start and end, in the rendered text, of the texts of the assistant's turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(so_far: Column, turn: Column) -> Column:
        start = so_far["at"] + F.length(turn["role"]) + len(OPEN + AFTER_ROLE)
        end = start + F.length(turn["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == LEARNED, F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (turn, role, text) in order."""
    clean = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def pairs_by_opening(turns: DataFrame) -> DataFrame:
    """``chosen_id``, ``rejected_id`` of conversations that begin with the same turn."""
    rating = F.struct(
        F.size("turns").alias("n"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"])).alias("chars"),
        (-F.col("conv_id")).alias("least"),
    )
    first = F.col("turns")[0]
    rated = stored(conversations(turns).select("conv_id", F.sha2(F.to_json(F.struct(first["role"], first["text"])), 256).alias("opening"), rating.alias("rating")), "ratings")
    best = rated.groupBy("opening").agg((-F.max("rating")["least"]).alias("chosen_id"))
    return rated.join(best, "opening").filter("conv_id != chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``chosen_id``, ``rejected_id``, ``n_common``, ``prompt``, both completions and their learned spans."""
    told = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = stored(conversations(turns).select("conv_id", told.alias("turns")), "conversations")
    side = lambda name: whole.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    both = pairs.select("chosen_id", "rejected_id").distinct().join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")
    # Where one is longer, the shorter one's missing turn is null and ends the prefix.
    alike = F.transform(F.arrays_zip(F.col("chosen").alias("a"), F.col("rejected").alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    differ = F.array_position(alike, False)
    both = both.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(F.size(alike)).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return both.select(
        "chosen_id",
        "rejected_id",
        "n_common",
        rendered(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen_completion"),
        learned_spans(rest("chosen")).alias("chosen_spans"),
        rendered(rest("rejected")).alias("rejected_completion"),
        learned_spans(rest("rejected")).alias("rejected_spans"),
    )
