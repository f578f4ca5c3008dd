"""Chat transcripts folded into prompt text, in parts of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS_PER_PART = 64
CHAT_PREAMBLE = "You explain security terms, phishing patterns and web-security tips."


def transcript_line(role: str = "role", text: str = "text"):
    """Fixed format of a line: the user's turns read ``User:``, all others ``Assistant:``."""
    speaker = F.when(F.col(role) == "user", "User").otherwise("Assistant")
    return F.concat(speaker, F.lit(": "), F.coalesce(text, F.lit("")))


def fold_transcripts(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, n_lines, transcript): lines in turn order, ``\\n`` after each.

    A part covers a fixed range of turns, so a conversation of any length spreads over
    many groups of at most ``turns_per_part`` lines. Its parts in order are its text.
    """
    part = F.floor(F.col("turn") / turns_per_part) + 1
    lines = turns.select("conv_id", part.alias("part"), F.struct("turn", transcript_line().alias("line")).alias("l"))
    folded = lines.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n"))
    return folded.select("conv_id", "part", F.size("ls").cast("bigint").alias("n_lines"), text.alias("transcript"))


def chat_prompts(
    turns: DataFrame, messages: DataFrame, preamble: str = CHAT_PREAMBLE, turns_per_part: int = TURNS_PER_PART
) -> DataFrame:
    """Prompt parts per (conv_id, message): preamble, history and the open question.

    Part 0 is the preamble, the last part the new message; all parts of a conversation
    in order are its prompt.
    """
    last_part = F.floor(F.max("turn") / turns_per_part) + 2
    ends = turns.groupBy("conv_id").agg(last_part.alias("part"))
    closing = messages.join(ends, "conv_id", "left").select(
        "conv_id",
        F.coalesce("part", F.lit(1)).cast("bigint").alias("part"),
        F.lit(1).cast("bigint").alias("n_lines"),
        F.concat(F.lit("User: "), F.col("message"), F.lit("\nAssistant:")).alias("transcript"),
    )
    opening = messages.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("part"),
        F.lit(0).cast("bigint").alias("n_lines"),
        F.lit(preamble + "\n\n").alias("transcript"),
    )
    history = fold_transcripts(turns, turns_per_part).join(messages.select("conv_id"), "conv_id", "left_semi")
    return opening.unionByName(history).unionByName(closing)
