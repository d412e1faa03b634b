"""Chat logs as rows: history, counters and the message list of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.operators.skew import rank_in_group, running_total


def interaction_count(log: DataFrame) -> DataFrame:
    """Add the running number of user turns of the session, rejected ones included."""
    asked = F.when(F.col("role") == "user", 1).otherwise(0).cast("bigint")
    return running_total(log, "conv_id", "turn", asked, "interaction_count")


def chat_history(log: DataFrame) -> DataFrame:
    """Ordered messages of each session as rows (conv_id, position, role, content).

    Rows instead of one list per session: a session of any length stays spread.
    """
    placed = rank_in_group(log, "conv_id", "turn", "position", descending=False)
    return placed.select("conv_id", "position", "role", F.col("text").alias("content"))


def message_list(prompts: DataFrame, system: Column, history: DataFrame | None = None) -> DataFrame:
    """Messages sent for each question, as rows ordered by (part, position).

    Part 0 is the system text, part 1 the stored history, part 2 the question as
    asked and as rephrased, part 3 the filled prompt. ``prompts`` has
    question_id, question, rephrased and prompt; ``history`` has question_id,
    position, role and content.
    """
    user = F.lit("user")

    def row(part: int, position: int, role: Column, content: Column) -> Column:
        return F.struct(
            F.lit(part).cast("bigint").alias("part"), F.lit(position).cast("bigint").alias("position"),
            role.alias("role"), content.alias("content"),
        )

    rows = F.array(
        row(0, 1, F.lit("system"), system),
        row(2, 1, user, F.col("question")),
        row(2, 2, user, F.col("rephrased")),
        row(3, 1, user, F.col("prompt")),
    )
    messages = prompts.select("question_id", F.explode(rows).alias("m")).select("question_id", "m.*")
    if history is None:
        return messages
    kept = history.join(prompts.select("question_id"), "question_id", "left_semi")
    return messages.unionByName(
        kept.select("question_id", F.lit(1).cast("bigint").alias("part"), "position", "role", "content")
    )
