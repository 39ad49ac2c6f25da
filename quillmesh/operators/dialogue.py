"""Dialogue windows: the last k turns up to each turn of a given role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: dialogues are handed over as three turns.
WINDOW_TURNS = 3


def conversation_window(
    df: DataFrame,
    k: int = WINDOW_TURNS,
    role: str | None = "user",
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    block: int = 8192,
) -> DataFrame:
    """``(conv, turn, turns array<string>)``: the turn itself and up to k - 1 turns before it.

    ``(conv, turn)`` must be unique; gaps in the turn numbers are fine. A conversation is cut in
    blocks of ``block`` turn numbers, so a giant one is handled by many tasks. Each block is handed
    the last k - 1 turns before it: the tails of the preceding non-empty blocks. Only the list of
    non-empty blocks, one short row per block, is ever ordered per conversation.
    """
    rows = df.withColumn("_block", F.floor(F.col(turn) / block))
    back = k - 1
    if back:
        blocks = rows.groupBy(conv, "_block").agg(F.count(F.lit(1)).alias("_n"))
        following = blocks.select(
            conv,
            "_block",
            F.array_compact(
                F.array(
                    *[F.lead("_block", i).over(Window.partitionBy(conv).orderBy("_block")) for i in range(1, k)]
                )
            ).alias("_next"),
        ).where(F.size("_next") > 0)
        latest = Window.partitionBy(conv, "_block").orderBy(F.desc(turn))
        tails = rows.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= back).drop("_rank")
        carried = (
            tails.join(following, [conv, "_block"])
            .withColumn("_block", F.explode("_next"))
            .drop("_next")
            .withColumn("_carried", F.lit(True))
        )
        rows = rows.withColumn("_carried", F.lit(False)).unionByName(carried)
    else:
        rows = rows.withColumn("_carried", F.lit(False))
    before = Window.partitionBy(conv, "_block").orderBy(turn).rowsBetween(-back, 0)
    windowed = rows.withColumn("turns", F.collect_list(text).over(before))
    mine = ~F.col("_carried")
    if role is not None:
        mine = mine & (F.col("role") == role)
    return windowed.where(mine).select(conv, turn, "turns")
