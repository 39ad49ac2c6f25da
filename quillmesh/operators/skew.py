"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split.
ROWS_PER_TASK = 1_000_000
# Same idea for many-to-many joins, counted in emitted pairs: a task that adds pairs up holds about 100 bytes for each.
PAIRS_PER_TASK = 2_000_000
# Hot keys at most: a key is hot only if it also holds more than this part of all rows (or pairs), so the broadcast
# lists have a size bound whatever the size of the data, and a task holds at most this part of them.
MAX_HOT = 10_000
# A key is dealt out in cells of at most this part of what a task may hold: chance gives some tasks several cells, and of
# whole-sized ones the fullest task would hold a multiple that grows with the number of tasks.
CELL = 1 / 16
# A stored lookup table of at most this many keys (some 120 bytes each) is handed to every executor.
BROADCAST_KEYS = 500_000


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table with one row per key, where a NULL key is a key like any other.

    Whether the right side is broadcast is left to the planner, which knows its size at run time; the adaptive
    planner also splits hot keys of the left side.
    """
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def _fan(rows: Column, per_task: Column) -> Column:
    return F.greatest(F.ceil(rows / per_task), F.lit(1)).cast("int")


def _budget(counts: DataFrame, size: Column, least: float) -> Column:
    """What a task may hold: ``least``, or the ``MAX_HOT``-th part of all if that is more."""
    share = counts.agg((F.sum(size.cast("double")) / MAX_HOT).alias("share")).scalar()
    return F.greatest(F.lit(float(least)), share)


def tasks_for(needed: DataFrame) -> int:
    """Tasks that a shuffle needs, from one number; not fewer than there are cores."""
    return max(math.ceil(needed.first()[0] or 0), needed.sparkSession.sparkContext.defaultParallelism)


def gather_pairs(pairs: DataFrame, left_id: str, right_id: str, key_rows: DataFrame, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """The pairs of a ``spread_join`` dealt by both ids to as many tasks as they need, to be added up there.

    Pairs that share their ids come from other keys and so from other tasks: adding up in the tasks of the join finds next
    to none to add, and the pairs of all hot cells that a task got would be held there at once.
    """
    needed = key_rows.agg(F.sum(F.col("n_left").cast("double") * F.col("n_right")) / pairs_per_task)
    return pairs.repartition(tasks_for(needed), left_id, right_id)


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_rows: str,
    spread_by: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and knows in ``left_rows`` how many
    rows of ``left`` carry that key.

    Hot keys get several salts: the left rows are dealt out by a hash of ``spread_by`` and the one
    right row is repeated per salt. Other keys join as usual (Spark picks broadcast or shuffle). The
    list of hot keys has at most ``MAX_HOT`` entries.
    ``counts`` may name a cheaper table to read the hot keys from when ``right`` is costly. ``stored``: that table is
    read from storage, and so is ``right``, which is counted: with up to ``BROADCAST_KEYS`` keys it travels to the left rows, and
    none of these is shuffled. Otherwise rows are added up first and the join gets as many tasks as they need, unless these are no
    more than there are cores: tasks joined by their bytes afterwards would hold more rows the larger the tables are.
    """
    if stored and right.count() <= BROADCAST_KEYS:
        return left.join(F.broadcast(right), on, how)
    known = right if counts is None else counts
    budget = _budget(known, F.col(left_rows), rows_per_task * CELL)
    fan = _fan(F.col(left_rows), budget)
    hot = known.where(F.col(left_rows) > budget).select(on, fan.alias("_fan"))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_fan")).cast("int"), F.lit(0))
    )
    repeated = right.withColumn("_salts", fan).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = tasks_for(known.agg(F.sum(F.col(left_rows).cast("double")) / rows_per_task)) if stored else 0
    if tasks > cores:
        dealt, repeated = (side.repartition(tasks, on, "_salt") for side in (dealt, repeated))
    return dealt.join(repeated, [on, "_salt"], how).drop("_salt", "_fan")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_id: str,
    right_id: str,
    key_rows: DataFrame,
    pairs_per_task: int = PAIRS_PER_TASK,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Many-to-many inner join that splits hot keys on both sides into a grid of salts.

    ``key_rows`` is ``(on, n_left, n_right)``. A key is hot when it emits more than
    ``CELL`` of ``pairs_per_task`` pairs or has more than ``CELL`` of ``rows_per_task`` rows on a side, and more than the
    ``MAX_HOT``-th part of all of them, so the broadcast list has at most ``2 * MAX_HOT`` entries. The
    grid has cells of about that size, shaped like the two sides so that the fewest
    rows are repeated. The join has as many tasks as all pairs and rows need, whatever the session's setting, so the
    memory of a task does not grow with the tables. ``key_rows`` is read several times: pass a stored table.
    """
    nl, nr = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    pairs, rows = _budget(key_rows, nl * nr, pairs_per_task * CELL), _budget(key_rows, F.greatest(nl, nr), rows_per_task * CELL)
    cells = F.greatest(F.ceil(nl * nr / pairs), F.lit(1))
    by_shape = F.ceil(F.sqrt(cells * nl / nr))
    hot = (
        key_rows.where((nl * nr > pairs) | (nl > rows) | (nr > rows))
        .withColumn("_fl", F.greatest(by_shape, F.ceil(nl / rows)).cast("int"))
        .withColumn("_fr", F.greatest(F.ceil(cells / F.col("_fl")), F.ceil(nr / rows)).cast("int"))
        .select(on, "_fl", "_fr")
    )

    def dealt(df: DataFrame, row_id: str, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        marked = df.join(F.broadcast(hot), on, "left")
        return marked.select(
            *df.columns,
            F.coalesce(F.pmod(F.xxhash64(row_id), F.col(own)).cast("int"), F.lit(0)).alias(own_salt),
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(other_salt),
        )

    tasks = tasks_for(key_rows.agg(F.greatest(F.sum(nl * nr) / pairs_per_task, F.sum(nl + nr) / rows_per_task)))
    a = dealt(left, left_id, "_fl", "_fr", "_sl", "_sr").repartition(tasks, on, "_sl", "_sr")
    b = dealt(right, right_id, "_fr", "_fl", "_sr", "_sl").repartition(tasks, on, "_sl", "_sr")
    return a.join(b, [on, "_sl", "_sr"]).drop("_sl", "_sr")


def grid_shape(left_rows: int, right_rows: int, pairs: int, cores: int, pairs_per_task: int = PAIRS_PER_TASK, rows_per_task: int = ROWS_PER_TASK) -> tuple[int, int] | None:
    """Blocks of left and of right ids for ``grid_join``, so that no cell has more pairs or rows than a task may hold.

    Every left row is sent to each block of right ids and the other way round; of the shapes with enough cells the one
    that sends the fewest rows is taken. None if sending the pairs themselves after a ``spread_join`` takes fewer.
    """
    cells = max(math.ceil(pairs / pairs_per_task), cores)
    least_left, least_right = (max(math.ceil(2 * rows / rows_per_task), 1) for rows in (left_rows, right_rows))
    ideal = max(min(int(math.sqrt(cells * left_rows / max(right_rows, 1))), cells), least_left)
    shapes = [(n, max(math.ceil(cells / n), least_right)) for n in range(max(ideal - 8, least_left), ideal + 9)]
    sent, shape = min((left_rows * r + right_rows * l, (l, r)) for l, r in shapes)
    return shape if sent <= left_rows + right_rows + pairs else None


def grid_join(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, left_blocks: int, right_blocks: int) -> DataFrame:
    """Many-to-many inner join in a grid: one task for each block of left ids and block of right ids.

    Blocks are hashes of the ids, so every key is split, hot or not, and all pairs of two ids meet in one task. They can be added
    up there without a shuffle of pairs: group by both ids and ``_cell``, the task's number.
    """

    def block(row_id: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int")

    def dealt(df: DataFrame, first: Column, times: int, step: int) -> DataFrame:
        cell = F.explode(F.sequence(first, first + F.lit(step * (times - 1)), F.lit(step))) if times > 1 else first
        return df.withColumn("_cell", cell).repartitionById(left_blocks * right_blocks, "_cell")

    a = dealt(left, block(left_id, left_blocks) * F.lit(right_blocks), right_blocks, 1)
    b = dealt(right, block(right_id, right_blocks), left_blocks, right_blocks)
    # by sorting: the hash table of a broadcast would hold the rows of all cells
    return a.hint("merge").join(b, ["_cell", on])
