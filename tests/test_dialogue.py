import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.dialogue import conversation_window
from quillmesh.operators.sampling import take_first, zip_pairs


def expected(rows, k, role):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        for i, (_, turn, who, _) in enumerate(mine):
            if role is None or who == role:
                out[conv, turn] = [r[3] for r in mine[max(0, i - k + 1): i + 1]]
    return out


@pytest.mark.parametrize("block", [1, 3, 8192])
@pytest.mark.parametrize(("k", "role"), [(1, "user"), (3, "user"), (4, None)])
def test_windows_with_gaps_and_small_blocks(spark, block, k, role):
    rng = random.Random(7)
    rows = []
    for conv, n in ((1, 40), (2, 1), (3, 9)):
        for turn in sorted(rng.sample(range(60), n)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), f"{conv}-{turn}"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): r.turns for r in conversation_window(df, k, role, block=block).collect()}
    assert got == expected(rows, k, role)


def test_take_first_and_zip(spark):
    q = spark.range(30).select(F.col("id").alias("q"), F.concat(F.lit("q"), "id").alias("query"))
    d = spark.range(5).select((F.col("id") * 10).alias("d"))
    assert [r.q for r in take_first(q, "q", 3).collect()] == [0, 1, 2]
    pairs = zip_pairs(q, d, "q", "d")
    assert sorted((r.ordinal, r.q, r.d) for r in pairs.collect()) == [(i + 1, i, 10 * i) for i in range(5)]
