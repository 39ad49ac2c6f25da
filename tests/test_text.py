import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import text as tx

EDGES = ["", "   ", "　a　", " x ", "\t\n a b \r\n", "\x1fq\x1c", " \u0085z ", "plain"]


def test_strip_equals_python(spark):
    df = spark.createDataFrame([(s,) for s in EDGES], "s string")
    for row in df.select("s", tx.strip(F.col("s")).alias("out")).collect():
        assert row.out == row.s.strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x1d\x85 　abÉ", max_size=8), min_size=20, max_size=40))
def test_strip_property(spark, texts):
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    assert all(r.out == r.s.strip() for r in df.select("s", tx.strip(F.col("s")).alias("out")).collect())


def test_clean_html(spark):
    cases = {
        "<p>a</p>\n<b>b</b>": "ab",
        " <i>x</i> \n": "x",
        "b < c > d": "b  d",
        "<script>var t=1;</script>": "var t=1;",
        "a&amp;b": "a&amp;b",
        "<>": "<>",
    }
    df = spark.createDataFrame(list(cases), "string").select("value", tx.clean_html(F.col("value")).alias("out"))
    for row in df.collect():
        assert row.out == cases[row.value]


def test_tokens_and_ids(spark):
    import hashlib

    df = spark.createDataFrame([("Héllo, WORLD 42! 你好",)], "s string")
    row = df.select(tx.tokens(F.col("s")).alias("t"), tx.token_ids(F.col("s")).alias("i")).first()
    assert row.t == ["héllo", "world", "42", "你好"]
    assert row.i == [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in row.t]


@pytest.mark.parametrize("n", [0, 3, 6, 9])
def test_encode_pads_and_truncates(spark, n):
    df = spark.createDataFrame([(list(range(10, 10 + n)),)], "ids array<bigint>")
    p = df.select(tx.encode(F.col("ids"), 8).alias("p")).first().p
    body = list(range(10, 10 + n))[:6]
    assert p.input_ids == [0, *body, 2] + [1] * (6 - len(body))
    assert p.attention_mask == [1] * (len(body) + 2) + [0] * (6 - len(body))
    whole = df.select(tx.encode(F.col("ids"), 8, "longest", False).alias("p")).first().p
    assert whole.input_ids == [0, *range(10, 10 + n), 2]


def test_encode_rejects_unknown_padding():
    with pytest.raises(ValueError):
        tx.encode(F.lit(None), 8, padding="left")


@pytest.mark.parametrize(
    ("q", "d", "ids", "error"),
    [
        ([10], [20, 21], [0, 10, 2, 2, 20, 21, 2, 1], False),
        ([10], [20, 21, 22, 23, 24], [0, 10, 2, 2, 20, 21, 22, 2], False),
        ([10, 11, 12, 13], [], [0, 10, 11, 12, 13, 2, 2, 2], False),
        ([10, 11, 12, 13], [20], None, True),
        ([10, 11, 12, 13, 14, 15], [20], None, True),
    ],
)
def test_pack_pair(spark, q, d, ids, error):
    df = spark.createDataFrame([(q, d)], "q array<bigint>, d array<bigint>")
    p = df.select(tx.pack_pair(F.col("q"), F.col("d"), 8).alias("p")).first().p
    assert p.input_ids == ids
    assert (p.error is not None) == error


def test_pack_pair_shortens_query_on_request(spark):
    df = spark.createDataFrame([([10, 11, 12, 13, 14], [20])], "q array<bigint>, d array<bigint>")
    p = df.select(tx.pack_pair(F.col("q"), F.col("d"), 8, 2).alias("p")).first().p
    assert p.input_ids == [0, 10, 11, 2, 2, 20, 2, 1]


def test_join_history_keeps_empty_turns(spark):
    df = spark.createDataFrame([(["a", "", "b"],)], "t array<string>")
    assert df.select(tx.join_history(F.col("t"))).first()[0] == "a[SEP][SEP]b"
