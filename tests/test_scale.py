"""Work that must not be repeated, and tasks whose size must not grow with the tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmesh.functions.text import token_ids, tokens
from quillmesh.functions.vectors import common_values, token_weights, word_weights
from quillmesh.operators import inference, skew
from quillmesh.operators import lexical as lex
from quillmesh.operators.runners import HEAD_B, HEAD_B_OUT, HEAD_W, HEAD_W_OUT, HeadRerankRunner
from quillmesh.operators import runners
from quillmesh.operators.skew import spread_join
from quillmesh.plans import catalog, retrieval
from quillmesh.session import ship_package
from quillmesh.streaming.pieces import GatherPieces


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_weights_are_token_weights(spark):
    ship_package(spark)
    texts = [(0, None), (1, ""), (2, "a b a É a"), (3, "!"), (None, "x y x"), (5, " ".join(f"w{i % 90}" for i in range(700)))]
    rows = spark.createDataFrame(texts, "id int, text string").select("id", tokens(F.col("text")).alias("words"), token_ids(F.col("text")).alias("ids"))
    for weight in (lambda _, i: 1.0 / (1.0 + i / 512.0), lambda _, i: F.when(i % 3 > 0, (F.pmod(i * 7, F.lit(11)) - 3) / 4.0)):
        both = rows.withColumn("weights", F.transform("ids", weight))
        found = both.select("id", token_weights(F.col("ids"), F.col("weights")).alias("a"), word_weights(F.col("words"), F.col("weights")).alias("b"))
        pairs = [(r.a, r.b) for r in found.select(F.map_entries("a").alias("a"), F.map_entries("b").alias("b")).collect()]
        assert all(a == b for a, b in pairs) and sum(a is None for a, _ in pairs) == 1 and max(len(a or ()) for a, _ in pairs) > 50


def test_common_values_keep_null_values_apart_from_absent_keys(spark):
    row = spark.sql("select map(3, 1.0D, 1, null, 7, 2.0D) a, map(1, 5.0D, 9, 1.0D, 3, 4.0D) b, cast(null as map<int, double>) c")
    got = row.select(common_values(F.col("a"), F.col("b")).alias("x"), common_values(F.col("a"), F.col("c")).alias("y")).first()
    assert [tuple(e) for e in got.x] == [(3, 1.0, 4.0), (1, None, 5.0)] and got.y is None


def test_rerank_features_by_look_ups_and_by_sorting_agree(spark, monkeypatch):
    texts = [("a b c a", "b x a b a"), ("", "a"), (None, "a"), ("a", None), ("q r", "s t"), ("z y x w v", "v w x y z z y")]
    pairs = spark.createDataFrame(texts, "query string, text string")

    def features():
        return [r[0] for r in pairs.select(HeadRerankRunner.features(F.col("query"), F.col("text"))).collect()]

    looked_up = features()
    monkeypatch.setattr(runners, "LOOK_UPS", -1)
    assert features() == looked_up and looked_up[0][1:] == [0.5, 2 / 3, 0.8] and looked_up[4][:3] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("name", ["eval_summary", "verdict", "eval_report_counts", "bucketed_alignment", "compare_scores", "evaluation_sink"])
def test_pairs_are_reranked_once(spark, data, monkeypatch, name):
    calls, reranked = [], catalog._reranked
    monkeypatch.setattr(catalog, "_reranked", lambda *args: calls.append(1) or reranked(*args))
    assert "array_intersect" not in plan(catalog.CATALOG[name](spark, data))
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["id_to_token", "id_to_token_whole", "lexical_weights"])
def test_vocabulary_is_fitted_once(spark, data, name):
    assert "array_distinct" not in plan(catalog.CATALOG[name](spark, data))


@pytest.mark.parametrize("name", ["compare_sparse_long", "compare_embeddings"])
def test_sparse_weights_are_computed_once(spark, data, name):
    assert "regexp_extract_all" not in plan(catalog.CATALOG[name](spark, data))


def test_pairs_of_a_task_are_bounded(spark):
    left = spark.range(4000).select((F.col("id") % 400).alias("t"), F.col("id").alias("a"))
    right = spark.range(20_000).select((F.col("id") % 400).alias("t"), F.col("id").alias("b"))
    key_rows = spark.range(400).select(F.col("id").alias("t"), F.lit(10).alias("n_left"), F.lit(50).alias("n_right"))
    pairs = spread_join(left, right, "t", "a", "b", key_rows, pairs_per_task=1000).groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in pairs.collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 8 * 1000


def test_models_get_parts_by_their_texts(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "big").otherwise("small").alias("model"), F.repeat(F.lit("x"), 100).alias("text"))
    monkeypatch.setattr(inference, "PART_BYTES", 20_000)
    placed = inference.gather_models(rows, "id", 4)
    assert "SortMergeJoin" not in plan(placed)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 16 and max(sizes) < 400


def test_runner_inputs_are_sliced(monkeypatch):
    monkeypatch.setattr(inference, "VALUES_AT_ONCE", 100)
    columns = {"ids": pa.array([list(range(i % 60)) if i % 7 else None for i in range(50)], pa.list_(pa.int64())), "text": pa.array(["é" * (i % 40) if i % 5 else None for i in range(50)])}
    columns["texts"] = pa.array([["ab", None, "c" * i] if i % 4 else None for i in range(50)], pa.list_(pa.string()))
    columns["turns"] = pa.array([[["a"]]] * 50, pa.list_(pa.list_(pa.string())))
    batch = pa.RecordBatch.from_pydict(columns)
    for name in columns:
        parts = list(inference._slices(batch, [name]))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and (len(parts) > 3) == (name != "turns")
    assert [p.num_rows for p in inference._slices(batch.slice(3, 10), ["ids"])] and list(inference._slices(batch.slice(0, 0), ["ids"]))[0].num_rows == 0


class Held:
    """State of one request that counts what is written."""

    def __init__(self):
        self.values, self.one, self.written, self.timers = {}, None, 0, []

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Single(self)

    def updateValue(self, key, value):
        self.values[key], self.written = value, self.written + 1

    def iterator(self):
        return iter(self.values.items())

    def clear(self):
        self.values.clear()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Single:
    def __init__(self, held):
        self.held = held

    def exists(self):
        return self.held.one is not None

    def get(self):
        return self.held.one

    def update(self, value):
        self.held.one, self.held.written = value, self.held.written + 1

    def clear(self):
        self.held.one = None


def test_pieces_that_complete_a_request_are_not_stored():
    held, processor = Held(), GatherPieces()
    processor.init(held)

    def send(*pieces):
        rows = (Row(pos=p, n_texts=3, answer=a, error=None, arrived_ms=np.int64(7)) for p, a in pieces)
        return list(processor.handleInputRows(("r",), rows, None))

    assert [r.results for r in send((2, "c"), (0, "x"), (1, None), (0, "a"))] == [["a", None, "c"]] and held.written == 0
    assert send((1, "old"), (2, "c")) == [] and held.written == 3 and held.timers == [7]
    assert [r.results for r in send((1, "b"), (0, "a"))] == [["a", "b", "c"]] and held.written == 3
    assert (held.values, held.one, held.timers) == ({}, None, [])


def test_no_task_of_a_join_gets_many_times_its_share_of_pairs(spark):
    """Forty keys that each fill a task: dealt whole, chance puts several of them into one."""
    left = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("l"))
    right = spark.range(16_000).select((F.col("id") % 40).alias("k"), F.col("id").alias("r"))
    key_rows = spark.range(40).select(F.col("id").alias("k"), F.lit(10).alias("n_left"), F.lit(400).alias("n_right"))
    pairs = spread_join(left, right, "k", "l", "r", key_rows, pairs_per_task=4000)
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 160_000 and pairs.distinct().count() == 160_000
    assert max(sizes) < 10_000


def test_corpus_tokens_that_no_query_has_do_not_reach_the_join(spark, monkeypatch):
    from quillmesh.plans import retrieval

    seen = []
    matrix = retrieval.lexical_score_matrix
    monkeypatch.setattr(retrieval, "lexical_score_matrix", lambda q, d, *more: seen.append(d) or matrix(q, d, *more))
    docs = spark.createDataFrame([(n, f"common word{n}") for n in range(30)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(0, "word3 word5 unheard"), (1, None)], "item_id bigint, text string")
    found = retrieval.match_corpus(queries, docs, "item_id", "doc_id", small_chars=-1).collect()
    assert sorted((r.item_id, r.doc_id) for r in found) == [(0, 3), (0, 5)]
    assert sorted(r.doc_id for r in seen[0].collect()) == [3, 5]


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


def test_matrix_shuffles_posting_lists_but_no_pairs(spark):
    """Pairs are many times the postings; they are added up in the tasks that make them."""
    postings = spark.range(3000).select((F.col("id") % 300).alias("id"), (F.col("id") % 20).alias("token_id"), F.lit(2.0).alias("weight"))
    matrix = lex.lexical_score_matrix(postings.withColumnRenamed("id", "l"), postings.withColumnRenamed("id", "r"), "l", "r", pairs_per_task=50_000)
    above = final_plan(matrix.select("*", F.spark_partition_id().alias("task"))).split("SortMergeJoin")[0]
    assert "HashAggregate(keys=[l#" in above and "Exchange" not in above
    pairs = postings.withColumnRenamed("id", "l").join(postings.withColumnRenamed("id", "r"), "token_id")
    wanted = pairs.groupBy("l", "r").agg((F.count(F.lit(1)) * 4.0).alias("score"))
    assert sorted(map(tuple, matrix.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("pairs_per_task", [30, 10**6])
def test_matrix_of_repeated_and_null_ids(spark, pairs_per_task):
    left = [(i % 9 or None, i % 4, float(i % 5)) for i in range(60)]
    right = [(f"d{i % 13}" if i % 13 else None, i % 5, float(i % 3)) for i in range(80)]
    a = spark.createDataFrame(left, "l bigint, token_id bigint, weight double")
    b = spark.createDataFrame(right, "r string, token_id bigint, weight double")
    wanted = {}
    for l, s, v in left:
        for r, t, w in right:
            if s == t:
                wanted[l, r] = wanted.get((l, r), 0.0) + v * w
    got = [((c.l, c.r), c.score) for c in lex.lexical_score_matrix(a, b, "l", "r", pairs_per_task=pairs_per_task).collect()]
    assert len(got) == len(wanted) and dict(got) == pytest.approx(wanted)


def test_matrix_with_few_pairs_is_not_repeated_over_a_grid(spark):
    """Each token once on either side: shuffling the 4,000 pairs moves less than any grid of 400 cells."""
    rows = spark.range(4000).select(F.col("id").alias("token_id"), F.col("id"), F.lit(1.0).alias("weight"))
    matrix = lex.lexical_score_matrix(rows.withColumnRenamed("id", "l"), rows.withColumnRenamed("id", "r"), "l", "r", pairs_per_task=10)
    assert "_cell" not in plan(matrix)
    assert sorted((c.l, c.r, c.score) for c in matrix.collect()) == [(i, i, 1.0) for i in range(4000)]


@pytest.mark.parametrize("left,right,pairs", [(0, 0, 0), (8_000, 300_000_000, 2.7e9), (5e6, 4e6, 1e12), (3e8, 1_000, 5e10), (50_000, 50_000, 2.5e9)])
def test_grid_cells_hold_what_a_task_may(left, right, pairs):
    l, r = skew.grid_shape(left, right, pairs, 8)
    assert l * r >= 8 and pairs / (l * r) <= skew.PAIRS_PER_TASK and left / l + right / r <= skew.ROWS_PER_TASK
    assert left * r + right * l <= left + right + pairs


def test_grid_takes_the_shape_that_sends_the_fewest_rows():
    assert skew.grid_shape(8_000, 300_000_000, 2.7e9, 8) == (1, 1350)
    assert skew.grid_shape(300_000_000, 8_000, 2.7e9, 8) == (1350, 1)
    l, r = skew.grid_shape(1e6, 1e6, 1e12, 8)
    assert l * r >= 500_000 and abs(l - r) < 20
    assert skew.grid_shape(1e9, 1e9, 1e10, 8) is None


def test_corpus_rows_are_not_shuffled_to_a_small_vocabulary(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(40).alias("n")).write.parquet(str(tmp_path / "keys"))
    known = spark.read.parquet(str(tmp_path / "keys"))
    left = spark.range(3000).select("id", (F.col("id") % 75).alias("k"))
    out = skew.spread_lookup(left, known, "k", "n", ["id"], rows_per_task=10, stored=True)
    assert "hashpartitioning" not in final_plan(out)
    assert sorted(map(tuple, out.select("id", "k", "v").collect())) == [(i, i % 75, i % 75 * 2) for i in range(3000) if i % 75 < 50]


@pytest.mark.parametrize("most", [0, 500_000])
def test_scores_by_token_are_the_same_for_large_and_small_vocabularies(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", most)
    docs = spark.createDataFrame([(n, f"common word{n % 7} word{n % 3}") for n in range(40)] + [(40, None), (None, "word1"), (7, "word2 word2")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(0, "word1 common"), (1, "word5 unheard word2"), (None, "word6"), (2, None)], "item_id bigint, text string")
    rows = [[((r.item_id, r.doc_id), r.score) for r in retrieval.match_corpus(queries, docs, "item_id", "doc_id", chars).collect()] for chars in (-1, 10**6)]
    assert len(rows[0]) == len(rows[1]) > 40 and dict(rows[0]) == pytest.approx(dict(rows[1]))
