"""Input tables derived from the driver tables by plain expressions; they grow with those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import CLS_ID, EOS_ID, PAD_ID, token_ids, tokens
from quillmesh.functions.vectors import word_weights
from quillmesh.operators.dialogue import conversation_window
from quillmesh.session import ship_package
from quillmesh.sources.tables import table

TEXTS_PER_REQUEST = 8
TURNS_PER_REQUEST = 4


def _js(text: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.char_length(wrapped) - 2)


def _body(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _cases(selector: Column, cases: dict[int, Column], default: Column) -> Column:
    out = default
    for value, body in cases.items():
        out = F.when(selector == value, body).otherwise(out)
    return out


def embed_requests(docs: DataFrame) -> DataFrame:
    """One embed request per document, with a fault or option chosen by ``doc_id % 15``."""
    text, source = _js(F.col("text")), _js(F.col("source"))
    cases = {
        1: _body('{"text":[', text, ",", source, '],"return_sparse":true}'),
        2: _body('{"text":[]}'),
        3: _body('{"text":7}'),
        4: _body('{"text":[', text, ",1]}"),
        5: _body('{"text":[', text, ",null]}"),
        6: _body('{"model":"default"}'),
        7: _body('{"text":null}'),
        8: _body('{"text":', F.col("source")),
        9: _body('{"text":', text, ',"model":"dense_only","return_sparse":true}'),
        10: _body('{"text":', text, ',"return_dense":"yes"}'),
        11: _body('{"text":', text, ',"model":"missing"}'),
        12: _body('{"text":', text, ',"model":"sparse_only"}'),
        13: _body('{"text":"first","text":', text, "}"),
        14: _body('{"text":', text, ',"language":', source, "}"),
    }
    body = _cases(F.pmod("doc_id", F.lit(15)), cases, _body('{"text":', text, "}"))
    return docs.select(F.col("doc_id").alias("request_id"), body.alias("body"))


def assigned_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every document with one query: ``item_id = request_id % (number of queries)``."""
    total = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = docs.select(
        "doc_id",
        "text",
        F.floor(F.col("doc_id") / TEXTS_PER_REQUEST).alias("request_id"),
        F.pmod("doc_id", F.lit(TEXTS_PER_REQUEST)).alias("pos"),
    ).withColumn("item_id", F.pmod(F.col("request_id"), total))
    return keyed.join(queries.select("item_id", F.col("text").alias("query")), "item_id")


def rerank_requests(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Eight documents per request, fault or option by ``request_id % 9``."""
    grouped = (
        assigned_pairs(docs, queries)
        .groupBy("request_id", "query")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    )
    texts = F.to_json(F.transform("t", lambda x: x["text"]))
    query = _js(F.col("query"))
    cases = {
        1: _body('{"query":', query, ',"texts":[]}'),
        2: _body('{"texts":', texts, "}"),
        3: _body('{"query":', query, ',"texts":[', _js(F.col("query")), ",3]}"),
        4: _body('{"query":', query, ',"texts":', texts, ',"model":"missing"}'),
        5: _body('{"query":', query, ',"texts":', texts, ',"model":"sigmoid"}'),
        6: _body('{"query":', query, ',"texts":', texts, ',"top_n":3}'),
        7: _body('{"query":7,"query":', query, ',"texts":', texts, "}"),
    }
    body = _cases(F.pmod("request_id", F.lit(9)), cases, _body('{"query":', query, ',"texts":', texts, "}"))
    return grouped.select("request_id", body.alias("body"))


def rerank_requests_by_document(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """One rerank request per document (text and source), made row by row: fit for streams."""
    total = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = docs.select(
        "doc_id", "text", "source", F.floor(F.col("doc_id") / TEXTS_PER_REQUEST).alias("r")
    ).withColumn("item_id", F.pmod(F.col("r"), total))
    joined = keyed.join(queries.select("item_id", F.col("text").alias("query")), "item_id")
    query, texts = _js(F.col("query")), F.to_json(F.array("text", "source"))
    cases = {1: _body('{"query":', query, ',"texts":[]}'), 2: _body('{"texts":', texts, "}")}
    body = _cases(F.pmod("doc_id", F.lit(7)), cases, _body('{"query":', query, ',"texts":', texts, "}"))
    return joined.select(F.col("doc_id").alias("request_id"), body.alias("body"))


def rewrite_requests(turns: DataFrame) -> DataFrame:
    """One rewrite request per user turn from ``conversation_window``, fault by ``conv_id % 8``."""
    said = F.to_json("turns")
    cases = {
        1: _body('{"message":[', said, ",[]]}"),
        2: _body('{"message":[]}'),
        3: _body('{"message":', said, "}"),
        4: _body('{"message":[', said, ',["x",null]]}'),
        5: _body('{"message":[', said, '],"model":"missing"}'),
        6: _body('{"message":[', said, '],"top_n":3}'),
        7: _body('{"message":[],"message":[', said, "]}"),
    }
    body = _cases(F.pmod("conv_id", F.lit(8)), cases, _body('{"message":[', said, "]}"))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", "turn", body.alias("body"))


def dialogue_windows(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_window(table(spark, folder, "conversations"))


def text_requests(conversations: DataFrame) -> DataFrame:
    """Four consecutive turns of a conversation as one list request."""
    keyed = conversations.withColumn("part", F.floor(F.col("turn") / TURNS_PER_REQUEST))
    grouped = keyed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return grouped.select(
        F.concat_ws("-", "conv_id", "part").alias("request_id"), F.transform("t", lambda x: x["text"]).alias("texts")
    )


def occurrence_weights(docs: DataFrame) -> DataFrame:
    """Token ids with special ids around them, and weights that repeat, vanish and go negative."""
    ids = F.concat(
        F.array(F.lit(CLS_ID).cast("bigint")),
        token_ids(F.col("text")),
        F.array(F.lit(EOS_ID).cast("bigint"), F.lit(PAD_ID).cast("bigint")),
    )
    rows = docs.select("doc_id", ids.alias("ids"))
    weights = F.transform("ids", lambda _, i: (F.pmod(i * 7 + F.col("doc_id"), F.lit(11)) - 3) / F.lit(4.0))
    return rows.withColumn("weights", weights)


def colbert_vectors(embeddings: DataFrame) -> DataFrame:
    """Each vector as 16 token vectors of 4 values, the first ``vec_id % 17`` attended."""
    values = F.col("embedding").cast("array<double>")
    vecs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(values, i * 4 + 1, F.lit(4)))
    attended = F.pmod("vec_id", F.lit(17))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i < attended, 1).otherwise(0))
    return embeddings.select("vec_id", vecs.alias("vecs"), mask.alias("mask"))


def dense_pairs(embeddings: DataFrame, faults: bool = True) -> DataFrame:
    """Vectors and copies cut to two decimals; with ``faults`` some are zero, shorter or missing."""
    a = F.col("embedding").cast("array<double>")
    copy = F.transform(a, lambda x: F.floor(x * 100) / F.lit(100.0))
    if faults:
        copy = (
            F.when(F.pmod("vec_id", F.lit(50)) == 0, F.transform(a, lambda x: x * 0.0))
            .when(F.pmod("vec_id", F.lit(60)) == 7, F.slice(copy, 1, 63))
            .when(F.pmod("vec_id", F.lit(70)) == 9, F.lit(None))
            .otherwise(copy)
        )
    return embeddings.select(F.col("vec_id").alias("sample_id"), a.alias("a"), copy.alias("b"))


def position_weights(df: DataFrame, *keys: str) -> DataFrame:
    """Sparse map ``w`` of each text from position weights alone."""
    ship_package(df.sparkSession)
    rows = df.select(*keys, tokens(F.col("text")).alias("words"))
    weights = F.transform("words", lambda _, i: F.lit(1.0) / (F.lit(1.0) + i / F.lit(512.0)))
    return rows.withColumn("weights", weights).select(*keys, word_weights(F.col("words"), F.col("weights")).alias("w"))


def sparse_pairs(docs: DataFrame, lossy: bool = True) -> DataFrame:
    """Sparse maps and copies with two decimals.

    With ``lossy`` one side lacks late tokens and the other the first ones, so that short texts have
    nothing in common.
    """
    gen = ref = F.col("w")
    if lossy:
        gen = F.map_filter("w", lambda _, v: v >= 0.3)
        ref = F.map_filter("w", lambda _, v: v <= 0.9)
    ref = F.transform_values(ref, lambda _, v: F.floor(v * 100) / F.lit(100.0))
    return position_weights(docs, "doc_id").select(F.col("doc_id").alias("sample_id"), gen.alias("a"), ref.alias("b"))


def golden_scores(scores: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A golden copy of ``(sample_id, pos, doc_id, score)`` with two decimals.

    With ``labels`` only labelled documents have one, so samples have fewer, one or no golden scores.
    """
    known = scores if labels is None else scores.join(labels.select("doc_id"), "doc_id", "left_semi")
    return known.withColumn("score", F.floor(F.col("score") * 100) / F.lit(100.0))


def tensors(embeddings: DataFrame) -> DataFrame:
    """Outputs of two runtimes: by ``vec_id % 4`` equal, close, far, other shape."""
    a = F.col("embedding").cast("array<double>")
    kind = F.pmod("vec_id", F.lit(4))
    b = (
        F.when(kind == 0, a)
        .when(kind == 1, F.transform(a, lambda x: x * 1.5))
        .when(kind == 2, F.transform(a, lambda x: x * -3.0))
        .otherwise(F.slice(a, 1, 63))
    )
    shape = F.array(F.lit(8), F.lit(8))
    return embeddings.select(
        "vec_id",
        shape.alias("shape_a"),
        a.alias("data_a"),
        F.when(kind == 3, F.array(F.lit(63))).otherwise(shape).alias("shape_b"),
        b.alias("data_b"),
    )


def latency_log(events: DataFrame) -> DataFrame:
    """Events as timed runs: the type is the model, the value the latency in ms."""
    model = F.when(F.col("event_id") == 0, F.lit("single")).otherwise(F.col("event_type"))
    embed_model = F.col("event_type").isin("click", "view", "signup") | (F.col("event_id") == 0)
    failed = (F.col("event_type") == "error") & (F.col("value") > 50) & (F.col("event_id") > 0)
    return events.select(
        F.when(embed_model, F.lit("embed")).otherwise(F.lit("rerank")).alias("task"),
        model.alias("model_name"),
        F.concat(F.lit("Runner_"), model).alias("model_class"),
        "event_id",
        "ts",
        F.col("value").alias("latency_ms"),
        F.when(failed, F.lit("runtime failure")).alias("error"),
    )


def request_log(events: DataFrame, *more: str) -> DataFrame:
    """Events as a request log: type -> status and stage, value / 10 -> seconds."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", 400).when(kind == "error", 500).otherwise(200)
    third = F.pmod("user_id", F.lit(3))
    refused = F.when(third == 0, "validation").when(third == 1, "routing").otherwise("capability")
    stage = F.when(kind == "signup", refused).when(kind == "error", F.lit("run"))
    half = F.pmod("user_id", F.lit(2))
    return events.select(
        "ts",
        F.when(third == 0, "embed").when(third == 1, "rerank").otherwise("rewrite").alias("model_type"),
        F.when(half == 0, "default").otherwise("other").alias("model_name"),
        F.concat(F.lit("Runner"), half.cast("string")).alias("model_cls"),
        status.alias("status"),
        stage.alias("error_stage"),
        (F.col("value") / 10).alias("elapsed_s"),
        *more,
    )


def arrivals(events: DataFrame) -> DataFrame:
    """The request log with arrival times: some seconds after the event, twenty minutes for one event in 37."""
    seconds = F.when(F.pmod("event_id", F.lit(37)) == 5, 1200).otherwise(F.pmod("event_id", F.lit(7)))
    delayed = events.withColumn("arrived_at", F.timestamp_add("SECOND", seconds, "ts"))
    return request_log(delayed, "arrived_at")


def request_lines(requests: DataFrame) -> DataFrame:
    """Requests as JSON lines; by ``request_id % 17`` some are cut off, some have a text for a number."""
    number = F.col("request_id").cast("string")
    cases = {3: _body('{"request_id":', number, ',"body":"cut'), 4: _body('{"request_id":"no number ', number, '","body":"{}"}')}
    whole = F.to_json(F.struct("request_id", "body"))
    return requests.select(_cases(F.pmod("request_id", F.lit(17)), cases, whole).alias("value"))


def failing_scores(pairs: DataFrame) -> DataFrame:
    """Length ratios as scores; texts whose length is a multiple of 25 are failed rows."""
    q, t = F.length("query"), F.length("text")
    failed = t % 25 == 0
    return pairs.withColumns({
        "score": F.when(~failed, F.least(q, t).cast("double") / F.greatest(q, t, F.lit(1))),
        "status": F.when(failed, F.lit(500)),
        "error": F.when(failed, F.lit("run exception: poisoned text")),
    })
