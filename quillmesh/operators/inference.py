"""embed / rerank / rewrite: run models over tables of texts, pairs and dialogues.

Python runners sit behind ``mapInArrow``: loaded once per worker process, fed slices of
``batch_size`` inputs, checked for one result per input, and isolated so that a failing input
fails alone. A Python stage is opaque to the optimiser, so each operator first narrows the table
to the columns the runner and the result need.

``embed`` works on two layouts: row form (one text per row) and array form (one request per row,
arrays in and out), the latter without any shuffle or state, for streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quillmesh.functions.text import token_ids, tokens
from quillmesh.functions.vectors import score_head_udf, sigmoid, token_weights
from quillmesh.operators.ordering import place_within
from quillmesh.operators.requests import RUN_PREFIX
from quillmesh.operators.runners import ModelRegistry, RunnerSpec, load_runner
from quillmesh.operators.skew import same_key_join, spread_lookup
from quillmesh.session import materialize, ship_package

Models = RunnerSpec | ModelRegistry | dict[str, RunnerSpec]

# Bytes of text that one part of ``gather_models`` holds on average at most.
PART_BYTES = 64 << 20
# Models whose places are sent to every task; a table of more of them is joined as the planner decides.
MODELS_SENT = 100_000
# Input values (token ids, or characters' bytes) that a worker turns into results at a time.
VALUES_AT_ONCE = 1 << 19

_EMBED_FIELDS = {"_dense": "array<float>", "_ids": "array<bigint>", "_weights": "array<double>"}


def _specs(models: Models, model_type: str) -> dict[str | None, RunnerSpec]:
    if isinstance(models, RunnerSpec):
        specs = {None: models}
    elif isinstance(models, ModelRegistry):
        specs = models.specs(model_type)
    else:
        specs = dict(models)
    for spec in specs.values():
        if spec.model_type != model_type:
            raise ValueError(f"{spec.model_cls} is a {spec.model_type} runner, not a {model_type} runner")
    if not specs:
        raise ValueError(f"no {model_type} model is configured")
    return specs


def run_isolated(run: Callable[[list], list], inputs: list) -> list[tuple[object, str | None]]:
    """``(result, error)`` per input. A failed or misaligned batch is halved until the bad inputs stand alone."""
    try:
        results = list(run(inputs))
        if len(results) != len(inputs):
            raise RuntimeError(f"{len(results)} results for {len(inputs)} inputs")
        return [(r, None) for r in results]
    except Exception as exc:  # noqa: BLE001 - whatever a model raises becomes a 500 row
        if len(inputs) == 1:
            return [(None, RUN_PREFIX + str(exc))]
        half = len(inputs) // 2
        return run_isolated(run, inputs[:half]) + run_isolated(run, inputs[half:])


def _run_all(load: Callable, models: list, inputs: list) -> list[tuple[object, str | None]]:
    """Group the inputs by model, slice each group by the runner's batch size, keep the order.

    A model is loaded only where an input asks for it.
    """
    answers: list = [(None, None)] * len(inputs)
    places: dict[object, list[int]] = {}
    for i, (model, item) in enumerate(zip(models, inputs, strict=True)):
        if item is not None:
            places.setdefault(model, []).append(i)
    for model, at in places.items():
        runner = load(model)
        for start in range(0, len(at), runner.batch_size):
            part = at[start : start + runner.batch_size]
            for i, answer in zip(part, run_isolated(runner.run, [inputs[i] for i in part]), strict=True):
                answers[i] = answer
    return answers


def _to_inputs(column: pa.Array) -> list:
    """Arrow column -> list of runner inputs; id lists become numpy views without copying."""
    if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type):
        values = column.values.to_numpy(zero_copy_only=False)
        bounds = column.offsets.to_numpy()
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return [values[bounds[i] : bounds[i + 1]] if valid[i] else None for i in range(len(column))]
    return column.to_pylist()


def _flatten(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of a list column, the length of each list, and which lists are not null."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(column.offsets.to_numpy()), 0)
    return column.flatten(), lengths, valid


def _slices(batch: pa.RecordBatch, inputs: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``VALUES_AT_ONCE`` inputs each: results and their copies are bounded, whatever a batch holds."""
    sizes = np.ones(batch.num_rows, np.int64)
    for column in (batch.column(c) for c in inputs):
        if pa.types.is_list(column.type) and pa.types.is_nested(column.type.value_type):
            continue
        text = pa.types.is_list(column.type) and pa.types.is_string(column.type.value_type)
        length = np.diff(column.offsets.to_numpy()) if pa.types.is_list(column.type) else None
        if text:
            ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column.values), 0), np.int64)))
            length = np.diff(ends[column.offsets.to_numpy()])
        elif length is None and pa.types.is_string(column.type):
            length = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        sizes += 0 if length is None else length
    part = (np.cumsum(sizes) - sizes) // VALUES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch if b - a == len(sizes) else batch.slice(a, b - a)


def _map_runners(
    df: DataFrame,
    specs: dict[str | None, RunnerSpec],
    inputs: list[str],
    fields: list[tuple[str, str]],
    unpack: Callable[[object], tuple],
    nested: bool = False,
    echo: dict[str, str] | None = None,
) -> DataFrame:
    """``mapInArrow`` over ``df``: drops the ``inputs`` columns, adds ``fields``, ``status``, ``error``.

    ``echo`` names inputs that come back under another name, without being sent twice. ``unpack``
    turns one answer (None for an input that was not run) into the values of ``fields``.
    """
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c not in inputs and c not in ("status", "error")]
    typed = {f.name: f.dataType for f in df.schema.fields}
    has_status = "status" in df.columns
    echo = echo or {}
    element = [T._parse_datatype_string(t) for _, t in fields]
    schema = T.StructType(
        [T.StructField(c, typed[c]) for c in keep]
        + [T.StructField(name, typed[c]) for c, name in echo.items()]
        + [T.StructField(n, T.ArrayType(t) if nested else t) for (n, _), t in zip(fields, element, strict=True)]
        + [T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType())]
    )
    arrow_types = [to_arrow_type(t) for t in element]
    parts = {name: (spec, spec.runner_class()) for name, spec in specs.items()}
    by_model = None not in specs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, inputs)):
            n = batch.num_rows
            columns = [batch.column(c) for c in inputs]
            owner, valid = np.arange(n), np.ones(n, dtype=bool)
            if nested:
                flat, lengths, valid = _flatten(columns[0])
                columns, owner = [flat], np.repeat(owner, lengths)
            status = batch.column("status").to_pylist() if has_status else [None] * n
            error = batch.column("error").to_pylist() if has_status else [None] * n
            names = batch.column("model").to_pylist() if by_model else [None] * n
            models = [names[i] for i in owner]
            rows = zip(*[_to_inputs(c) for c in columns], strict=True)
            ready = [
                (row[0] if len(row) == 1 else row)
                if status[i] is None and model in parts and all(v is not None for v in row)
                else None
                for i, model, row in zip(owner, models, rows, strict=True)
            ]
            answers = _run_all(lambda model: load_runner(*parts[model]), models, ready)
            for i, (_, failure) in zip(owner, answers, strict=True):
                if failure is not None and status[i] is None:
                    status[i], error[i] = 500, failure
            values = [unpack(a) for a, _ in answers]
            made = [pa.array([v[k] for v in values], type=t) for k, t in enumerate(arrow_types)]
            if nested:
                mine = np.array([names[i] in parts and status[i] is None for i in range(n)], dtype=bool)
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"))
                made = [pa.ListArray.from_arrays(ends, m, mask=pa.array(~(valid & mine))) for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in [*keep, *echo]] + made + [pa.array(status, pa.int32()), pa.array(error, pa.string())],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def embed(
    df: DataFrame,
    models: Models,
    text: str = "text",
    want_dense: bool = True,
    want_sparse: bool = True,
    nested: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``dense_embed array<float>`` and ``sparse_embed map<bigint,double>``, ``status``, ``error``.

    The text column is replaced by the results unless ``keep`` names it. With ``nested`` the column
    holds a list of texts per row and so do the results. Runners that take ids get those of the
    built-in tokeniser, computed in the JVM; the reduction of token weights runs in the JVM too.
    A NULL text and a row that already has a ``status`` stay without result.
    """
    specs = _specs(models, "embed")
    keep = [c for c in df.columns if c != text] if keep is None else list(keep)
    context = [c for c in ("model", "status", "error") if c in df.columns]
    work = df.select(*dict.fromkeys([*keep, text, *context]))
    by_id = {n: s for n, s in specs.items() if s.runner_class().takes == "ids"}
    by_text = {n: s for n, s in specs.items() if s.runner_class().takes != "ids"}
    if by_id and by_text:
        # Mixed registry: each family handles the rows of its own models.
        first = embed(work, by_id, text, want_dense, want_sparse, nested, work.columns)
        first = first.withColumnsRenamed({"dense_embed": "_d1", "sparse_embed": "_s1"})
        both = embed(first, by_text, text, want_dense, want_sparse, nested, first.columns).withColumns(
            {"dense_embed": F.coalesce("_d1", "dense_embed"), "sparse_embed": F.coalesce("_s1", "sparse_embed")}
        )
        return both.drop("_d1", "_s1", *([] if text in keep else [text]))

    if by_id:
        work = work.withColumn("_in", F.transform(F.col(text), token_ids) if nested else token_ids(F.col(text)))
    else:
        work = work.withColumn("_in", F.col(text))
    if text not in keep:
        work = work.drop(text)

    wanted = ["_dense"] * want_dense + (["_ids"] * (not by_id) + ["_weights"]) * want_sparse
    slots = [list(_EMBED_FIELDS).index(name) for name in wanted]
    done = _map_runners(
        work,
        specs,
        ["_in"],
        [(name, _EMBED_FIELDS[name]) for name in wanted],
        lambda answer: tuple(answer[i] if answer is not None else None for i in slots),
        nested,
        {"_in": "_ids"} if by_id and want_sparse else None,
    )
    dense = F.col("_dense") if want_dense else F.lit(None)
    sparse = F.lit(None)
    if want_sparse:
        ids, weights = F.col("_ids"), F.col("_weights")
        sparse = F.zip_with(ids, weights, lambda i, w: token_weights(i, w)) if nested else token_weights(ids, weights)
        sparse = F.when(weights.isNotNull(), sparse)
    kinds = ("array<array<float>>", "array<map<bigint,double>>") if nested else ("array<float>", "map<bigint,double>")
    return done.withColumns({"dense_embed": dense.cast(kinds[0]), "sparse_embed": sparse.cast(kinds[1])}).drop(
        "_dense", "_ids", "_weights"
    )


def rerank(
    df: DataFrame,
    models: Models,
    query: str = "query",
    text: str = "text",
    out: str = "score",
    normalize: bool | None = None,
) -> DataFrame:
    """Add a relevance score per (query, text) row, plus ``status`` and ``error``.

    ``normalize`` maps the logits to (0, 1); by default each model's own setting decides, whichever
    way the model is run.
    """
    specs = _specs(models, "rerank")
    logits = _dispatch(df, specs, [query, text], out, "double", lambda r, d: r.apply(d, query, text, out))
    flags = {name: s.kwargs.get("normalize", False) if normalize is None else normalize for name, s in specs.items()}
    if not any(flags.values()):
        return logits
    mapped = sigmoid(F.col(out))
    if not all(flags.values()):
        mapped = F.when(F.col("model").isin([n for n, on in flags.items() if on]), mapped).otherwise(F.col(out))
    return logits.withColumn(out, mapped)


@dataclass(frozen=True)
class ScoreHead:
    """Weights of ``tanh(cls . W^T + b) . w_out + b_out``; one matrix product per batch, whatever their number."""

    w: Sequence[Sequence[float]]
    b: Sequence[float]
    w_out: Sequence[float]
    b_out: float

    def column(self, cls: Column) -> Column:
        return score_head_udf(self.w, self.b, self.w_out, self.b_out)(cls)


def rerank_encoded(
    df: DataFrame,
    spec: RunnerSpec,
    head: ScoreHead,
    query: str = "query",
    text: str = "text",
    out: str = "score",
    normalize: bool = False,
) -> DataFrame:
    """Rerank with the head outside the model: the runner gives one vector per pair."""
    specs = _specs(spec, "rerank")
    work = df.withColumns({"_in0": F.col(query), "_in1": F.col(text)})
    done = _map_runners(work, specs, ["_in0", "_in1"], [("_cls", "array<double>")], lambda a: (a,))
    score = head.column(F.col("_cls"))
    score = sigmoid(score) if normalize else score
    return done.withColumn(out, F.when(F.col("_cls").isNotNull(), score)).drop("_cls")


def rewrite(df: DataFrame, models: Models, turns: str = "turns", out: str = "rewritten") -> DataFrame:
    """Add the rewritten query of a dialogue (``array<string>``, latest turn last)."""
    specs = _specs(models, "rewrite")
    return _dispatch(df, specs, [turns], out, "string", lambda r, d: r.apply(d, turns, out))


def _dispatch(
    df: DataFrame,
    specs: dict[str | None, RunnerSpec],
    inputs: list[str],
    out: str,
    out_type: str,
    apply: Callable[[object, DataFrame], DataFrame],
) -> DataFrame:
    """Column runners as expressions, the rest behind one ``mapInArrow``; the model name selects."""
    in_python = {n: s for n, s in specs.items() if not s.is_column}
    value = F.lit(None).cast(out_type)
    done, made = df, []
    # Column runners of one class differ in score normalisation only: evaluate each class once.
    for cls in dict.fromkeys(s.runner_class() for s in specs.values() if s.is_column):
        names = [n for n, s in specs.items() if s.runner_class() is cls]
        spec = specs[names[0]]
        column = f"_r{len(made)}"
        done = apply(cls(batch_size=spec.batch_size, **spec.kwargs), done).withColumnRenamed(out, column)
        made.append(column)
        value = F.col(column) if names == [None] else F.when(F.col("model").isin(names), F.col(column)).otherwise(value)
    if in_python:
        done = done.withColumns({f"_in{i}": F.col(c) for i, c in enumerate(inputs)})
        done = _map_runners(
            done, in_python, [f"_in{i}" for i in range(len(inputs))], [("_python", out_type)], lambda a: (a,)
        )
        value = F.coalesce(F.col("_python"), value)
        made.append("_python")
    for name, kind in (("status", "int"), ("error", "string")):
        if name not in done.columns:
            done = done.withColumn(name, F.lit(None).cast(kind))
    return done.withColumn(out, F.when(F.col("status").isNull(), value)).drop(*made)


def length_bucket_order(df: DataFrame, text: str = "text", partitions: int | None = None) -> DataFrame:
    """Longest texts first inside each partition, so that a batch pads to similar lengths.

    The results carry their keys, so no inverse permutation is needed afterwards.
    """
    rows = df.repartition(partitions) if partitions else df
    sized = rows.withColumn("_tokens", F.size(tokens(F.col(text))))
    return sized.sortWithinPartitions(F.desc("_tokens")).drop("_tokens")


def token_batches(
    df: DataFrame, row_id: str, text: str = "text", budget: int = 16_384, step: int = 64, out: str = "batch_no"
) -> DataFrame:
    """Batches of similar lengths whose padded size keeps within a token budget: adds ``out`` and ``padded_tokens``.

    A text is padded to the next multiple of ``step``; a batch holds texts of one padded length, as many as the budget admits, and
    at least one. So a batch of more than one row never holds more than ``budget`` padded tokens. Batches are numbered
    from the longest texts on. Rows find their places by ranges (``place_within``), so no length, however common, is
    numbered by one task; the table of lengths has at most one row per ``step`` tokens of the longest text. A batch stays in one partition, its rows next to each other.
    """
    size = F.size(tokens(F.col(text)))
    padded = F.greatest(F.ceil(size / step) * step, F.lit(step)).cast("bigint")
    rows = df.withColumn("padded_tokens", F.coalesce(padded, F.lit(step).cast("bigint")))
    placed = place_within(rows, ["padded_tokens"], [row_id], "_place")
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded_tokens")), F.lit(1))
    lengths = placed.groupBy("padded_tokens").agg(F.ceil(F.count(F.lit(1)) / room).alias("_batches"))
    longer = Window.orderBy(F.desc("padded_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumn("_base", F.coalesce(F.sum("_batches").over(longer), F.lit(0))).drop("_batches")
    numbered = same_key_join(placed, lengths, ["padded_tokens"])
    numbered = numbered.withColumn(out, (F.col("_base") + F.floor(F.col("_place") / room)).cast("bigint")).drop("_place", "_base")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered.repartitionByRange(parts, out).sortWithinPartitions(out, row_id)


def gather_models(df: DataFrame, row_id: str, partitions: int, salts: int | None = None) -> DataFrame:
    """Bring the rows of a model together before inference, so that a worker loads few models.

    ``partitions`` is the least number of parts: texts of more than ``PART_BYTES`` for each, measured, get more of them.

    The models lie one after the other on a line, each as long as it has rows (counted, not guessed), and the line is cut into ``partitions``
    equal parts; a row has a place by its hash on its model's stretch. So parts are equally large whatever share one
    model has, and a part holds as few models as possible. ``salts`` deals every model over that many parts instead.
    """
    if salts is not None:
        salt = F.pmod(F.xxhash64(row_id), F.lit(salts))
        return df.withColumn("_salt", salt).repartition(partitions, "model", "_salt").drop("_salt")
    text = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c, kind in df.dtypes if kind in ("string", "binary")]
    size = F.sum(reduce(add, text, F.lit(64).cast("bigint")))
    counts = materialize(df.groupBy("model").agg(F.count(F.lit(1)).alias("_n"), size.alias("_bytes")), "model-counts")
    models, held = counts.agg(F.count(F.lit(1)), F.sum("_bytes")).first()
    partitions = max(partitions, -(-(held or 0) // PART_BYTES))
    counts = counts.drop("_bytes")
    before = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)
    line = counts.withColumns({"_from": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(F.lit(1)))})
    share = F.pmod(F.xxhash64(row_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.floor((F.col("_from") + share * F.col("_n")) / F.col("_all") * partitions).cast("int")
    # a shuffle by model would bring most texts into one task
    line = F.broadcast(line) if models <= MODELS_SENT else line
    placed = same_key_join(df, line, ["model"]).select(*df.columns, F.least(part, F.lit(partitions - 1)).alias("_part"))
    return placed.repartitionById(partitions, F.col("_part")).drop("_part")


def dedup_infer(
    df: DataFrame,
    infer: Callable[[DataFrame], DataFrame],
    text: str,
    row_id: str,
    results: list[str],
    model: str | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Run ``infer`` once per distinct (model, text) and join the results back to every row.

    The rows meet their results by a hash of the text; the text itself stays behind unless
    ``keep_text`` asks for it, so it is not shuffled a second time.

    Copies of one text may be a third of the table: the distinct step counts them with partial
    aggregation, and the join back splits such texts (see ``spread_lookup``).
    """
    names = [c for c in (model, text) if c]
    # every part says whether it is NULL and how long it is, so no two different rows share a key
    marked = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in names]
    key = F.sha2(F.concat(*[F.coalesce(m, F.lit("-")) for m in marked]), 256)
    distinct = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_key", key)
    answers = infer(distinct).select("_key", "_copies", *results)
    rows = df.withColumn("_key", key)
    rows = rows if keep_text else rows.drop(text)
    joined = spread_lookup(rows, answers, "_key", "_copies", [row_id], counts=distinct)
    return joined.drop("_key", "_copies")


def fallback_scores(df: DataFrame, key: str = "request_id", score: str = "score", fallback: float = 1.0) -> DataFrame:
    """Where any pair of a request failed, every score of that request becomes ``fallback``.

    The scores are written out first, because they are read twice and must not be inferred twice.
    The failed requests are found by a pre-aggregated grouping; scores are never windowed per
    request, so a huge request is not pulled into one task.
    """
    # rows without a request id are one request of their own
    df = materialize(df, "scores").withColumn("_request", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")))
    failed = (
        df.groupBy("_request")
        .agg(F.count_if(F.col("status") == 500).alias("_failures"), F.count(F.lit(1)).alias("_rows"))
    )
    joined = spread_lookup(df, failed, "_request", "_rows", ["pos"])
    lost = F.col("_failures") > 0
    return joined.withColumns(
        {score: F.when(lost, F.lit(fallback)).otherwise(F.col(score)), "fell_back": lost}
    ).drop("_failures", "_rows", "_request")
