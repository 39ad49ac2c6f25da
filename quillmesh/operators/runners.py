"""Model runners.

A runner maps a list of inputs to a list of equally many outputs. The shipped ones are
deterministic stand-ins for neural models (feature hashing, positional weights, a small scoring
head); real models attach by path through the ONNX runners or any class given by
``register_runner``.

Python runners (``run(list) -> list``) are called per Arrow batch inside the workers.
Column runners (``column(...) -> Column``) are plain Spark expressions and never leave the JVM.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.binding import bind, bind_all
from quillmesh.functions.text import PAD_ID, tokens
from quillmesh.functions.vectors import common_entries, score_head
from quillmesh.operators.lexical import POSITION_SCALE, first_places

MODEL_TYPES = ("embed", "rerank", "rewrite")


class EmbedRunner:
    """``run`` returns one ``(dense, ids, weights)`` triple per text; absent parts are None.

    ``ids`` may stay None when the runner takes ids itself.
    """

    takes = "text"
    supports_dense = True
    supports_sparse = True

    def run(self, inputs: list) -> list[tuple]:
        raise NotImplementedError


class HashedEmbedRunner(EmbedRunner):
    """Signed feature hashing of token ids (dense) and position weights (sparse)."""

    takes = "ids"

    def __init__(self, batch_size: int = 12, dim: int = 64) -> None:
        self.batch_size = batch_size
        self.dim = dim

    def run(self, inputs: list[np.ndarray]) -> list[tuple]:
        lengths = np.array([len(ids) for ids in inputs], dtype="int64")
        dense = sparse = [None] * len(inputs)
        if self.supports_dense:
            flat = np.concatenate(inputs).astype("int64") if lengths.sum() else np.zeros(0, "int64")
            row = np.repeat(np.arange(len(inputs)), lengths)
            sign = 1.0 - 2.0 * ((flat // self.dim) % 2)
            sums = np.bincount(
                row * self.dim + flat % self.dim, weights=sign, minlength=len(inputs) * self.dim
            ).reshape(len(inputs), self.dim)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            dense = list(np.divide(sums, norm, out=np.zeros(sums.shape), where=norm > 0))
        if self.supports_sparse:
            sparse = [1.0 / (1.0 + np.arange(n) / 512.0) for n in lengths]
        return [(d, None, w) for d, w in zip(dense, sparse)]


class HashedDenseRunner(HashedEmbedRunner):
    supports_sparse = False


class PositionalSparseRunner(HashedEmbedRunner):
    supports_dense = False


class OnnxRunner:
    """Session and tokeniser of an ONNX model, opened in the worker.

    ``fixed_batch`` always feeds ``batch_size`` rows, filling up with empty texts whose results are
    dropped, for models exported with a fixed shape (use ``padding='max_length'`` with it).
    """

    truncation_strategy = "longest_first"

    def __init__(
        self,
        model_path: str,
        tokenizer_path: str,
        batch_size: int = 12,
        max_length: int = 512,
        padding: str = "longest",
        truncation: bool = True,
        fixed_batch: bool = False,
        providers: list[str] | None = None,
    ) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        self.batch_size = batch_size
        self.fixed_batch = fixed_batch
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.enable_padding(pad_id=PAD_ID, length=max_length if padding == "max_length" else None)
        if truncation:
            self.tokenizer.enable_truncation(max_length, strategy=self.truncation_strategy)
        self.session = onnxruntime.InferenceSession(model_path, providers=providers or ["CPUExecutionProvider"])

    def outputs(self, inputs: list, filler) -> tuple[np.ndarray, list[np.ndarray]]:
        """Token ids and model outputs of the inputs."""
        n = len(inputs)
        rows = list(inputs) + [filler] * (self.batch_size - n if self.fixed_batch else 0)
        encoded = self.tokenizer.encode_batch(rows)
        ids = np.array([e.ids for e in encoded], dtype="int64")
        mask = np.array([e.attention_mask for e in encoded], dtype="int64")
        found = self.session.run(None, {"input_ids": ids, "attention_mask": mask})
        if not found:
            raise RuntimeError("the model gave no output")
        return ids[:n], [np.asarray(o)[:n] for o in found]


class OnnxEmbedRunner(OnnxRunner, EmbedRunner):
    """Output 0 is the dense vector; output 1, if there is one, holds the token weights."""

    def __init__(self, *args, max_length: int = 8192, truncation: bool = False, **kwargs) -> None:
        super().__init__(*args, max_length=max_length, truncation=truncation, **kwargs)

    def run(self, inputs: list[str]) -> list[tuple]:
        ids, found = self.outputs(inputs, "")
        dense = found[0].reshape(len(inputs), -1)
        if len(found) < 2:
            return [(d, ids[i, :0], np.zeros(0)) for i, d in enumerate(dense)]
        weights = found[1].reshape(len(inputs), -1)
        return [(d, ids[i], weights[i]) for i, d in enumerate(dense)]


class OnnxRerankRunner(OnnxRunner):
    """Cross-encoder with its head inside the graph; ``normalize`` is applied by ``rerank``."""

    def __init__(self, *args, normalize: bool = False, **kwargs) -> None:
        super().__init__(*args, **kwargs)

    def run(self, inputs: list[tuple[str, str]]) -> list[float]:
        _, found = self.outputs(inputs, ("", ""))
        return [float(v) for v in found[0].reshape(-1)]


class OnnxPairEncoderRunner(OnnxRunner):
    """Encoder without a head: the vector of the first token of a pair. Only the text is shortened."""

    truncation_strategy = "only_second"

    def run(self, inputs: list[tuple[str, str]]) -> list[np.ndarray]:
        _, found = self.outputs(inputs, ("", ""))
        return list(found[0][:, 0, :].astype("float64"))


# The stand-in scoring head (4 features -> 4 hidden units -> 1 logit).
HEAD_W = [
    [1.5, 0.5, 1.0, 0.25],
    [-0.75, 1.25, 0.5, 0.5],
    [0.5, 2.0, -0.5, -0.25],
    [1.0, -0.5, 1.5, 0.75],
]
HEAD_B = [-0.25, 0.0, 0.125, -0.5]
HEAD_W_OUT = [2.0, 1.0, 0.5, 1.5]
HEAD_B_OUT = -1.0
# Words looked at to find the places of shared tokens one by one; beyond that both texts are sorted.
LOOK_UPS = 1 << 17


def with_result(df: DataFrame, out: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator, so that no filter above it repeats the computation."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(out)))))


class HeadRerankRunner:
    """Four overlap features of a pair and the scoring head, as one Spark expression.

    Features: position-weighted overlap, token Jaccard, share of query tokens found, length ratio.
    """

    def __init__(self, batch_size: int = 12, normalize: bool = False) -> None:
        self.batch_size = batch_size
        self.normalize = normalize

    @staticmethod
    def features(query: Column, text: Column) -> Column:
        def places(words: Column) -> Column:
            return F.transform(first_places(words), lambda p: F.struct(p["token"].alias("key"), p["pos"].alias("value")))

        def of_tokens(q: Column, d: Column) -> Column:
            return bind_all([F.array_distinct(q), F.array_distinct(d)], lambda uq, ud: of_distinct(q, d, uq, ud))

        def of_distinct(q: Column, d: Column, uq: Column, ud: Column) -> Column:
            return bind(F.sort_array(F.array_intersect(uq, ud)), lambda shared: of_shared(q, d, F.size(uq), F.size(ud), shared))

        def of_shared(q: Column, d: Column, n_q: Column, n_d: Column, shared: Column) -> Column:
            def place(words: Column, word: Column) -> Column:
                return F.array_position(words, word) - 1

            looked_up = F.transform(shared, lambda t: F.struct(place(q, t).alias("l"), place(d, t).alias("r")))
            sorted_ = F.transform(common_entries(places(q), places(d)), lambda e: F.struct(e["l"].cast("bigint").alias("l"), e["r"].cast("bigint").alias("r")))
            few = F.size(shared).cast("bigint") * (F.size(q) + F.size(d)) <= LOOK_UPS
            return bind(F.when(few, looked_up).otherwise(sorted_), lambda common: of_overlap(q, d, n_q, n_d, common))

        def weight(pos: Column) -> Column:
            return F.lit(1.0) / (F.lit(1.0) + pos / F.lit(POSITION_SCALE))

        def ratio(a: Column, b: Column) -> Column:
            return F.coalesce(F.try_divide(a, b), F.lit(0.0))

        def of_overlap(q: Column, d: Column, n_q: Column, n_d: Column, common: Column) -> Column:
            overlap = F.aggregate(common, F.lit(0.0), lambda acc, e: acc + weight(e["l"]) * weight(e["r"]))
            n_common = F.size(common)
            return F.array(
                ratio(overlap, n_q),
                ratio(n_common, n_q + n_d - n_common),
                ratio(n_common, n_q),
                ratio(F.least(F.size(q), F.size(d)), F.greatest(F.size(q), F.size(d))),
            )

        return bind_all([tokens(query), tokens(text)], of_tokens)

    def apply(self, df: DataFrame, query: str, text: str, out: str) -> DataFrame:
        logit = bind(
            self.features(F.col(query), F.col(text)),
            lambda f: score_head(f, HEAD_W, HEAD_B, HEAD_W_OUT, HEAD_B_OUT),
        )
        return with_result(df, out, logit)


class ContextRewriteRunner:
    """Last utterance followed by the earlier words it lacks; no word of either is cut off.

    Earlier words count when they have four letters or more; they come in the order of their
    first appearance. Turns are read as they are: a separator inside a turn is part of it.
    """

    MIN_WORD = 4

    def __init__(self, batch_size: int = 256) -> None:
        self.batch_size = batch_size

    def apply(self, df: DataFrame, turns: str, out: str) -> DataFrame:
        def of_turns(said: Column) -> Column:
            before = F.slice(said, F.lit(1), F.size(said) - 1)
            return bind_all([tokens(F.element_at(said, -1)), F.transform(before, tokens)], of_tokens)

        def of_tokens(last: Column, before: Column) -> Column:
            long_words = F.filter(F.flatten(before), lambda w: F.char_length(w) >= self.MIN_WORD)
            words = F.concat(last, F.array_except(long_words, last))
            return F.array_join(words, " ")

        return with_result(df, out, bind(F.filter(F.col(turns), lambda t: t.isNotNull()), of_turns))


RUNNERS: dict[str, dict[str, Any]] = {
    "embed": {
        "HashedEmbedRunner": HashedEmbedRunner,
        "HashedDenseRunner": HashedDenseRunner,
        "PositionalSparseRunner": PositionalSparseRunner,
        "OnnxEmbedRunner": OnnxEmbedRunner,
    },
    "rerank": {
        "HeadRerankRunner": HeadRerankRunner,
        "OnnxRerankRunner": OnnxRerankRunner,
        "OnnxPairEncoderRunner": OnnxPairEncoderRunner,
    },
    "rewrite": {"ContextRewriteRunner": ContextRewriteRunner},
}


@dataclass(frozen=True)
class RunnerSpec:
    """What a model is built from; small, hashable by content, sent to the workers."""

    model_type: str
    model_cls: str
    batch_size: int = 12
    kwargs: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"{self.model_type} is not supported")
        if "batch_size" in self.kwargs:
            raise TypeError("batch_size is a field of its own and may not be repeated in kwargs")
        self.runner_class()

    def runner_class(self):
        """A registered name, or ``package.module:Class`` for a runner of the user's own."""
        known = RUNNERS[self.model_type]
        if self.model_cls in known:
            return known[self.model_cls]
        if ":" in self.model_cls:
            module, name = self.model_cls.split(":")
            return getattr(importlib.import_module(module), name)
        raise ValueError(f"{self.model_cls} is not a known {self.model_type} runner")

    @property
    def key(self) -> str:
        return json.dumps([self.model_type, self.model_cls, self.batch_size, self.kwargs], sort_keys=True)

    @property
    def is_column(self) -> bool:
        return hasattr(self.runner_class(), "apply")

    @property
    def supports_dense(self) -> bool:
        return bool(getattr(self.runner_class(), "supports_dense", False))

    @property
    def supports_sparse(self) -> bool:
        return bool(getattr(self.runner_class(), "supports_sparse", False))


_LOADED: dict[str, Any] = {}


def load_runner(spec: RunnerSpec, runner_class: type):
    """The runner of this worker process, built on first use and kept for later tasks."""
    if spec.key not in _LOADED:
        _LOADED[spec.key] = runner_class(batch_size=spec.batch_size, **spec.kwargs)
    return _LOADED[spec.key]


def register_runner(model_type: str, runner_class: type) -> None:
    """Add a runner class under its own name (its module must be importable in the workers)."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"{model_type} is not supported")
    RUNNERS[model_type][runner_class.__name__] = runner_class


class ModelRegistry:
    """Named models per type, and their capability table."""

    def __init__(self) -> None:
        self.models: dict[tuple[str, str], RunnerSpec] = {}

    def add(self, name: str, spec: RunnerSpec) -> ModelRegistry:
        self.models[(spec.model_type, name)] = spec
        return self

    def specs(self, model_type: str) -> dict[str, RunnerSpec]:
        return {name: s for (kind, name), s in self.models.items() if kind == model_type}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (kind, name, s.model_cls, s.supports_dense, s.supports_sparse)
            for (kind, name), s in self.models.items()
        ]
        schema = "model_type string, model string, model_cls string, supports_dense boolean, supports_sparse boolean"
        return spark.createDataFrame(rows, schema)


def default_registry() -> ModelRegistry:
    """The stand-in models under the names used in the examples and tests."""
    return (
        ModelRegistry()
        .add("default", RunnerSpec("embed", "HashedEmbedRunner"))
        .add("dense_only", RunnerSpec("embed", "HashedDenseRunner"))
        .add("sparse_only", RunnerSpec("embed", "PositionalSparseRunner"))
        .add("default", RunnerSpec("rerank", "HeadRerankRunner"))
        .add("sigmoid", RunnerSpec("rerank", "HeadRerankRunner", kwargs={"normalize": True}))
        .add("default", RunnerSpec("rewrite", "ContextRewriteRunner", batch_size=256))
    )
