"""Arithmetic on dense vectors (arrays), sparse weights (maps) and scores."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.binding import bind, bind_all
from quillmesh.functions.text import SPECIAL_IDS

NAN = float("nan")
INF = float("inf")


def token_weights(ids: Column, weights: Column, special: Sequence[int] = SPECIAL_IDS) -> Column:
    """Token id -> largest positive weight; special ids dropped; empty map when nothing is left.

    Runs inside the row (sort, then keep the first of each run), so no shuffle is needed.
    """
    pairs = F.zip_with(ids, weights, lambda i, w: F.struct(i.alias("id"), (-w).alias("neg")))
    kept = F.filter(pairs, lambda p: (p["neg"] < 0) & ~p["id"].isin(list(special)))
    firsts = bind(
        F.sort_array(kept),
        lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["id"] != p["id"])),
    )
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["id"], -p["neg"])))


#: Words that ``word_weights`` handles at a time.
WORDS_AT_ONCE = 1 << 20


@functools.lru_cache(1 << 17)
def _word_id(word: bytes) -> int:
    """``token_id`` of one word; a worker keeps those of its recent words."""
    return int(hashlib.md5(word).hexdigest()[:15], 16)


def _largest_weights(words: pa.ListArray, weights: pa.ListArray, special: Sequence[int]) -> pa.Array:
    """``word_weights`` of a few rows: ids are made once per distinct word, weights reduced by one sort."""
    missing = np.asarray(words.is_null()) | np.asarray(weights.is_null())
    lengths = np.where(missing, 0, np.diff(words.offsets.to_numpy()))
    if missing.any():
        words, weights = (x.filter(pa.array(~missing)) for x in (words, weights))
    coded = words.flatten().dictionary_encode()
    known = np.array([_word_id(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    ids, place = np.unique(known, return_inverse=True)
    # one number per (row, id), in the order of both
    cell = np.repeat(np.arange(len(lengths)), lengths) * max(len(ids), 1) + place[coded.indices.to_numpy()]
    weight = weights.flatten().to_numpy(zero_copy_only=False).astype(float)
    kept = (weight > 0) & ~np.isin(ids, np.array(special, np.int64))[cell % max(len(ids), 1)]
    cell, weight = cell[kept], weight[kept]
    order = np.argsort(cell)
    cell, weight = cell[order], weight[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    row, at = np.divmod(cell[first], max(len(ids), 1))
    largest = np.maximum.reduceat(weight, first) if len(first) else weight
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(lengths)))).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(ends, mask=np.append(missing, False)), pa.array(ids[at]), pa.array(largest))


def word_weights(words: Column, weights: Column, special: Sequence[int] = SPECIAL_IDS) -> Column:
    """``token_weights`` of the ids of a list of words (``token_id``), in Arrow batches.

    For whole texts: ids are computed per distinct word and not per occurrence. The workers need this package
    (``ship_package``); inside lambdas, where no Python function can stand, use ``token_weights``.
    """

    def run(words: pa.Array, weights: pa.Array) -> pa.Array:
        ends = np.cumsum(np.diff(words.offsets.to_numpy()))
        cuts = [0, *(np.flatnonzero(np.diff(ends // WORDS_AT_ONCE)) + 1).tolist(), len(words)]
        parts = [_largest_weights(words.slice(a, b - a), weights.slice(a, b - a), special) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.map_(pa.int64(), pa.float64()))

    return F.arrow_udf(run, "map<bigint,double>")(words, weights)


def trim_colbert(vecs: Column, mask: Column) -> Column:
    """Token vectors without padding: the first ``sum(mask) - 1``."""
    attended = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m.cast("int"))
    return F.slice(vecs, F.lit(1), F.greatest(attended - 1, F.lit(0)))


def common_values(left: Column, right: Column) -> Column:
    """``array<struct<key, l, r>>`` of the keys two maps share, in the order of the left one; keys meet by their hash."""

    def held(side: Column) -> Column:
        # a struct around each value tells a null value from an absent key
        return F.transform_values(side, lambda _, v: F.struct(v.alias("v")))

    def entry(key: Column, l: Column, r: Column) -> Column:  # noqa: E741
        return F.when(l.isNotNull() & r.isNotNull(), F.struct(key.alias("key"), l["v"].alias("l"), r["v"].alias("r")))

    return F.filter(F.map_values(F.map_zip_with(held(left), held(right), entry)), lambda e: e.isNotNull())


def common_entries(left: Column, right: Column) -> Column:
    """The same of two lists of ``struct<key, value>``, each with distinct keys, by key.

    Both lists are sorted together, so that equal keys become neighbours: looking each key up
    in the other list would cost the product of the sizes.
    """

    def tagged(entries: Column, side: int) -> Column:
        return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit(side).alias("side"), e["value"].alias("value")))

    def neighbours(s: Column) -> Column:
        pairs = F.transform(
            s,
            lambda e, i: F.when(
                F.get(s, i + 1)["key"] == e["key"],
                F.struct(e["key"].alias("key"), e["value"].alias("l"), F.get(s, i + 1)["value"].alias("r")),
            ),
        )
        return F.filter(pairs, lambda p: p.isNotNull())

    merged = F.concat(tagged(left, 0), tagged(right, 1))
    return bind(F.sort_array(merged), neighbours)


def lexical_score(left: Column, right: Column) -> Column:
    """Sum of weight products over the common tokens of two sparse maps; 0.0 when there are none."""
    return F.aggregate(common_values(left, right), F.lit(0.0), lambda acc, e: acc + e["l"] * e["r"])


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def score_head(
    cls: Column,
    w: Sequence[Sequence[float]],
    b: Sequence[float],
    w_out: Sequence[float],
    b_out: float,
) -> Column:
    """``tanh(cls . W^T + b) . w_out + b_out`` for small weight tables."""
    hidden = []
    for row, bias in zip(w, b, strict=True):
        weights = F.array(*[F.lit(float(v)) for v in row])
        hidden.append(F.tanh(dot(cls, weights) + F.lit(float(bias))))
    total = F.lit(float(b_out))
    for h, weight in zip(hidden, w_out, strict=True):
        total = total + h * F.lit(float(weight))
    return total


def score_head_udf(w, b, w_out, b_out: float):
    """Same head for large weights: one matrix product per Arrow batch.

    Use it as ``df.withColumn('score', score_head_udf(...)(F.col('cls')))``.
    """
    w, b, w_out = (np.asarray(x, dtype="float64") for x in (w, b, w_out))

    @F.pandas_udf("double")
    def head(cls: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=cls.index, dtype="float64").astype("Float64")
        known = cls.notna().to_numpy()
        if known.any():
            out[known] = np.tanh(np.stack(cls[known].to_numpy()) @ w.T + b) @ w_out + b_out
        return out

    return head


def dense_metrics(a: Column, b: Column) -> Column:
    """Cosine, Euclidean distance, norm difference, MSE and MAE of two equally long vectors.

    One pass over the zipped vectors. A zero norm gives NaN for the cosine.
    """
    return bind_all([a, b], _dense_metrics)


def _dense_metrics(a: Column, b: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("ab", "aa", "bb", "sq", "ad")])

    def step(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["ab"] + p["x"] * p["y"]).alias("ab"),
            (acc["aa"] + p["x"] * p["x"]).alias("aa"),
            (acc["bb"] + p["y"] * p["y"]).alias("bb"),
            (acc["sq"] + (p["x"] - p["y"]) * (p["x"] - p["y"])).alias("sq"),
            (acc["ad"] + F.abs(p["x"] - p["y"])).alias("ad"),
        )

    def finish(acc: Column) -> Column:
        norms = F.sqrt(acc["aa"]) * F.sqrt(acc["bb"])
        return F.struct(
            F.coalesce(F.try_divide(acc["ab"], norms), F.lit(NAN)).alias("cosine_similarity"),
            F.sqrt(acc["sq"]).alias("euclidean_distance"),
            F.abs(F.sqrt(acc["aa"]) - F.sqrt(acc["bb"])).alias("l2_norm_difference"),
            F.coalesce(F.try_divide(acc["sq"], F.size(a)), F.lit(NAN)).alias("mse"),
            F.coalesce(F.try_divide(acc["ad"], F.size(a)), F.lit(NAN)).alias("mae"),
        )

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, zero, step, finish)


def sparse_metrics(a: Column, b: Column) -> Column:
    """Key Jaccard, key counts, and value MSE / MAE over the common keys of two sparse maps."""
    return bind_all([a, b], _sparse_metrics)


def _sparse_metrics(a: Column, b: Column) -> Column:
    return bind(common_values(a, b), lambda common: _value_metrics(a, b, common))


def _value_metrics(a: Column, b: Column, common: Column) -> Column:
    n, na, nb = (F.size(x).cast("bigint") for x in (common, a, b))

    def mean(term) -> Column:
        total = F.aggregate(common, F.lit(0.0), lambda acc, e: acc + term(e["l"] - e["r"]))
        return F.coalesce(F.try_divide(total, n), F.lit(INF))

    return F.struct(
        F.coalesce(F.try_divide(n, na + nb - n), F.lit(0.0)).alias("jaccard_similarity"),
        n.alias("common_keys_count"),
        na.alias("generated_keys_count"),
        nb.alias("reference_keys_count"),
        mean(lambda d: d * d).alias("value_mse"),
        mean(F.abs).alias("value_mae"),
    )
