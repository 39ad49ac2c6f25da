"""Lexical weights over a corpus, token maps, and lexical matching scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.binding import bind
from quillmesh.functions.text import SPECIAL_IDS, token_id, tokens
from quillmesh.functions.vectors import lexical_score
from quillmesh.operators.skew import PAIRS_PER_TASK, gather_pairs, grid_join, grid_shape, spread_join, spread_lookup

# Fixed value: how fast an occurrence loses weight with its position.
POSITION_SCALE = 512.0


def fit_lexical(df: DataFrame, text: str = "text") -> DataFrame:
    """Vocabulary ``(token, token_id, df, idf)`` of a corpus; one shuffle of pre-aggregated counts."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = (
        df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return counts.select(
        "token", token_id(F.col("token")).alias("token_id"), "df", inverse_frequency(total, F.col("df")).alias("idf")
    )


def inverse_frequency(total: Column, df: Column) -> Column:
    """``ln((N + 1) / (df + 1)) + 1``."""
    return F.log((total + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def first_positions(text: Column) -> Column:
    """Distinct tokens of a text with their first position: ``array<struct<token, pos>>``."""
    return first_places(tokens(text))


def first_places(words: Column) -> Column:
    """The same of a token list."""
    located = F.transform(words, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    return bind(
        F.sort_array(located),
        lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["token"] != p["token"])),
    )


def lexical_postings(
    df: DataFrame, vocab: DataFrame, corpus_rows: Column, row_id: str, text: str = "text", in_corpus: bool = True, stored: bool = False, counts: DataFrame | None = None
) -> DataFrame:
    """Long-form sparse weights ``(row_id, token_id, weight)``.

    The weight of an occurrence is ``idf / (1 + pos / 512)`` and a token keeps its largest one,
    which is that of its first occurrence, so the reduction happens inside the row before any
    row is emitted. ``in_corpus=False`` also scores tokens the corpus does not have. ``stored``: ``df`` is the
    corpus and ``vocab`` its stored vocabulary, or a stored part of it (see ``spread_lookup``); ``counts`` is the whole one where ``vocab`` is a part
    of it, to leave out the tokens of others.
    """
    found = df.select(row_id, F.explode(first_positions(F.col(text))).alias("p")).select(
        row_id, F.col("p.token").alias("token"), F.col("p.pos").alias("pos")
    )
    if in_corpus:
        joined = spread_lookup(found, vocab, "token", "df", [row_id], counts=counts, stored=stored)
        idf, tid = F.col("idf"), F.col("token_id")
    else:
        joined = spread_lookup(found, vocab, "token", "df", [row_id], how="left")
        idf = F.coalesce(F.col("idf"), inverse_frequency(corpus_rows, F.lit(0.0)))
        tid = F.coalesce(F.col("token_id"), token_id(F.col("token")))
    return joined.select(
        row_id, tid.alias("token_id"), (idf / (F.lit(1.0) + F.col("pos") / POSITION_SCALE)).alias("weight")
    )


def long_form(df: DataFrame, row_id: str, sparse: str) -> DataFrame:
    """Map column -> rows ``(row_id, token_id, weight)``.

    The empty maps are dropped after the generator: an inner explode would have the optimiser push
    a size check, and with it a second evaluation of the map, below every projection.
    """
    rows = df.select(row_id, F.explode_outer(sparse).alias("token_id", "weight"))
    return rows.where(F.col("token_id").isNotNull())


def lexical_weights(postings: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Map form ``(row_id, sparse_embed)``; rows of ``ids`` without tokens get an empty map.

    A group holds the distinct tokens of one text.
    """
    maps = postings.groupBy(row_id).agg(
        F.map_from_entries(F.collect_list(F.struct("token_id", "weight"))).alias("sparse_embed")
    )
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))
    return ids.select(row_id).join(maps, row_id, "left").withColumn(
        "sparse_embed", F.coalesce(F.col("sparse_embed"), empty)
    )


def token_weights_long(
    df: DataFrame, row_id: str, special: Sequence[int] = SPECIAL_IDS
) -> DataFrame:
    """Largest positive weight per (row, token) from long occurrence rows ``(row_id, token_id, weight)``."""
    return (
        df.where((F.col("weight") > 0) & ~F.col("token_id").isin(list(special)))
        .groupBy(row_id, "token_id")
        .agg(F.max("weight").alias("weight"))
    )


def id_to_token(postings: DataFrame, vocab: DataFrame, row_id: str) -> DataFrame:
    """Long-form weights keyed by token text; ids the vocabulary does not know are skipped.

    Where two ids share a token text the weight of the larger id is kept. ``vocab`` needs
    ``token_id, token, df``.
    """
    named = spread_lookup(postings, vocab.select("token_id", "token", "df"), "token_id", "df", [row_id])
    return named.groupBy(row_id, "token").agg(F.max_by("weight", "token_id").alias("weight"))


def lexical_score_matrix(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, key_rows: DataFrame | None = None, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Non-zero cells ``(left_id, right_id, score)`` of the matching-score matrix.

    Inputs are long-form weights. A posting-list join on the token in a grid of blocks of left and right ids: lists are
    split over the blocks, and a pair's products are added up in the task that makes them (see ``grid_join``). Where so few
    pairs share a token that repeating the rows for a grid would move more than the pairs, only tokens that are frequent are split (see
    ``spread_join``), and pairs are shuffled to their sums (see ``gather_pairs``). Either way there are as many tasks as the pairs
    need. ``key_rows`` is ``(token_id, n_left, n_right)`` of the shared tokens, stored; rows of other tokens are best left out then.
    Absent cells are 0; ask for single cells with ``lexical_score_pairs``.
    """
    a = left.select("token_id", left_id, F.col("weight").alias("_wl"))
    b = right.select("token_id", right_id, F.col("weight").alias("_wr"))
    if key_rows is None:
        n_left = a.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_left"))
        n_right = b.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_right"))
        key_rows = n_left.join(n_right, "token_id")
        # rows of other tokens meet nothing
        a, b = (side.join(key_rows.select("token_id"), "token_id", "left_semi") for side in (a, b))
    score = F.sum(F.col("_wl") * F.col("_wr")).alias("score")
    nl, nr = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    sizes = key_rows.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in (nl, nr, nl * nr)]).first()
    shape = grid_shape(*sizes, key_rows.sparkSession.sparkContext.defaultParallelism, pairs_per_task)
    if shape:
        return grid_join(a, b, "token_id", left_id, right_id, *shape).groupBy(left_id, right_id, "_cell").agg(score).drop("_cell")
    pairs = gather_pairs(spread_join(a, b, "token_id", left_id, right_id, key_rows), left_id, right_id, key_rows, pairs_per_task)
    return pairs.groupBy(left_id, right_id).agg(score)


def lexical_score_pairs(df: DataFrame, left: str, right: str, out: str = "score") -> DataFrame:
    """Score of two sparse maps in the same row, 0.0 without common tokens."""
    return df.withColumn(out, lexical_score(F.col(left), F.col(right)))
