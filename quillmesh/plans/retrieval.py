"""Lexical matching of a query table against a corpus, and the retrieve-then-rerank composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import tokens
from quillmesh.operators.inference import rerank
from quillmesh.operators.lexical import (
    POSITION_SCALE,
    first_positions,
    fit_lexical,
    inverse_frequency,
    lexical_postings,
    lexical_score_matrix,
)
from quillmesh.operators.runners import RunnerSpec
from quillmesh.session import materialize

# Query tables up to this many characters (at most half as many postings of some 40 bytes) are
# handed to every executor; larger ones are joined by token.
SMALL_QUERY_CHARS = 4 * 1024 * 1024


def match_corpus(
    queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, small_chars: int = SMALL_QUERY_CHARS
) -> DataFrame:
    """Non-zero lexical scores ``(query_id, doc_id, score)`` with corpus-fitted weights.

    A small query table (its size is checked) travels to the corpus: every text is matched where it
    is read and all of a pair's partial sums meet in the task that holds the text, so that only
    finished scores are shuffled and no corpus-wide vocabulary is needed. Otherwise both sides are
    turned into posting lists and joined by token with long lists split (see ``lexical_score_matrix``).
    """
    chars = queries.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    if chars > small_chars:
        return _match_by_token(queries, corpus, query_id, doc_id)
    total = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = queries.select(query_id, F.explode(first_positions(F.col("text"))).alias("p")).select(
        query_id, F.col("p.token").alias("token"), F.col("p.pos").alias("_qpos")
    )
    found = corpus.select(doc_id, F.explode(first_positions(F.col("text"))).alias("p")).select(
        doc_id, F.col("p.token").alias("token"), F.col("p.pos").alias("_dpos")
    )
    wanted = asked.select("token").distinct()
    used = corpus.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    counts = used.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = inverse_frequency(total, F.col("df"))
    weighted = asked.join(F.broadcast(counts), "token").select(
        query_id, "token", idf.alias("_idf"), (idf / (F.lit(1.0) + F.col("_qpos") / POSITION_SCALE)).alias("_wq")
    )
    pairs = found.join(F.broadcast(weighted), "token")
    # the same products as those of the posting lists
    share = F.col("_wq") * (F.col("_idf") / (F.lit(1.0) + F.col("_dpos") / POSITION_SCALE))
    return pairs.groupBy(query_id, doc_id).agg(F.sum(share).alias("score"))


def _match_by_token(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    vocab = materialize(fit_lexical(corpus), "vocabulary")
    total = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    # stored, as each use would shuffle the vocabulary again
    q = materialize(lexical_postings(queries, vocab, total, query_id, in_corpus=False), "query-postings")
    n_left = q.groupBy("token_id").agg(F.count(F.lit(1)).alias("n_left"))
    key_rows = materialize(n_left.join(vocab.select("token_id", F.col("df").alias("n_right")), "token_id"), "key-rows")
    # the other tokens of both sides meet nothing; frequent ones among them, which no list of shared keys knows, would lie in one task each
    q, asked = (side.join(key_rows.select("token_id"), "token_id", "left_semi") for side in (q, vocab))
    asked = materialize(asked, "asked")
    d = lexical_postings(corpus, asked, total, doc_id, stored=True, counts=vocab)
    return lexical_score_matrix(q, d, query_id, doc_id, key_rows)


def top_k(scores: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """Best ``k`` items per group; Spark limits each group inside the tasks before shuffling."""
    best = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def retrieve_then_rerank(
    queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, runner: RunnerSpec, k: int = 10, digits: int | None = None
) -> DataFrame:
    """Lexical candidates, best ``k`` per query, scored by the reranker and ordered by it; ties break by id.

    An extension: it chains the two calls. With ``digits`` the scores are rounded before ranking, so that sums added
    in another order rank alike.
    """

    def shown(score: str) -> Column:
        return F.col(score) if digits is None else F.round(score, digits) + F.lit(0.0)

    matched = match_corpus(queries, corpus, query_id, doc_id).withColumn("score", shown("score"))
    candidates = top_k(matched, query_id, doc_id, "score", k).withColumnsRenamed(
        {"rank": "lexical_rank", "score": "lexical_score"}
    )
    few = queries.count() * k <= 1_000_000
    chosen = F.broadcast(candidates) if few else candidates
    texts = corpus.select(doc_id, F.col("text")).join(chosen, doc_id)
    asked = queries.select(query_id, F.col("text").alias("query"))
    scored = rerank(texts.join(asked, query_id), runner, "query", "text", out="rerank_score")
    scored = scored.withColumn("rerank_score", shown("rerank_score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), doc_id)
    return scored.withColumn("rerank_rank", F.row_number().over(order).cast("bigint")).select(
        query_id, doc_id, "lexical_rank", "lexical_score", "rerank_rank", "rerank_score"
    )
