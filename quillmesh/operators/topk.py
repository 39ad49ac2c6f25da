"""Exact lexical top-k that skips posting blocks by upper bounds.

The postings of a token are cut into blocks by the level of their weight, so a block's largest weight bounds every
posting in it. A query first scores the documents of its few strongest blocks in full: the k-th best of them is a
threshold no document of the answer falls below. Blocks are then read from the strongest on until what the unread
ones could add up to is less than a part of the threshold; a document seen in none of the read blocks cannot be in the answer, and
one whose partial score plus the remainder of the tokens it was not seen with stays below the threshold is dropped before it is
scored in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.lexical import POSITION_SCALE, first_positions, inverse_frequency
from quillmesh.operators.skew import gather_pairs, same_key_join, spread_join, spread_lookup
from quillmesh.session import materialize

#: Blocks per halving of a token's weight.
LEVELS = 16
#: Documents that a query's first blocks hold at least, as a multiple of k.
STARTERS = 4
#: Blocks are read until the unread ones could add this part of the threshold at most: what is read beyond the threshold
#: itself lets partial scores sort out documents before these are scored in full.
DEPTH = 0.8
#: Sums are added up in another order than by full scoring; bounds give way by this much.
SLACK = 1e-5


def _places(df: DataFrame, row_id: str) -> DataFrame:
    found = df.select(row_id, F.explode(first_positions(F.col("text"))).alias("p"))
    return found.select(row_id, F.col("p.token").alias("token"), F.col("p.pos").alias("pos"))


def posting_blocks(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, terms)`` of the tokens that both sides have, both written out.

    ``postings`` is ``(token, block, doc_id, weight)``: a corpus text's weights, of the queries' tokens only. ``terms`` is
    ``(query_id, token, weight, df)``. ``block`` names the token and the level of its weight.
    """
    asked = _places(queries, query_id)
    found = _places(corpus, doc_id).join(asked.select("token").distinct(), "token", "left_semi")
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = inverse_frequency(total, F.col("df"))
    known = materialize(counts.withColumn("idf", idf), "idf")
    damped = F.lit(1.0) + F.col("pos") / POSITION_SCALE
    level = F.floor(F.log2(damped) * LEVELS).cast("string")
    weighted = spread_lookup(found, known, "token", "df", [doc_id])
    postings = weighted.select("token", F.concat_ws("#", "token", level).alias("block"), doc_id, (F.col("idf") / damped).alias("weight"))
    terms = asked.join(known, "token").select(query_id, "token", (F.col("idf") / damped).alias("weight"), "df")
    return materialize(postings, "postings"), materialize(terms, "terms")


def block_bounds(postings: DataFrame, terms: DataFrame, query_id: str) -> DataFrame:
    """``(query_id, token, block, weight, rows, bound, rest)`` from the strongest block of a query on.

    ``bound`` is the most that a posting of the block adds to a score. ``rest`` is the most that a document can gain from this
    block and all weaker ones: the sum over tokens of their strongest block that is not stronger than this one.
    """
    blocks = postings.groupBy("token", "block").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("top"))
    pairs = terms.select(query_id, "token", "weight").join(blocks, "token")
    bounds = pairs.select(query_id, "token", "block", "weight", "rows", (F.col("weight") * F.col("top")).alias("bound"))
    of_token = Window.partitionBy(query_id, "token").orderBy(F.desc("bound"), "block")
    follows = F.coalesce(F.lead("bound").over(of_token), F.lit(0.0))
    first = F.row_number().over(of_token) == 1
    steps = bounds.withColumn("_gain", F.col("bound") - follows).withColumn("_first", F.when(first, F.col("bound")).otherwise(0.0))
    strongest = Window.partitionBy(query_id).orderBy(F.desc("bound"), "block")
    gone = F.coalesce(F.sum("_gain").over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = F.coalesce(F.sum("rows").over(strongest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_first").over(Window.partitionBy(query_id))
    return steps.select(*bounds.columns, (whole - gone).alias("rest"), before.alias("rows_before"))


def _partial(read: DataFrame, postings: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Sums ``(query_id, doc_id, score)`` over the blocks read, each posting less ``open``; hot blocks are dealt over tasks."""
    n_left = read.groupBy("block").agg(F.count(F.lit(1)).alias("n_left"), F.any_value("rows").alias("n_right"))
    left = read.select("block", query_id, F.col("weight").alias("_wq"), "open")
    cells = spread_join(left, postings.select("block", doc_id, "weight"), "block", query_id, doc_id, n_left)
    cells = gather_pairs(cells, query_id, doc_id, n_left)
    return cells.groupBy(query_id, doc_id).agg(F.sum(F.col("_wq") * F.col("weight") - F.col("open")).alias("score"))


def _in_full(pairs: DataFrame, postings: DataFrame, terms: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Whole scores of chosen ``(query_id, doc_id)`` pairs."""
    by_doc = postings.join(pairs.select(query_id, doc_id), doc_id)
    of_query = terms.select(query_id, "token", F.col("weight").alias("_wq"))
    return by_doc.join(of_query, [query_id, "token"]).groupBy(query_id, doc_id).agg(F.sum(F.col("_wq") * F.col("weight")).alias("score"))


def _best(scores: DataFrame, query_id: str, doc_id: str, k: int, shown: Column) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scores.withColumn("score", shown).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def candidates(postings: DataFrame, terms: DataFrame, query_id: str, doc_id: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(pairs, read)``: the pairs that can be in a query's top k, and the blocks read to find them."""
    bounds = materialize(block_bounds(postings, terms, query_id), "bounds")
    first = bounds.where(F.col("rows_before") < k * STARTERS).withColumn("open", F.lit(0.0))
    starters = _in_full(_partial(first, postings, query_id, doc_id), postings, terms, query_id, doc_id)
    kth = _best(starters, query_id, doc_id, k, F.col("score")).where(F.col("rank") == k).select(query_id, (F.col("score") - SLACK).alias("least"))
    judged = same_key_join(bounds, kth, [query_id], "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    judged = judged.withColumn("read", F.col("rest") >= F.col("least") * DEPTH)
    # what a document may still gain from the unread blocks of a token; a token seen in a read block gains nothing more
    unread = F.max(F.when(~F.col("read"), F.col("bound"))).over(Window.partitionBy(query_id, "token"))
    judged = materialize(judged.withColumn("open", F.coalesce(unread, F.lit(0.0))), "judged")
    read = judged.where("read")
    rests = judged.groupBy(query_id).agg(F.coalesce(F.max(F.when(~F.col("read"), F.col("rest"))), F.lit(0.0)).alias("_rest"), F.any_value("least").alias("_least"))
    seen = same_key_join(_partial(read, postings, query_id, doc_id), rests, [query_id])
    return seen.where(F.col("score") + F.col("_rest") >= F.col("_least")).select(query_id, doc_id), read


def lexical_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """The ``k`` best documents of every query, ``(query_id, doc_id, score, rank)``; documents without a common token have no row.

    Equal to scoring everything; ties break by id. With ``digits`` (5 at least) scores are rounded before they are ranked.
    Rows of a NULL or empty text take no part. Ids are unique in either table, as the bounds count a token once per document.
    """
    postings, terms = posting_blocks(queries, corpus, query_id, doc_id)
    pairs, _ = candidates(postings, terms, query_id, doc_id, k)
    shown = F.col("score") if digits is None else F.round("score", digits) + F.lit(0.0)
    return _best(_in_full(pairs, postings, terms, query_id, doc_id), query_id, doc_id, k, shown).select(query_id, doc_id, "score", "rank")
