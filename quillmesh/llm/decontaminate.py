"""Benchmark decontamination as a prefix-filtered set join. DataFrame functions only.

Every window of an item (13 consecutive words; a shorter item is one window) is a set that a document must contain
whole, so one token of it, its rarest by exact counts over all documents, is a necessary prefix. Documents' words meet
these prefix tokens only. A match aligns the item with the document; after bounds on length and position the
item-sized stretch of the document is compared word by word, and runs of equal words of at least a window's length
are occurrences. Words are compared with A-Z lowered; the join itself uses the fully lowered word, which is equal
wherever those are.

Matches carry numbers only - document, item and the shift between them - and are made distinct; a document's text joins its
shifts once. Item tables and shifts are broadcast only below ``BROADCAST_BYTES``, measured; beyond that they are shuffled. Both
ways give the same rows.

Defined cases: null text has no words; an item without words has no window; items that repeat an id count once; an
item without an id makes words hit but is not counted; a repeated document row is kept, with its own result;
a row with a null id is kept. Empty documents give no rows, an empty benchmark gives rows without hits. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialize

WINDOW = 13
BROADCAST_BYTES = 32 << 20
# everything between words before A-Z is lowered
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, ASCII letters and non-ASCII characters; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATORS), "")


def _items(bench: DataFrame, window: int) -> DataFrame:
    """``item_id, words, w, item`` of the distinct items that have words; ``w`` is the window's length, ``item`` a hash."""
    own = F.transform(words(F.col("text")), lambda x: F.translate(x, _UPPER, _LOWER))
    items = bench.select(F.col("item_id"), own.alias("words")).where(F.size("words") > 0).distinct()
    key = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("-")), F.array_join("words", " "))
    return items.withColumns({"w": F.least(F.size("words"), F.lit(window)), "item": key})


def _sent(df: DataFrame, size: Column) -> tuple[DataFrame, bool]:
    """The table with a broadcast hint if its measured size is within the bound."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return (F.broadcast(df), True) if total <= BROADCAST_BYTES else (df, False)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("raw"))


def prefix_tokens(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``token, at, item``: for every window of every item its rarest word, and that word's place."""
    vocabulary = items.select(F.explode("words").alias("word")).select(F.lower("word").alias("token")).distinct()
    vocabulary, _ = _sent(vocabulary, F.length("token") + 64)
    seen = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("token"))
    counts = seen.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("w"))
    places = items.select("item", "words", "w", F.explode(starts).alias("start"))
    places = places.select("*", F.explode(F.sequence("start", F.col("start") + F.col("w") - 1)).alias("at"))
    places = places.withColumn("token", F.lower(F.get("words", F.col("at"))))
    ranked = places.join(counts, "token", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at"))
    chosen = ranked.groupBy("item", "start").agg(F.min("rank").alias("rank"))
    return chosen.select(F.col("rank.token").alias("token"), F.col("rank.at").alias("at"), "item").distinct()


def _occurrences(docs: DataFrame, items: DataFrame, alignments: DataFrame) -> DataFrame:
    """``doc_id, text_hash, runs, item_ids``: runs of at least ``w`` equal words at the alignments of each document.

    ``alignments`` is a stored table of distinct ``doc_id, text_hash, item, shift``: item word 0 lies at document word ``shift``. Those
    of a document are gathered as numbers; its text is joined to them once, never once per match.
    """
    per_item = alignments.groupBy("doc_id", "text_hash", "item").agg(F.array_sort(F.collect_set("shift")).alias("shifts"))
    known, _ = _sent(items, F.length(F.array_join("words", "")) + 24 * F.size("words") + 64)
    found = F.struct(F.col("item_id").cast("string").alias("item_id"), "words", "w", "shifts")
    grouped = per_item.join(known, "item").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(found).alias("found"))
    sized = F.aggregate("found", F.lit(0), lambda a, x: a + 4 * F.size(x["shifts"]) + 32 * F.size(x["words"]))
    grouped, _ = _sent(materialize(grouped, "aligned"), sized)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    joined = rows.join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    joined = joined.withColumn("raw", words(F.col("text")))

    def runs_of(item: Column, shift: Column) -> Column:
        """Runs of equal words, as structs of start and length."""
        begin, skip = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
        n = F.least(F.size("raw"), shift + F.size(item["words"])) - begin
        there = F.slice("raw", begin + 1, F.greatest(n, F.lit(0)))
        here = F.slice(item["words"], skip + 1, F.greatest(n, F.lit(0)))
        equal = F.zip_with(there, here, lambda x, y: F.when(F.translate(x, _UPPER, _LOWER) == y, "1").otherwise("0"))
        first = F.struct(begin.alias("pos"), F.array().cast("array<struct<start:int,length:int>>").alias("runs"))

        def step(acc: Column, part: Column) -> Column:
            run = F.struct(acc["pos"].alias("start"), F.length(part).alias("length"))
            runs = F.when(F.length(part) >= item["w"], F.array_append(acc["runs"], run)).otherwise(acc["runs"])
            return F.struct((acc["pos"] + F.length(part) + 1).alias("pos"), runs.alias("runs"))

        return F.when(n >= item["w"], F.aggregate(F.split(F.array_join(equal, ""), "0"), first, step)["runs"])

    def hit(item: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,length:int>>")
        runs = F.flatten(F.transform(item["shifts"], lambda shift: F.coalesce(runs_of(item, shift), empty)))
        return F.struct(item["item_id"].alias("item_id"), runs.alias("runs"))

    hits = joined.withColumn("hits", F.filter(F.transform("found", hit), lambda h: F.size(h["runs"]) > 0))
    ids = F.filter(F.transform("hits", lambda h: h["item_id"]), lambda x: x.isNotNull())
    # equal rows have equal hits; what is left of them is small
    return hits.select(
        "doc_id", "text_hash", F.flatten(F.transform("hits", lambda h: h["runs"])).alias("runs"), F.array_sort(F.array_distinct(ids)).alias("item_ids")
    ).dropDuplicates(["doc_id", "text_hash"])


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids array<string>, contaminated``, one row per document row.

    ``contaminated``: at least one word and at least a twentieth of all words lie in occurrences.
    """
    return _judged(docs, bench, window).drop("text_hash")


def _judged(docs: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """``find_contamination`` with a hash of the text."""
    items = materialize(_items(bench, window), "items")
    prefixes, _ = _sent(materialize(prefix_tokens(docs, items), "prefixes"), F.length("token") + 64)
    texts = _documents(docs)
    exploded = texts.select("doc_id", "text_hash", F.posexplode("raw").alias("pos", "word"))
    matches = exploded.join(prefixes, F.lower("word") == F.col("token"))
    # several prefix words of one alignment ask for the same check
    alignments = matches.select("doc_id", "text_hash", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    hits = _occurrences(docs, items, materialize(alignments, "alignments"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, run: Column) -> Column:
        end = run["start"] + run["length"]
        fresh = F.greatest(end - F.greatest(acc["end"], run["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    hits = hits.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item_ids", F.aggregate(F.array_sort("runs"), begin, step)["n"].alias("hit")
    )
    rows = texts.select("doc_id", "text_hash", F.size("raw").cast("bigint").alias("n_words"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, told apart by id and text hash."""
    bad = _judged(docs, bench, window).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("text") == F.col("_bad_hash")), "left_anti")
