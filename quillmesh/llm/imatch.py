"""I-Match fingerprints: distinct terms within a band of inverse document frequency, hashed over several lexicons.

Document frequencies are exact counts over all documents. Terms above the band's lower edge are found in two
passes: a term with a share of at least ``low`` of all documents reaches at least half of that share in some map task,
or its reported counts add up to less than half of it, so tasks report only such terms. Reports that can still
reach the edge number at most ``2 * (mean distinct terms) / low``, whatever the size of the corpus; these candidates
are broadcast and counted exactly. The lexicon, a subset of them, is broadcast too.

Each of ``LEXICONS`` randomised lexicons keeps one term in ``KEEP``, by a hash. A fingerprint is the list of the
hashes of a text's sorted distinct terms in each lexicon (``-`` where it has none), then a hash of the normalised
text when it has no term in any. Likeness is the share of lexicons, among those in which either text has terms, whose
hashes agree; equal fingerprints have 1.

Defined cases: null text is empty; all empty texts are equal; rows are ordered by id (null first), then text; a row
that repeats an id is a document of its own; the successor of the last document is the first. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.ordered import bucket_bounds, bucket_of
from quillmesh.llm.wordhash import ALNUM, Words, mix, slices
from quillmesh.session import ship_package

#: Band of document frequency, as shares of all documents.
LOW, HIGH = 0.001, 0.2
LEXICONS = 24
KEEP = 48
FLUSH = 1 << 21


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def document_terms(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text; terms are runs of letters and digits, A-Z lowered."""
    for _, _, data, bounds in slices(texts):
        words = Words(data, bounds, ALNUM)
        h = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield np.unique(h[a:b])


def _report(low: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, docs = [], 0, 0

        def flush():
            terms, counts = _counted(parts)
            kept = counts >= low / 2 * docs
            yield pa.RecordBatch.from_arrays([pa.array(terms[kept].view(np.int64)), pa.array(counts[kept].astype(np.int64))], names=["term", "df"])

        for batch in batches:
            for terms in document_terms(batch.column("text")):
                parts.append(terms)
                held += len(terms)
                docs += 1
                if held >= FLUSH:
                    yield from flush()
                    parts, held, docs = [], 0, 0
        if docs:
            yield from flush()

    return run


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total, docs = np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            for terms in document_terms(batch.column("text")):
                total[np.searchsorted(wanted, terms[np.isin(terms, wanted, assume_unique=True)])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(total)], names=["term", "df"])

    return run


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms whose exact document frequency lies within the band."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("text")
    n = texts.count()
    if not n:
        return np.zeros(0, np.uint64)
    reported = texts.mapInArrow(_report(low), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    candidates = reported.where(F.col("df") >= low / 2 * n).select("term").toPandas()["term"].to_numpy()
    wanted = np.sort(candidates.astype(np.int64).view(np.uint64))
    counts = texts.mapInArrow(_count(sc.broadcast(wanted)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    kept = counts.where((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1))).select("term").toPandas()["term"].to_numpy()
    return np.sort(kept.astype(np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprints of texts against one lexicon."""

    def __init__(self, terms: np.ndarray, lexicons: int = LEXICONS, keep: int = KEEP):
        self.terms = terms
        salts = mix(np.arange(1, lexicons + 1, dtype=np.uint64))
        self.member = [mix(terms ^ s) % np.uint64(keep) == 0 for s in salts]

    def of(self, texts: list[str]) -> list[str]:
        import xxhash

        out = []
        for text, found in zip(texts, document_terms(pa.array(texts, pa.string()))):
            at = np.searchsorted(self.terms, found)
            at = at[at < len(self.terms)]
            at = np.unique(at[np.isin(self.terms[at], found)])
            parts = []
            for member in self.member:
                own = self.terms[at[member[at]]]
                parts.append(xxhash.xxh64_hexdigest(own.tobytes()) if len(own) else "-")
            if all(p == "-" for p in parts):
                parts.append(xxhash.xxh64_hexdigest(" ".join(text.lower().split()).encode("utf-8", "replace")))
            out.append(" ".join(parts))
        return out


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a.split(" ")[:LEXICONS], b.split(" ")[:LEXICONS]) if x != "-" or y != "-"]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _compare(sent):
    """Sorted rows of (bucket, doc_id, text, extra): each own row is compared with the row that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        prints = Fingerprints(sent.value)
        last = None  # (bucket, id, text, fingerprint) whose successor is still to come
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = prints.of(texts)
            rows = []
            for bucket, doc, text, extra, fp in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), texts, batch.column("extra").to_pylist(), own):
                if last is not None and last[0] == bucket:
                    rows.append((*last[1:], text, fp))
                last = (bucket, doc, text, fp) if not extra else None
            changed = [edited(t, after) for _, t, _, after, _ in rows]
            other = prints.of(changed)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "doc_id": doc, "n_chars": len(text),
                        "edited_sha256": hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(),
                        "fingerprint": fp, "edited_fingerprint": efp,
                        "near_edited": likeness(fp, efp), "near_next": likeness(fp, nfp),
                    }
                    for (doc, text, fp, _, nfp), e, efp in zip(rows, changed, other)
                ], schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return run


def fingerprint_pairs(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next document.

    Documents are dealt once into ranges of ids. The first document of a range is sent to the range before it as
    well (one extra row per range), so every task sees the successor of each of its rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(docs, low, high))
    bounds = bucket_bounds(docs, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    # one row per range: its smallest id (null where null ids come first)
    begins = (
        dealt.groupBy("bucket")
        .agg(F.when(F.max(F.col("doc_id").isNull()), None).otherwise(F.min("doc_id")).alias("first"))
        .orderBy("bucket")
        .collect()
    )
    first, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, row in enumerate(begins):
        first[row["bucket"]], before[row["bucket"]] = row["first"], begins[i - 1]["bucket"]
    first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in first]), F.col("bucket") + 1)
    before = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("bucket") + 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    copy = F.struct(before.alias("bucket"), F.lit(True).alias("extra"))
    places = F.when(F.col("doc_id").eqNullSafe(first), F.array(own, copy)).otherwise(F.array(own))
    placed = dealt.withColumn("place", F.explode(places)).select("place.bucket", "place.extra", "doc_id", "text")
    return (
        placed.repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(
            _compare(sent),
            "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )
