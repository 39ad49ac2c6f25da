"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document longer than a sequence is cut into full pieces; its first piece holds the rest. Full pieces are sequences
of their own. The other pieces are dealt over islands by a hash, a bounded number each. On an island an individual
is a list of bins. Crossover takes over the fullest bins of two parents whole, a document that is then in two bins is
removed from the later one, and displaced documents are put back by best fit. After every round the islands' fullest
bin patterns (the lengths in a bin) are gathered - a fixed number per island, and a fixed number in all - and sent to
all islands, which rebuild such bins from their own pieces.

Defined cases: null or empty text is the end id alone; rows that repeat an id are documents of their own, told
apart by their text (equal rows by a running number); an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import BATCH_ROWS, encoder, with_end
from quillmesh.session import materialize, ship_package

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 1024
#: Pieces of an island at most on average, individuals, generations of a round, rounds between migrations.
ISLAND, POPULATION, GENERATIONS, ROUNDS = 6_000, 4, 6, 2
#: Bin patterns that one island sends, and that are passed on.
ELITES, MIGRANTS = 64, 1024

Bins = list[list[int]]


def best_fit(lengths: list[int], items: list[int], bins: Bins, room: int) -> Bins:
    """Put ``items``, longest first, each into the fullest bin that still takes it; ``bins`` are copied."""
    bins = [list(b) for b in bins]
    places = sorted((room - sum(lengths[i] for i in b), n) for n, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -lengths[i]):
        at = bisect.bisect_left(places, (lengths[i], -1))
        if at < len(places):
            free, n = places.pop(at)
            bins[n].append(i)
            if free > lengths[i]:
                bisect.insort(places, (free - lengths[i], n))
        else:
            bins.append([i])
            bisect.insort(places, (room - lengths[i], len(bins) - 1))
    return bins


def fitness(lengths: list[int], bins: Bins, room: int) -> float:
    """Mean squared fill of the bins: fewer and fuller bins score higher."""
    return sum((sum(lengths[i] for i in b) / room) ** 2 for b in bins) / max(len(bins), 1)


def crossover(lengths: list[int], a: Bins, b: Bins, room: int) -> Bins:
    """Inject the well-filled bins of ``b`` into ``a``: bins whole, duplicates out, displaced items by best fit."""
    def full(bins):
        return sorted(bins, key=lambda x: -sum(lengths[i] for i in x))

    child, taken = [], set()
    for bin_ in [x for pair in zip(full(b)[: len(b) // 2], full(a)) for x in pair] + full(a)[len(b) // 2 :]:
        if taken.isdisjoint(bin_) and sum(lengths[i] for i in bin_) >= 0.97 * room:
            child.append(bin_)
            taken.update(bin_)
    return best_fit(lengths, [i for i in range(len(lengths)) if i not in taken], child, room)


def inject(lengths: list[int], patterns: list[tuple[int, ...]], room: int) -> Bins:
    """An individual that begins with bins of the migrants' patterns, as far as own pieces have these lengths."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stock.setdefault(n, []).append(i)
    bins, used = [], set()
    for pattern in patterns:
        need = Counter(pattern)
        while all(len(stock.get(n, ())) >= k for n, k in need.items()):
            bin_ = [stock[n].pop() for n in pattern]
            bins.append(bin_)
            used.update(bin_)
    return best_fit(lengths, [i for i in range(len(lengths)) if i not in used], bins, room)


def evolve(lengths: list[int], patterns: list[tuple[int, ...]], room: int, seed: int) -> Bins:
    """The best individual after ``GENERATIONS``; the same inputs give the same bins."""
    if not lengths:
        return []
    dice = random.Random(seed)
    least = -(-sum(lengths) // room)
    population = [best_fit(lengths, list(range(len(lengths))), [], room)]
    if patterns:
        population.append(inject(lengths, patterns, room))
    score = lambda bins: (len(bins), -fitness(lengths, bins, room))
    best = min(population, key=score)
    if len(best) <= least:
        return best
    while len(population) < POPULATION:
        some = set(dice.sample(range(len(lengths)), len(lengths) // 3))
        first = best_fit(lengths, sorted(some), [], room)
        population.append(best_fit(lengths, [i for i in range(len(lengths)) if i not in some], first, room))
    for _ in range(GENERATIONS):
        population.sort(key=score)
        if len(population[0]) <= least:
            break
        a, b = dice.sample(population[:3], 2)
        population[-1] = crossover(lengths, a, b, room)
    return min(population, key=score)


def _cut(tokenizer: str, end_id: int, room: int, with_ids: bool):
    names = ["doc_id", "key", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = with_end(*encoder(tokenizer).encode_column(batch.column("text")), end_id)
            flat, sizes = flat.astype("<u4", copy=False), np.diff(offsets)
            counts = -(-sizes // room)
            rows = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            # the first piece has what is left over by the full ones
            short = sizes - (counts - 1) * room
            start = np.where(piece == 0, 0, short[rows] + (piece - 1) * room)
            length = np.where(piece == 0, short[rows], room)
            at = offsets[rows] + start
            parts = [flat[a:z] for a, z in zip(at.tolist(), (at + length).tolist())]
            taken = pa.array(rows)
            columns = [
                batch.column("doc_id").take(taken), batch.column("key").take(taken), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array([p.tobytes() for p in parts] if with_ids else [None] * len(parts), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_pieces(docs: DataFrame, room: int = SEQUENCE, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, key, piece, start, length, ids_crc32, ids`` of ``docs(doc_id, text)``: one row per piece.

    ``key`` is a hash of id and text that only deals rows out. ``ids`` (packed 32-bit integers) are null unless asked for.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_cut(tokenizer, end_id, room, with_ids), "doc_id bigint, key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def _islands(patterns: list[tuple[int, ...]], room: int, elites_only: bool, columns: list[str]):
    """Rows sorted by island; each island evolves in memory, bounded by ``ISLAND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle():
            if not held:
                return
            rows = pa.Table.from_batches(held)
            held.clear()
            lengths = rows.column("length").to_pylist()
            small = [i for i, n in enumerate(lengths) if n < room]
            bins = evolve([lengths[i] for i in small], patterns, room, now)
            if elites_only:
                found = sorted({tuple(sorted(lengths[small[i]] for i in b)) for b in bins}, key=lambda p: (-sum(p), len(p), p))[:ELITES]
                yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in found], pa.list_(pa.int32()))], names=["pattern"])
                return
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n, bin_ in enumerate(bins):
                at = 0
                for i in bin_:
                    sequence[small[i]], offset[small[i]] = n, at
                    at += lengths[small[i]]
            whole = [i for i, n in enumerate(lengths) if n >= room]
            sequence[whole] = len(bins) + np.arange(len(whole))
            out = rows.select(columns).append_column("sequence_id", pa.array(sequence + (now << 32))).append_column("offset", pa.array(offset))
            yield from out.to_batches()

        for batch in batches:
            island = np.asarray(batch.column("island"))
            cuts = [0, *(np.flatnonzero(island[1:] != island[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if int(island[a]) != now:
                    yield from settle()
                    now = int(island[a])
                held.append(batch.slice(a, b - a))
        yield from settle()

    return run


def pack(pieces: DataFrame, room: int = SEQUENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id, offset``.

    One shuffle of the piece rows per round; the shuffle's key is a hash, so islands are alike and no key is hot.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    islands = max(1, -(-pieces.count() // ISLAND))
    columns = pieces.columns
    # the row number spreads equal rows of a repeated document; it is stable over the files of a stored table
    dealt = pieces.withColumn("island", F.pmod(F.xxhash64("key", "piece", F.monotonically_increasing_id()), F.lit(islands)))
    parts = min(islands, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [c for c in ("island", "length", "key", "piece", "doc_id") if c in dealt.columns]
    patterns: list[tuple[int, ...]] = []
    for _ in range(rounds - 1):
        lengths = dealt.where(F.col("length") < room).select("island", "length", "key", "piece").repartition(parts, "island").sortWithinPartitions("island", "length", "key", "piece")
        elites = lengths.mapInArrow(_islands(patterns, room, True, []), "pattern array<int>")
        size = F.aggregate("pattern", F.lit(0), lambda a, x: a + x)
        best = elites.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(size.desc(), F.col("n").desc(), "pattern").limit(MIGRANTS)
        patterns = [tuple(r["pattern"]) for r in best.collect()]
    kinds = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    rows = dealt.repartition(parts, "island").sortWithinPartitions(*order)
    return rows.mapInArrow(_islands(patterns, room, False, columns), f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, room: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where every piece of every document goes."""
    pieces = materialize(cut_pieces(docs, room, tokenizer).drop("ids"), "pieces", BATCH_ROWS)
    return pack(pieces, room).drop("key")


def sequences(docs: DataFrame, room: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """``sequence_id, ids array<int>``: the packed sequences themselves, each at most ``room`` ids long."""
    pieces = materialize(cut_pieces(docs, room, tokenizer, with_ids=True), "pieces", BATCH_ROWS)
    placed = pack(pieces, room).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return placed.mapInArrow(run, "sequence_id bigint, ids array<int>")
