"""Near-duplicate groups: documents whose 5-word shingle sets have a Jaccard similarity of at least 0.75.

Method: signature trees (``sigtree``), with steps before them that bring only documents together that can link.

1. *Survivors.* Tokens are ordered by hash. Two linked sets share at least ``k`` tokens of prefixes of
   ``n - ceil(t n) + k`` tokens. Prefix tokens meet in hash buckets, as packed blocks; a document with fewer
   than ``k - 1`` shared prefix tokens has no partner and stays alone. A token repeated inside a map task is
   settled there and sent once, so no token gathers its documents in one place.
2. *Clusters.* Among the distinct sets of the survivors every token's frequency is counted, in the same packed way.
   With tokens ordered by rarity a linked pair shares a token within prefixes of ``n - ceil(t n) + 1``; sets that
   share one are hung on the smallest of them, and connected components of these edges are the only places where
   links can be. Passages that many documents share come last in the order and bring no strangers together.
3. *Trees.* Each cluster is searched by a dual traversal of its signature tree. A cluster above ``BLOCK_BYTES``
   is cut into blocks and every pair of blocks is searched, so nothing is capped and no task holds more than
   two blocks. The forest of verified links gives the groups.

Hashes have 64 bits; two different shingles of one pair are taken for equal with a chance of about 1e-13.

Defined cases: null or wordless text has an empty set and stays alone; fewer than five words are one shingle;
equal sets are one class; repeated rows are kept, each with the same group; rows with a null id get the smallest
id of their group, or null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm import sigtree
from quillmesh.llm.graph import components
from quillmesh.llm.wordhash import NOT_SPACE, Words, mix, shingle_sets, slices
from quillmesh.session import materialize, ship_package

SHINGLE = 5
PERCENT = 75
#: Prefix tokens settled together in a map task, and bytes of sets in one block of a large cluster.
FLUSH = 1 << 20
#: Of these, how many are handled or handed on at a time.
PIECE = 1 << 16
BLOCK_BYTES = 32 << 20
#: Rows of an Arrow batch; JVM and Python hold each batch several times over.
BATCH_ROWS = 512

_PACKED = "bucket int, key bigint, shared bigint, need bigint, tokens binary, keys binary, settled binary"


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """The rows of some columns as Python values, a few at a time, as a batch may hold much."""
    for at in range(0, len(batch), 64):
        yield from zip(*(batch.column(c).slice(at, 64).to_pylist() for c in columns))


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """(prefix length, shared tokens that a linked set has there at least) of a set of n > 0 tokens."""
    k = 1 + n // 8
    need = -(-percent * n // 100)
    return min(n, n - need + k), max(1, k - 1)


def _pack(percent: int, size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, keys, needs, counts, held = [], [], [], [], [], 0
        texts: dict[int, int] = {}

        def flush():
            nonlocal held
            if not keys:
                return
            key, need, count = np.array(keys, np.int64), np.array(needs, np.int64), np.array(counts, np.int64)
            tok = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            own = np.repeat(np.array([o for o, _ in owners], np.int32), [n for _, n in owners]) if owners else np.zeros(0, np.int32)
            for x in (tokens, owners, keys, needs, counts, texts):
                x.clear()
            held = 0
            order = np.argsort(tok)
            tok, own = tok[order], own[order]
            head = np.ones(len(tok), bool)
            head[1:] = tok[1:] != tok[:-1]
            at = np.flatnonzero(head)
            length = np.diff(np.append(at, len(tok)))
            count += np.bincount(own[np.repeat(length > 1, length)], minlength=len(key))
            tok, own, settled = tok[at], own[at], (length > 1).astype(np.uint8)
            del head, at, length, order
            bucket = np.empty(len(tok), np.int32)
            for a in range(0, len(tok), PIECE):  # ``mix`` makes several copies of what it gets
                bucket[a : a + PIECE] = mix(tok[a : a + PIECE]) % np.uint64(buckets)
            order = np.lexsort((own, bucket))
            tok, own, settled, bucket = tok[order], own[order], settled[order], bucket[order]
            del order
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(tok) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(tok))
            # whole buckets, about PIECE tokens at a time
            cuts = np.flatnonzero(np.append(True, at[1:] // PIECE != at[:-1] // PIECE)) if len(at) else np.zeros(0, np.int64)
            for c, d in zip(cuts, np.append(cuts[1:], len(at))):
                spans = list(zip(at[c:d], ends[c:d]))
                none = pa.nulls(len(spans), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[at[c:d]]), none, none, none,
                        pa.array([tok[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([key[own[a:b]].tobytes() for a, b in spans], pa.binary()),
                        pa.array([settled[a:b].tobytes() for a, b in spans], pa.binary()),
                    ], names=names)
            blank = pa.nulls(len(key), pa.binary())
            spread = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(key), pa.array(count), pa.array(need), blank, blank, blank], names=names)

        names = [x.split()[0] for x in _PACKED.split(", ")]
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, _, data, bounds in slices(batch.column(1)):
                for d, found in enumerate(shingle_sets(Words(data, bounds, NOT_SPACE), size), a):
                    n = len(found)
                    if not n:
                        continue
                    length, need = prefix_sizes(n, percent)
                    same = hash(found.tobytes())
                    first = texts.setdefault(same, len(keys))
                    copy = first < len(keys)
                    keys.append(int(ids[d]))
                    needs.append(need)
                    counts.append(need if copy else 0)
                    if copy:
                        counts[first] = max(counts[first], needs[first])
                        continue
                    tokens.append(found[:length].copy())  # a view would keep the whole set
                    owners.append((len(keys) - 1, length))
                    held += length
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: counts go through; the blocks of a bucket are searched for shared tokens."""
    held: list[tuple[bytes, bytes, bytes]] = []
    now = None

    def flush():
        if not held:
            return
        tok, key, settled = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
        held.clear()
        order = np.argsort(tok)
        tok, key, settled = tok[order], key[order], settled[order]
        again = np.zeros(len(tok), bool)
        again[1:] = tok[1:] == tok[:-1]
        again[:-1] |= again[1:]
        found, count = np.unique(key[again & (settled == 0)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64)), pa.nulls(len(found), pa.int64())], names=["key", "shared", "need"])

    for batch in batches:
        plain = batch.filter(batch.column("tokens").is_null())
        if len(plain):
            yield plain.select(["key", "shared", "need"])
        packed = batch.filter(batch.column("tokens").is_valid())
        for bucket, *block in _rows(packed, "bucket", "tokens", "keys", "settled"):
            if bucket != now:
                yield from flush()
                now = bucket
            held.append(tuple(block))
    yield from flush()


def _survivors(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """``key``: the ids that may have a partner, among others; ids shared by several rows count as one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(_pack(percent, size, 16 * parts), _PACKED)
    met = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "key bigint, shared bigint, need bigint")
    return met.groupBy("key").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("key")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for a, b, data, bounds in slices(batch.column("text")):
                n, class_, packed = [], [], []
                for d, found in enumerate(shingle_sets(Words(data, bounds, NOT_SPACE), size), a):
                    n.append(len(found))
                    keep = wanted[d] and len(found)
                    raw = found.tobytes() if keep else None
                    class_.append(xxhash.xxh3_128_digest(raw) if keep else None)
                    packed.append(raw)
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "row_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, pa.int64()), pa.array(class_, pa.binary()), pa.array(packed, pa.binary())],
                    names=["doc_id", "row_hash", "n_shingles", "class", "tokens"])

    return run


def _spread(buckets: int):
    """All tokens of the classes, packed by hash bucket."""
    names = ["bucket", "tokens", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, held = [], [], 0

        def flush():
            nonlocal held
            if held:
                tok, key = np.concatenate(tokens), np.concatenate(keys)
                tokens.clear()
                keys.clear()
                bucket = np.concatenate([(mix(tok[a : a + PIECE]) % np.uint64(buckets)).astype(np.int32) for a in range(0, len(tok), PIECE)])
                order = np.argsort(bucket, kind="stable")
                tok, key, bucket = tok[order], key[order], bucket[order]
                del order
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(at[1:], len(tok))
                # whole buckets, about PIECE tokens at a time
                cuts = np.flatnonzero(np.append(True, at[1:] // PIECE != at[:-1] // PIECE))
                for c, d in zip(cuts, np.append(cuts[1:], len(at))):
                    packed = [pa.array([x[i:j].tobytes() for i, j in zip(at[c:d], ends[c:d])], pa.binary()) for x in (tok, key)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[at[c:d]]), *packed], names=names)
            held = 0

        for batch in batches:
            for node, raw in _rows(batch, "node", "tokens"):
                tokens.append(np.frombuffer(raw, np.uint64))
                keys.append(np.full(len(tokens[-1]), node, np.int64))
                held += len(tokens[-1])
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: per class the tokens that other classes have too, each with its frequency (255 at most)."""
    held, now = [], None

    def flush():
        if not held:
            return
        tok, key = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.uint64, np.int64)))
        held.clear()
        order = np.argsort(tok)
        tok, key = tok[order], key[order]
        at = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        length = np.diff(np.append(at, len(tok)))
        often = np.repeat(length, length)
        tok, key, often = tok[often > 1], key[often > 1], np.minimum(often[often > 1], 255).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        tok, key, often = tok[order], key[order], often[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(key))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for x in (tok, often)]
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), *packed], names=["node", "shared", "often"])

    for batch in batches:
        for bucket, *block in _rows(batch, "bucket", "tokens", "keys"):
            if bucket != now:
                yield from flush()
                now = bucket
            held.append(block)
    yield from flush()


def _rare_prefixes(percent: int):
    """The shared tokens within a class's prefix, tokens ordered by (frequency, hash); none if too few are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes = [], []
            for node, n, shared, often in _rows(batch, "node", "n", "shared", "often"):
                tok, count = np.frombuffer(b"".join(shared), np.uint64), np.frombuffer(b"".join(often), np.uint8)
                # tokens of this class alone come first in the order and fill the prefix's beginning
                length = (n - (-(-percent * n // 100)) + 1) - (n - len(tok))
                if length > 0:
                    tokens.append(tok[np.lexsort((tok, count))[:length]])
                    nodes.append(np.full(len(tokens[-1]), node, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    return run


def _postings(classes: DataFrame, percent: int) -> DataFrame:
    """``token, node``: the prefix tokens of every class, in order of rarity among the classes."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.select("node", "tokens").mapInArrow(_spread(16 * parts), "bucket int, tokens binary, keys binary")
    found = spread.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequencies, "node bigint, shared binary, often binary")
    lists = found.groupBy("node").agg(F.collect_list(F.struct("shared", "often")).alias("parts"))
    lists = lists.select("node", F.col("parts.shared").alias("shared"), F.col("parts.often").alias("often"))
    sized = lists.join(classes.select("node", (F.length("tokens") / 8).cast("bigint").alias("n")), "node")
    return sized.mapInArrow(_rare_prefixes(percent), "token bigint, node bigint")


def _search(percent: int):
    """Rows sorted by (cluster, i, j): one tree per group; i = j searches a block, i < j two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def flush():
            links = sigtree.Links(len(sets))
            sigtree.join(sets, percent, links)
            pairs = [(node, nodes[root]) for i, node in enumerate(nodes) if (root := links.find(i)) != i]
            nodes.clear()
            sets.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], names=["a", "b"])

        for batch in batches:
            for group, node, raw in _rows(batch, "group", "node", "tokens"):
                if group != now:
                    yield from flush()
                    now = group
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
        yield from flush()

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of ``docs(doc_id, text)``: one row per input row."""
    return _grouped(docs, percent, size, block_bytes).select("doc_id", "n_shingles", "component_id")


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _grouped(docs: DataFrame, percent: int, size: int, block_bytes: int) -> DataFrame:
    """``near_duplicates`` with ``row_hash`` (of id and text) and ``component``, which is null for rows without a partner."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = _survivors(docs, percent, size).withColumn("wanted", F.lit(True))
    joined = docs.join(keys, F.coalesce("doc_id", F.lit(0)) == F.col("key"), "left").select("doc_id", "text", _row_hash().alias("row_hash"), F.coalesce("wanted", F.lit(False)).alias("wanted"))
    sets = materialize(joined.mapInArrow(_sets(size), "doc_id bigint, row_hash bigint, n_shingles bigint, class binary, tokens binary"), "sets", BATCH_ROWS)

    grouped = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("label"), F.any_value("tokens").alias("tokens"))
    # a class is named by its smallest id; where ids are null or stand for several texts, by a negative hash
    place = F.row_number().over(Window.partitionBy("label").orderBy("class"))
    node = F.when(F.col("label").isNotNull() & (place == 1), F.col("label")).otherwise(-F.abs(F.shiftright(F.xxhash64("class"), 1)) - 1)
    classes = materialize(grouped.withColumn("node", node), "classes")

    postings = materialize(_postings(classes, percent), "postings", BATCH_ROWS)
    hubs = postings.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("token", "hub")
    edges = postings.join(hubs, "token").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = materialize(components(edges).withColumnRenamed("component", "cluster"), "clusters")

    members = clusters.join(classes.select("node", "tokens"), "node")
    sizes = clusters.join(classes.select("node", F.length("tokens").alias("bytes")), "node").groupBy("cluster").agg(F.sum("bytes").alias("bytes"))
    blocks = sizes.select("cluster", F.ceil(F.col("bytes") / block_bytes).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    groups = (
        members.join(blocks, "cluster")
        .withColumn("pair", F.explode(pairs))
        .select(F.concat_ws(",", "cluster", "pair.i", "pair.j").alias("group"), "node", "tokens")
        .repartition("group")
        .sortWithinPartitions("group", "node")
    )
    links = components(materialize(groups.mapInArrow(_search(percent), "a bigint, b bigint"), "links", BATCH_ROWS))

    names = classes.select("class", "node").join(links, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    labels = names.join(classes.select("class", "label"), "class").groupBy("component").agg(F.min("label").alias("label"))
    named = names.join(labels, "component").select(F.col("class").alias("own_class"), "label", "component")
    return sets.join(named, F.col("class") == F.col("own_class"), "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), "row_hash", "component"
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row of each group stays: the one with the smallest id (null last), of several texts with that id any one.

    Rows without a partner stay, also with a null id or an id that other texts have too; equal rows (one id, one
    text) are kept once. Rows are told apart by id and a hash of id and text.
    """
    alone = F.col("component").isNull()
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("_row_id"), F.col("row_hash").alias("_row_hash"))
    groups = _grouped(docs, percent, size, BLOCK_BYTES)
    keep = groups.groupBy("component", F.when(alone, F.col("doc_id")), F.when(alone, F.col("row_hash"))).agg(F.min(rank).alias("kept"))
    rows = docs.withColumns({"_row_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_row_hash": _row_hash()})
    kept = rows.join(keep.select("kept._row_id", "kept._row_hash"), ["_row_id", "_row_hash"], "left_semi")
    return kept.dropDuplicates(["_row_id", "_row_hash"]).select(*docs.columns)
