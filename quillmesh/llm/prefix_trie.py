"""Prefix trie over conversations: nodes, shared prefixes and what their sharing saves, from sorted matrices of turn ids.

A turn is named by two 64-bit hashes of its role and text (a clash of both is not looked for). Conversations are cut into
blocks of ``WIDTH`` turns; a block knows a 128-bit key of everything before it, so blocks of one depth and one key are
the rows of a matrix, padded to the longest. Blocks are dealt into ranges of (depth, key, turn ids), copies by their id as well, so
no prefix, however common, has to be in one task. A task sorts its shard by ``numpy.lexsort`` over the columns; the
mask of changes against the row before, OR-accumulated along the columns, marks where nodes start at every depth, which
is the same as the length of the prefix a row shares with the row before it.

With that length known for every row (the first and last rows of neighbouring shards are compared on their own), all figures
of a node are sums over its member rows: a row saves the bytes of the turns it shares with the row before, and is a
leaf if the row after does not go on from it. So each depth of a chunk of rows is reduced by ``reduceat``, and the
parts of nodes that lie on both sides of a border are added up by their key. Deeper blocks of the same conversations reach the nodes
above by running sums over a conversation's blocks.

Defined cases: null role or text is empty; null turns come first; turns of one number are ordered by role, then text;
repeated rows are turns of their own; rows without a conversation id form one conversation, which takes no other's turns,
comes before all ids and is written as the empty text; an empty table has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.skew import spread_lookup
from quillmesh.session import materialize, ship_package

#: Turns of a block, block rows of a shard on average, rows of a chunk, turns that a conversation hands on at most.
WIDTH, SHARD_ROWS, CHUNK_ROWS, HEAD = 64, 20_000, 8192, 8
#: Characters of joined ids that one row hands to the digest of a node's ends.
JOINED_CHARS = 1 << 20
#: Stands for a null conversation id inside; a real id of this value would be taken for none.
NO_ID = -(1 << 63)

_TURNS = "conv bigint, t1 bigint, t2 bigint, n_bytes bigint"


def numbered(turns: DataFrame) -> DataFrame:
    """``conv, pos, t1, t2, n_bytes`` of ``turns(conv_id, turn, role, text)``, from place 0 on.

    Rows are sorted by ranges, so a conversation of any length may lie in several tasks; the few that do (at most one
    per border) get the number of their rows in the tasks before. The texts are shuffled once and not stored.
    """
    spark = turns.sparkSession
    ship_package(spark)
    whole = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    conv = F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv")
    rows = turns.select(conv, F.col("turn").cast("bigint").alias("turn"), whole("role"), whole("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("conv", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"), F.octet_length("text").cast("bigint").alias("n_bytes"))

    names = [*rows.columns, "part", "at", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, count, held = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            conv = np.asarray(batch.column("conv"))
            if not len(conv):
                continue
            edge = np.zeros(len(conv), bool)
            edge[0] = not held
            if held:
                yield pa.RecordBatch.from_arrays(held, names=names)
            starts = np.append(0, np.flatnonzero(conv[1:] != conv[:-1]) + 1)
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == now:
                at[: starts[1] if len(starts) > 1 else len(conv)] += count
            now, count = conv[-1], int(at[-1]) + 1
            held = [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(at), edge]
        if held:
            held[-1][-1] = True
            yield pa.RecordBatch.from_arrays(held, names=names)

    stored = materialize(rows.mapInArrow(run, f"{_TURNS}, part int, at bigint, edge boolean"), "turns")
    # the first and the last row of a task tell all: a conversation that goes on in the next task has its task's last row
    pieces = stored.where("edge").select("conv", "part", "at").repartition(1).groupBy("conv", "part").agg((F.max("at") + 1).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = pieces.withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv", "part", "before")
    joined = stored.join(F.broadcast(cut), ["conv", "part"], "left")
    return joined.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "n_bytes")


def head_size(conv: Column) -> Column:
    """How many turns a conversation takes over from the first one of its five."""
    return F.when(conv == NO_ID, 0).otherwise(F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("bigint")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of another: turn rows, and ``conv, total`` of every one, turnless ones too.

    ``rows`` is what ``numbered`` returns, stored. Conversation c begins with the first ``head_size`` turns of conversation
    c - c mod 5, and goes on with its own turns after as many. A task holds eight turns of a conversation at most.
    """
    turn = F.struct("pos", "t1", "t2", "n_bytes")
    info = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < HEAD, turn))).alias("head"))
    donor = F.when(F.col("conv") == NO_ID, F.col("conv")).otherwise(F.col("conv") - F.pmod("conv", F.lit(5)))
    plan = info.withColumns({"h": head_size(F.col("conv")), "donor": donor})
    # at most five conversations have one donor, which is the first of them if it is there
    given = F.max(F.when(F.col("conv") == F.col("donor"), F.col("head"))).over(Window.partitionBy("donor"))
    plan = plan.withColumn("given", given)
    taken = F.coalesce(F.slice("given", F.lit(1), F.col("h").cast("int")), F.array().cast(info.schema["head"].dataType))
    plan = plan.select("conv", "n", "h", taken.alias("taken"))
    plan = materialize(plan.withColumn("shift", F.size("taken") - F.col("h")), "conversations")
    totals = plan.select("conv", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    heads = plan.select("conv", F.explode("taken").alias("t")).select("conv", "t.*")
    own = rows.where(F.col("pos") >= head_size(F.col("conv")))
    moved = spread_lookup(own, plan.select("conv", "shift", "n"), "conv", "n", ["pos"])
    moved = moved.select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "t1", "t2", "n_bytes")
    return heads.unionByName(moved), totals


def _blocks(rows: DataFrame) -> DataFrame:
    """``conv, b, more, k1, k2, x1, x2, ids, keys, sizes``: blocks of turns with the key of what lies before.

    A key is the exclusive or of hashes of (place, turn), so keys of prefixes are running sums. ``x1, x2`` is the key with the
    block itself, ``keys`` the hashes of its places, ``more`` says that another block follows.
    """
    place = F.struct("pos", "t1", "t2", "n_bytes", F.xxhash64("pos", "t1", "t2").alias("p1"), F.xxhash64("t2", "pos", "t1").alias("p2"))
    blocks = rows.select("conv", F.floor(F.col("pos") / WIDTH).cast("bigint").alias("b"), place.alias("t")).groupBy("conv", "b")
    blocks = blocks.agg(F.sort_array(F.collect_list("t")).alias("turns"), F.bit_xor("t.p1").alias("own1"), F.bit_xor("t.p2").alias("own2"))
    inside = Window.partitionBy("conv").orderBy("b")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    k1, k2 = (F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("bigint")) for c in ("own1", "own2"))
    blocks = blocks.select("conv", "b", "turns", "own1", "own2", F.lead("b").over(inside).isNotNull().alias("more"), k1.alias("k1"), k2.alias("k2"))
    pairs = lambda a, b: F.flatten(F.transform("turns", lambda t: F.array(t[a], t[b])))
    return blocks.select(
        "conv", "b", "more", "k1", "k2", F.col("k1").bitwiseXOR(F.col("own1")).alias("x1"), F.col("k2").bitwiseXOR(F.col("own2")).alias("x2"),
        pairs("t1", "t2").alias("ids"), pairs("p1", "p2").alias("keys"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"),
    )


_BLOCK = "conv bigint, b bigint, more boolean, k1 bigint, k2 bigint, x1 bigint, x2 bigint, ids array<bigint>, keys array<bigint>, sizes array<bigint>"


def _matrix(column: pa.Array, lengths: np.ndarray, width: int) -> np.ndarray:
    """The lists of a column as rows, padded to ``width`` by the least number."""
    out = np.full((len(lengths), width), np.iinfo(np.int64).min)
    if len(lengths):
        out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard in order, each row with its place and the turns it shares with the rows before and after (-1: unknown)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    column = lambda name: rows.column(name).chunk(0) if rows.column(name).num_chunks else rows.column(name)
    lengths = np.diff(column("sizes").offsets.to_numpy())
    width = int(lengths.max())
    ids = _matrix(column("ids"), 2 * lengths, 2 * width)
    first = [np.asarray(column(n)) for n in ("b", "k1", "k2")]
    order = np.lexsort([np.asarray(column("conv")), np.asarray(column("more").cast(pa.int8())), lengths, *ids.T[::-1], *first[::-1]])
    ids, lengths = ids[order], lengths[order]
    changed = (ids[1:] != ids[:-1]).reshape(len(ids) - 1, width, 2).any(axis=2)
    for key in first:
        changed[:, 0] |= key[order][1:] != key[order][:-1]
    started = np.logical_or.accumulate(changed, axis=1)
    shared = np.minimum(np.minimum(lengths[1:], lengths[:-1]), (~started).sum(axis=1))
    n = len(order)
    part = np.full(n, TaskContext.get().partitionId(), np.int32)
    out = rows.take(pa.array(order))
    extra = {"part": part, "at": np.arange(n), "back": np.append(-1, shared), "ahead": np.append(shared, -1), "final": np.arange(n) == n - 1}
    for name, values in extra.items():
        out = out.append_column(name, pa.array(values))
    yield from out.to_batches(max_chunksize=CHUNK_ROWS)


def _shards(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """The blocks in stored, sorted shards, with ``part, at, back, ahead``: the shared turns before and after, all known.

    Of two neighbouring shards only the last and the first row are compared: two rows per shard.
    """
    n_blocks = totals.agg(F.sum(F.ceil(F.col("total") / WIDTH))).first()[0] or 0
    parts = max(1, -(-n_blocks // SHARD_ROWS))
    dealt = blocks.repartitionByRange(parts, "b", "k1", "k2", "ids", "more", "conv")
    stored = materialize(dealt.mapInArrow(_sort_shard, f"{_BLOCK}, part int, at bigint, back bigint, ahead bigint, final boolean"), "shards")
    ends = stored.where("at = 0 or final").select("part", "at", "final", F.struct("b", "k1", "k2").alias("key"), "ids").repartition(1)
    order = Window.orderBy("part", "at")
    ends = ends.withColumn("last", F.lag(F.struct("key", "ids")).over(order))
    same = F.zip_with("ids", "last.ids", lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(same, False)
    shared = F.floor(F.when(at > 0, at - 1).otherwise(F.size(same)) / 2).cast("bigint")
    none = F.lit(0).cast("bigint")
    ends = ends.withColumn("n", F.when((F.col("at") == 0) & (F.col("key") == F.col("last.key")), shared).otherwise(none))
    # the row after a shard's last one is the first of the next shard
    ends = ends.withColumn("next", F.coalesce(F.lead("n").over(order), none))
    border = ends.groupBy("part").agg(F.max(F.when(F.col("at") == 0, F.col("n"))).alias("_back"), F.max(F.when(F.col("final"), F.col("next"))).alias("_ahead"))
    known = stored.join(F.broadcast(border), "part")
    back, ahead = F.when(F.col("at") == 0, F.col("_back")).otherwise(F.col("back")), F.when(F.col("final"), F.col("_ahead")).otherwise(F.col("ahead"))
    return known.select(*[n.split()[0] for n in _BLOCK.split(", ")], "part", "at", back.alias("back"), ahead.alias("ahead"))


_NODE = "depth bigint, x1 bigint, x2 bigint, up1 bigint, up2 bigint, conv bigint, n bigint, children bigint, leaves bigint, saved bigint"


def _prefix_keys(batch: pa.RecordBatch, lengths: np.ndarray, width: int) -> np.ndarray:
    """Keys of all prefixes, ``[row, turns, lane]``; beyond a row's length they mean nothing."""
    keys = _matrix(batch.column("keys"), 2 * lengths, 2 * width).reshape(len(lengths), width, 2)
    first = np.stack([np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))], axis=1)[:, None, :]
    return np.bitwise_xor.accumulate(np.concatenate([first, keys], axis=1), axis=1)


def _node_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of nodes from chunks of sorted rows, every depth reduced at once over the starts of its nodes."""
    for whole in batches:
        part, place = np.asarray(whole.column("part")), np.asarray(whole.column("at"))
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1)) + 1
        cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, len(part), CHUNK_ROWS), [len(part)]]))
        for a, z in zip(cuts[:-1], cuts[1:]):
            batch = whole.slice(a, z - a)
            lengths = np.diff(batch.column("sizes").offsets.to_numpy())
            width = int(lengths.max())
            column = lambda name: np.asarray(batch.column(name))  # noqa: B023, E731
            back, ahead, conv, b = column("back"), column("ahead"), column("conv"), column("b")
            leaf = (~batch.column("more").to_numpy(zero_copy_only=False) & (ahead < lengths)).astype(np.int64)
            sizes = _matrix(batch.column("sizes"), lengths, width)
            sizes[np.arange(width) >= lengths[:, None]] = 0
            # bytes of the turns from a column to the end of what the row shares with the one before it
            shared = np.where(np.arange(width) < back[:, None], sizes, 0)[:, ::-1].cumsum(axis=1)[:, ::-1]
            keys = _prefix_keys(batch, lengths, width)
            out = []
            for c in range(width):
                rows = np.flatnonzero(lengths > c)
                start = (back[rows] <= c) | np.append(True, np.diff(rows) > 1)
                starts = np.flatnonzero(start)
                fresh = ((lengths > c + 1) & (back <= c + 1))[rows].astype(np.int64)
                first = rows[starts]
                add = lambda values: np.add.reduceat(values, starts)  # noqa: B023, E731
                out.append([
                    b[first] * WIDTH + c + 1, keys[first, c + 1, 0], keys[first, c + 1, 1], keys[first, c, 0], keys[first, c, 1],
                    np.minimum.reduceat(conv[rows], starts), add(np.ones(len(rows), np.int64)), add(fresh), add(leaf[rows]), add(shared[rows, c]),
                ])
            # a first turn of a deeper block is a child of the node that ends the block before
            deep = np.flatnonzero((b > 0) & (back == 0))
            nothing, no_id = np.zeros(len(deep), np.int64), np.full(len(deep), np.iinfo(np.int64).max)
            out.append([b[deep] * WIDTH, keys[deep, 0, 0], keys[deep, 0, 1], nothing, nothing, no_id, nothing, np.ones(len(deep), np.int64), nothing, nothing])
            names = [n.split()[0] for n in _NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=names)


def _from_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the deeper blocks of a conversation add to the nodes of a block, one part per node."""
    for batch in batches:
        lengths = np.diff(batch.column("sizes").offsets.to_numpy())
        if not len(lengths):
            continue
        keys = _prefix_keys(batch, lengths, WIDTH)[:, 1:]
        depth = np.asarray(batch.column("b"))[:, None] * WIDTH + np.arange(1, WIDTH + 1)
        spread = lambda name: np.repeat(np.asarray(batch.column(name)), WIDTH)  # noqa: B023, E731
        zero = np.zeros(depth.size, np.int64)
        columns = [depth.ravel(), keys[:, :, 0].ravel(), keys[:, :, 1].ravel(), zero, zero, np.full(depth.size, np.iinfo(np.int64).max), zero, zero, spread("leaves"), spread("saved")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[n.split()[0] for n in _NODE.split(", ")])


def _nodes(shards: DataFrame) -> DataFrame:
    """All nodes but the root, by key; parts are added up before and after one shuffle."""
    parts = shards.mapInArrow(_node_parts, _NODE)
    own = shards.where("more or b > 0").select(
        "conv", "b", "more", "k1", "k2", "keys", "sizes",
        (~F.col("more") & (F.col("ahead") < F.size("sizes"))).cast("bigint").alias("leaf"),
        F.aggregate(F.slice("sizes", F.lit(1), F.col("back").cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("share"),
    )
    below = Window.partitionBy("conv").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    added = own.withColumns({"leaves": F.sum("leaf").over(below), "saved": F.sum("share").over(below)}).where("more")
    parts = parts.unionByName(added.select("b", "k1", "k2", "keys", "sizes", "leaves", "saved").mapInArrow(_from_below, _NODE))
    # sums of deeper parts carry no parent; the parts that do all carry the same
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    ups = [F.max(F.when(F.col("n") > 0, F.col(c))).alias(c) for c in ("up1", "up2")]
    return parts.groupBy("depth", "x1", "x2").agg(*ups, F.min("conv").alias("conv"), *sums)


def _ends(rows: DataFrame) -> DataFrame:
    """``depth, x1, x2, ends`` of rows ``(depth, x1, x2, conv)``: the digest of the ascending ids per key, joined by commas.

    Ids are sorted in ranges, so those of one key may be put in order by many tasks; only their joined texts, in long pieces, meet in
    one task, which streams them through the digest.
    """
    key = ["depth", "x1", "x2"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*key, "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, ids, chars = None, 0, [], 0
        out: list[list] = [[], [], [], [], []]

        def put():
            for column, value in zip(out, (*now, least, ",".join(ids))):
                column.append(value)

        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now or chars > JOINED_CHARS:
                    if now is not None:
                        put()
                    now, least, ids, chars = at, conv, [], 0
                ids.append("" if conv == NO_ID else str(conv))
                chars += len(ids[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.string()])], names=[*key, "least", "ids"])
            out = [[], [], [], [], []]
        if now is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.string()])], names=[*key, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at == now:
                    sha.update(("," + ids).encode())
                    continue
                if now is not None:
                    for column, value in zip(out, (*now, sha.hexdigest())):
                        column.append(value)
                now, sha = at, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 3 + [pa.string()])], names=[*key, "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], names=[*key, "ends"])

    pieces = dealt.mapInArrow(join, "depth bigint, x1 bigint, x2 bigint, least bigint, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(digest, "depth bigint, x1 bigint, x2 bigint, ends string")


def trie(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, one row per node.

    ``rows`` are turns ``conv, pos, t1, t2, n_bytes``, ``totals`` all conversations with their number of turns. A node is named by its
    smallest member and its depth.
    """
    ship_package(rows.sparkSession)
    shards = _shards(_blocks(rows), totals)
    none, zero = hashlib.sha256(b"").hexdigest(), F.lit(0).cast("bigint")
    ended = shards.where("not more").select((F.col("b") * WIDTH + F.size("sizes")).alias("depth"), "x1", "x2", "conv")
    # the root's key is that of nothing; conversations without turns end there
    turnless = totals.where("total = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv")
    # of the root only the ends are known here, and only if it has any
    stored = materialize(_nodes(shards).join(_ends(ended.unionByName(turnless)), ["depth", "x1", "x2"], "full"), "nodes")
    nodes, below_root = stored.where("depth > 0"), F.col("depth") == 1
    top = stored.where("depth < 2").agg(
        F.count(F.when(below_root, 1)).alias("children"), F.sum(F.when(below_root, F.col("leaves"))).alias("below"),
        F.sum(F.when(below_root, F.col("saved"))).alias("saved"), F.max(F.when(F.col("depth") == 0, F.col("ends"))).alias("ends"),
    )
    members = totals.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where("n > 0")
    root = members.join(F.broadcast(top), F.lit(True)).select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("bigint").alias("up1"), F.lit(None).cast("bigint").alias("up2"),
        "conv", "n", "children", F.coalesce("below", F.lit(1).cast("bigint")).alias("leaves"), F.coalesce("saved", zero).alias("saved"), "ends",
    )
    every = nodes.unionByName(root)
    parents = every.where("children > 0").select(F.struct((F.col("depth") + 1).alias("depth"), F.col("x1"), F.col("x2")).alias("up"), F.col("conv").alias("parent"), F.col("children").alias("rows"))
    below = every.withColumn("up", F.struct("depth", F.col("up1").alias("x1"), F.col("up2").alias("x2")))
    found = spread_lookup(below, parents, "up", "rows", ["x1", "x2"], how="left")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(f"{'' if c == 'conv' else 'parent_'}conv_id")
    return found.select(
        shown("conv"), "depth", shown("parent"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie over the conversations of ``turns(conv_id, turn, role, text)``, each rebuilt with the head of another."""
    return trie(*rebuilt(numbered(turns)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over the conversations of ``turns(conv_id, turn, role, text)`` as they are."""
    rows = numbered(turns)
    return trie(rows, rows.groupBy("conv").agg(F.count("*").alias("total")))
