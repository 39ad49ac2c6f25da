"""Byte-level BPE encoding by a tree of joins, and decoding.

A rank file defines the encoding of a byte string: the adjacent pair of lowest rank is merged, leftmost first, until
no pair has a rank. ``RankEncoder.encode`` cuts a string in two, encodes the halves the same way and joins the results:
the tokens around the cut are encoded again in a window that doubles until its outermost tokens come out unchanged.

Why that is enough: merges of a trained rank file happen in ascending rank, so a merge across the border of two
tokens depends on these two alone, and a token sequence is the encoding of its bytes exactly if each adjacent pair is
the encoding of its own bytes. Pairs outside the window come from a half and pairs inside from the window's own
encoding; the two pairs at the window's ends are those of the halves again once the outermost tokens are unchanged.
A window that has grown over a whole half has no such pair on that side. So ``join`` is associative, and encodings
form a monoid under it with the empty text as neutral element.

A text is first split by the pattern, and each match is encoded separately; matches may have any length. Decoding
looks tokens up in runs and concatenates the runs pairwise up a tree.

Defined cases: null text is empty and has no ids; repeated rows and null ids of documents are rows like any other; an
empty table gives no rows. Extra columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.tokens import BATCH_ROWS, WordIds, tokenizer_path
from quillmesh.session import ship_package

RANKS = "byte_bpe_50k.tiktoken"
#: Strings up to this many bytes are leaves of the tree.
LEAF = 16
#: Stands for a pair without a rank.
NO_RANK = np.int32(2**31 - 1)
#: Encodings of matches that one worker keeps; longer matches than ``CACHED_CHARS`` are not kept.
CACHE_WORDS, CACHED_CHARS = 50_000, 64
#: Words that a worker's table keeps, and characters taken through it at once.
TABLE_WORDS, TABLE_CHARS = 300_000, 4 << 20
#: Ids that one output batch holds at most, unless one document has more.
BATCH_IDS = 1_000_000
#: Tokens of a leaf of the decoding tree.
DECODE_LEAF = 4096

_loaded: dict[str, "RankEncoder"] = {}
_tables: dict[str, WordIds] = {}


def read_ranks(name: str) -> dict[bytes, int]:
    """``token bytes -> rank`` of a rank file: lines of base64 and a number."""
    with open(tokenizer_path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def split_pattern() -> str:
    """The pattern published with the rank file. White space is the Unicode property there, without 1C to 1F."""
    import public_tokenizers

    return public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class RankEncoder:
    """Encodes and decodes byte strings and texts by one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = token_list(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to put a token together from two others
        pairs = sorted(
            (ranks[t[:i]] * len(self.tokens) + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        )
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs))
        self.cache: dict[str, np.ndarray] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The definition itself, with a heap of candidate pairs over a linked list."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            # a part is named by its first byte; the pair is out of date if either part has changed since
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if back[i] >= 0 and (r := ranks.get(piece[back[i] : stop])) is not None:
                heapq.heappush(heap, (r, back[i], stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def merge_leaves(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """The encodings of many short strings at once: each round merges one pair of every string that still has one."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = self._pair_ranks(ids, owner)
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(ids)))
            done = least == NO_RANK
            if done.any():
                mine = np.repeat(done, lengths)
                settled = np.split(ids[mine], np.cumsum(lengths[done])[:-1])
                for n, found in zip(owner[starts[done]].tolist(), settled):
                    out[n] = found
                ids, owner, rank = ids[~mine], owner[~mine], rank[~mine]
                if not len(ids):
                    break
                starts, least, lengths = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), least[~done], lengths[~done]
            # the leftmost pair of least rank of every string
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            shifted = (np.cumsum(keep) - 1)[hits]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for at in (shifted, shifted[shifted > 0] - 1):
                after = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((after > at) & (owner[after] == owner[at]), self._ranks_of(ids[at], ids[after]), NO_RANK)
        return [x if x is not None else np.zeros(0, np.int32) for x in out]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK).astype(np.int32)

    def _pair_ranks(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), NO_RANK, np.int32)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self._ranks_of(ids[:-1], ids[1:]), NO_RANK)
        return rank

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not a or not b:
            return a or b
        width = 1
        while True:
            left, right = a[-width:], b[:width]
            window = self.merge(b"".join(map(self.tokens.__getitem__, left + right)))
            if (width >= len(a) or window[0] == left[0]) and (width >= len(b) or window[-1] == right[-1]):
                return a[:-width] + window + b[width:]
            width *= 2

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Halves are cut at the largest power of two below the length, so that repeats fall alike on both sides."""
        if len(piece) <= LEAF:
            return self.merge(piece) if piece else []
        leaves, n = [], len(piece)
        for i in range(0, n, LEAF):
            leaves.append(piece[i : i + LEAF])
        return self._tree([x.tolist() for x in self.merge_leaves(leaves)])

    def _tree(self, parts: list[list[int]]) -> list[int]:
        if len(parts) == 1:
            return parts[0]
        cut = 1 << ((len(parts) - 1).bit_length() - 1)
        return self.join(self._tree(parts[:cut]), self._tree(parts[cut:]))

    def encode_texts(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text; the leaves of all matches not seen before are merged together."""
        words = [self.split(t) for t in texts]
        cache = self.cache
        new = [w for w in set().union(*words) if w not in cache] if words else []
        if new:
            pieces = [w.encode() for w in new]
            cuts = [range(0, len(p), LEAF) for p in pieces]
            leaves = self.merge_leaves([p[i : i + LEAF] for p, cut in zip(pieces, cuts) for i in cut])
            at = 0
            for word, cut in zip(new, cuts):
                own = leaves[at : at + len(cut)]
                cache[word] = own[0] if len(own) == 1 else np.array(self._tree([x.tolist() for x in own]), np.int32)
                at += len(cut)
        none = np.zeros(0, np.int32)
        found = [none if not own else cache[own[0]] if len(own) == 1 else np.concatenate([cache[w] for w in own]) for own in words]
        if len(cache) > CACHE_WORDS or any(len(w) > CACHED_CHARS for w in new):
            cache.clear()
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return self.encode_texts([text])[0].astype("<i4").tobytes()

    def decode(self, ids: Sequence[int]) -> bytes:
        return decode_ids(self.tokens, ids)


def token_list(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode_ids(tokens: list[bytes], ids: Sequence[int]) -> bytes:
    """The bytes of all tokens: runs of them, joined pairwise up a tree."""
    runs = [b"".join(map(tokens.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)] or [b""]
    while len(runs) > 1:
        runs = [b"".join(runs[i : i + 2]) for i in range(0, len(runs), 2)]
    return runs[0]


def rank_encoder(name: str = RANKS) -> RankEncoder:
    """The worker's encoder of a rank file; made once per worker."""
    if name not in _loaded:
        _loaded[name] = RankEncoder(read_ranks(name), split_pattern())
    return _loaded[name]


def word_table(name: str = RANKS) -> WordIds:
    """The worker's table of words, each encoded by ``rank_encoder`` when it is first seen."""
    if name not in _tables:
        _tables[name] = WordIds(rank_encoder(name).encode_texts, words=TABLE_WORDS, chars=TABLE_CHARS)
    return _tables[name]


def row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_ROWS``: what a worker makes of a batch is larger than the batch."""
    for batch in batches:
        yield from (batch.slice(at, BATCH_ROWS) for at in range(0, batch.num_rows, BATCH_ROWS))


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, ids array<int>`` of ``docs(doc_id, text)``; narrow, whole texts."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_table(ranks)
        for batch in row_slices(batches):
            flat, counts = own.encode_column(batch.column("text"))
            offsets = np.append(0, np.cumsum(counts))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])
            at = 0
            while at < len(counts):
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_IDS, "right")) - 1)
                yield whole.slice(at, stop - at)
                at = stop

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, ids, decoded binary`` of ``encoded(doc_id, ids)``; null ids are none."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_list(read_ranks(ranks))
        for batch in row_slices(batches):
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            whole = [decode_ids(tokens, flat[a:z].tolist()) for a, z in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(whole, pa.binary())], names=["doc_id", "ids", "decoded"])

    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), ids.alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
