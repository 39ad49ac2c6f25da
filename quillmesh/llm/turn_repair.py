"""Repair of conversation structure: the cheapest edits that give a legal turn order, by dynamic programming over a
secondary-sorted stream.

Turns are repartitioned by conversation and sorted by turn; a task streams over them and carries the state of the
program across Arrow batches. A legal order has the role initials ``(s?(ua)+)?``, so the program has four states
(nothing yet, after s, after u, after a). What it has to remember of the past are the four costs, relative to the
least one, and the order of the four audits so far. These are finitely many cases: ``Program`` lists them once, the
same in every worker, and a row is one step in a table. A row's backpointer is the number of the step taken, two bytes.

A conversation that stays below ``HOLD_ROWS`` and ``HOLD_CHARS`` is traced back where it was read. A longer one is spilled
in chunks to a table in the shared folder, turns beside their backpointers; a second stage traces the backpointers from the last
chunk to the first, a third one applies the edits to the turns in order. No stage holds more than one chunk.

Edits: K keeps a turn (cost 0), R gives it the role that the order asks for (2), D deletes it (3; the only one for a
blank or duplicate turn), I inserts a turn without text anywhere (2); a truncated turn that is not deleted adds 1. Of
all cheapest edits the one whose initials come first in ASCII order is taken. Two audits of equal cost and equal
state are never one the beginning of the other (both hold one letter other than I per row and end in it), so
comparing them as far as they have got is enough.

Defined cases: null role or text is one space; null turns come first; turns of one number are ordered by role, then text; rows
without a conversation id form one conversation; a role without a first letter s, u or a (an empty one too) cannot
be kept; repeated rows are duplicates; a conversation whose rows are all gone is kept, with zeros and no turns; an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.session import materialize, ship_package

#: White space, and the ends of a whole sentence.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A conversation with more turns or characters than these is spilled in chunks of this size.
HOLD_ROWS, HOLD_CHARS = 50_000, 8 << 20
#: A state that is dearer than the cheapest by more than this cannot catch up: an insertion or two and a deletion lead
#: from any state to one that goes on at least as well.
LAG = 12

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; letters: 0 s, 1 u, 2 a, 3 any other
_NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_INSERTED = (2, 2, 3, 2)
_LAST = {0: "", 1: "II", 2: "I", 3: ""}
ROLES = {2: "user", 3: "assistant"}
FINE, BLANK, DUPLICATE, CUT = range(4)

BLOCK = (
    "conv_id bigint, block int, audit string, turns array<struct<role:string,text:string>>, gaps bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)
_NAMES = ["conv_id", "block", "audit", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


class Program:
    """All steps of the program: ``steps[case][kind]`` is ``(next case, cost, step number)``.

    ``pointers[step number][state]`` is ``(state before, edits)``. A kind of row is 0 for one that must go, else
    ``1 + 2 * letter + truncated``.
    """

    def __init__(self):
        start = ((0, None, None, None), (0,))
        self.cases, self.steps, self.pointers = [start], [], []
        known = {start: 0}
        for case in self.cases:  # grows while it is walked
            row = []
            for kind in range(9):
                after, cost, pointers = self._step(case, kind)
                if after not in known:
                    known[after] = len(self.cases)
                    self.cases.append(after)
                row.append((known[after], cost, len(self.pointers)))
                self.pointers.append(pointers)
            self.steps.append(row)

    @staticmethod
    def _step(case, kind: int):
        costs, order = case
        found: dict[int, tuple] = {}
        for rank, state in enumerate(order):
            before, cost, word = state, costs[state], ""
            for _ in range(3):
                moves = [(before, DELETE, "D")]
                if kind:
                    letter, cut = divmod(kind - 1, 2)
                    if (before, letter) in _NEXT:
                        moves.append((_NEXT[before, letter], KEEP + TRUNCATED * cut, "K"))
                    moves.append((_INSERTED[before], REROLE + TRUNCATED * cut, "R"))
                for to, price, edit in moves:
                    new = (cost + price, rank, word + edit, state)
                    if to not in found or new < found[to]:
                        found[to] = new
                before, cost, word = _INSERTED[before], cost + INSERT, word + "I"
        least = min(f[0] for f in found.values())
        found = {to: f for to, f in found.items() if f[0] <= least + LAG}
        order = tuple(sorted(found, key=lambda to: found[to][1:3]))
        costs = tuple(found[to][0] - least if to in found else None for to in range(4))
        return (costs, order), least, {to: (f[3], f[2]) for to, f in found.items()}

    def finish(self, case: int) -> tuple[int, int]:
        """The state in which the cheapest edits end, and their cost above the case's least."""
        costs, order = self.cases[case]
        cost, _, state = min((costs[q] + INSERT * len(_LAST[q]), rank, q) for rank, q in enumerate(order))
        return state, cost

    def trace(self, steps, state: int) -> tuple[list[str], int]:
        """The edits of a run of steps that ends in ``state``, and the state before it."""
        words = []
        for number in reversed(steps):
            state, word = self.pointers[number][state]
            words.append(word)
        words.reverse()
        return words, state


PROGRAM = Program()


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` of conversations damaged by a checksum of ``conv_id:turn`` modulo 20.

    0 drops the row (``gone`` marks what is left of it), 1 empties its text, 2 removes the sentence ends from it, 3 repeats it, 4
    makes its role user.
    """
    rows = _plain(turns)
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, ROLES[2]).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _plain(turns: DataFrame, *more: str) -> DataFrame:
    whole = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), whole("role"), whole("text"), *more)


def _marked(turns: DataFrame, gone: Column | None) -> DataFrame:
    """Rows in stream order with their letter and first fault.

    Copies are found by a second sort of the same partitions, so no task keeps the turns it has seen.
    """
    lost = F.lit(False) if gone is None else F.coalesce(gone.cast("boolean"), F.lit(False))
    named = turns.select("conv_id", "turn", "role", "text", lost.alias("gone"))
    rows = _plain(named, "gone").repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    stripped = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(stripped == "", BLANK).when(again, DUPLICATE).when(~F.substring(stripped, -1, 1).isin(*ENDS), CUT).otherwise(FINE)
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = rows.select("conv_id", "turn", "gone", "role", "text", letter.alias("letter"), fault.alias("fault"), again.alias("again"))
    return marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again").drop("again")


class _Conversation:
    """What the stream carries of one conversation."""

    def __init__(self, key):
        self.key, self.case, self.cost, self.chunk = key, 0, 0, 0
        self.steps, self.roles, self.texts, self.chars = array("H"), [], [], 0
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.before = -1

    def add(self, turn, role: str, text: str, letter: int, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.before >= 0 and (self.before, letter) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = letter
        self.faults[fault] += 1
        kind = 0 if fault in (BLANK, DUPLICATE) else 1 + 2 * letter + (fault == CUT)
        self.case, cost, number = PROGRAM.steps[self.case][kind]
        self.cost += cost
        self.steps.append(number)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.steps) >= HOLD_ROWS or self.chars >= HOLD_CHARS

    def counts(self, cost: int) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost]


def _applied(words: list[str], roles: list[str], texts: list[str], state: int) -> tuple[list[dict], int]:
    """The turns after the edits, from a state on, and the state after them."""
    out = []
    for word, role, text in zip(words, roles, texts):
        for edit in word:
            if edit == "D":
                continue
            if edit == "K":
                state = _NEXT[state, {"s": 0, "u": 1, "a": 2}[role[0]]]
                out.append({"role": role, "text": text})
            else:
                state = _INSERTED[state]
                out.append({"role": ROLES[state], "text": text if edit == "R" else ""})
    return out, state


def _closing(state: int) -> list[dict]:
    return [{"role": r, "text": ""} for r in {"": (), "I": ("assistant",), "II": ("user", "assistant")}[_LAST[state]]]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled conversations as one block each; longer ones as chunks of turns and backpointers, and a last state."""
    names = [*_NAMES, "spilled", "steps", "state"]
    rows: list[list] = [[] for _ in names]
    now: _Conversation | None = None
    held = 0

    def put(values: list) -> None:
        for column, value in zip(rows, values):
            column.append(value)

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), _TURNS, *[pa.int64()] * 6, pa.bool_(), pa.binary(), pa.int32()]
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names=names)
        for column in rows:
            column.clear()
        return out

    def spill(c: _Conversation) -> None:
        turns = [{"role": r, "text": t} for r, t in zip(c.roles, c.texts)]
        put([c.key, c.chunk, None, turns, *[None] * 6, True, c.steps.tobytes(), None])
        c.steps, c.roles, c.texts, c.chars, c.chunk = array("H"), [], [], 0, c.chunk + 1

    def settle(c: _Conversation) -> None:
        state, more = PROGRAM.finish(c.case)
        counts = c.counts(c.cost + more)
        if c.chunk:
            spill(c)
            put([c.key, c.chunk, None, None, *counts, True, None, state])
            return
        words, _ = PROGRAM.trace(c.steps, state)
        turns, _ = _applied(words, c.roles, c.texts, 0)
        put([c.key, 0, "".join(words) + _LAST[state], turns + _closing(state), *counts, False, None, None])

    for batch in batches:
        for key, turn, gone, role, text, letter, fault in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or key != now.key:
                if now is not None:
                    settle(now)
                now = _Conversation(key)
            if gone:
                continue
            now.add(turn, role, text, letter, fault)
            held += len(text)
            if now.full():
                spill(now)
            if held >= HOLD_CHARS or len(rows[0]) >= HOLD_ROWS:
                yield flush()
                held = 0
    if now is not None:
        settle(now)
    yield flush()


def _trace_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from last to first: the edits of each, by the state that the chunk after it begins with."""
    now, state = object(), 0
    for batch in batches:
        out: list[list] = [[], [], []]
        for key, chunk, steps, last in zip(*(column.to_pylist() for column in batch.columns)):
            if key != now:
                now, state = key, last
                continue
            words, state = PROGRAM.trace(array("H", steps), state)
            for column, value in zip(out, (key, chunk, words)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.list_(pa.string())))], names=["key", "chunk", "words"])


def _apply_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from first to last with their edits, as blocks; the last block has the counts."""
    now, state = object(), 0
    for batch in batches:
        out: list[list] = [[] for _ in _NAMES]
        for key, chunk, turns, words, last, *counts in zip(*(column.to_pylist() for column in batch.columns)):
            if key != now:
                now, state = key, 0
            if last is None:
                done, state = _applied(words, [t["role"] for t in turns], [t["text"] for t in turns], state)
                audit = "".join(words)
            else:
                done, audit = _closing(last), _LAST[last]
            for column, value in zip(out, (key, chunk, audit, done, *counts)):
                column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.string(), _TURNS, *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=_NAMES)


def repair(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """Blocks of repaired conversations: ``conv_id, block, audit, turns array<struct<role, text>>`` and, on the last block of each,
    ``gaps, blank, duplicate, truncated, illegal, cost`` of the conversation as it came (null on others).

    Rows where ``gone`` is true only say that the conversation exists. A conversation within the bounds is one block;
    the blocks of a longer one follow each other in one partition.
    """
    ship_package(turns.sparkSession)
    found = materialize(_marked(turns, gone).mapInArrow(_stream, f"{BLOCK}, spilled boolean, steps binary, state int"), "repaired")
    settled = found.where("not spilled").select(*_NAMES)
    chunks = found.where("spilled")
    backward = chunks.select("conv_id", "block", "steps", "state").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    edits = backward.mapInArrow(_trace_back, "key bigint, chunk int, words array<string>")
    joined = chunks.join(edits, F.col("conv_id").eqNullSafe(F.col("key")) & (F.col("block") == F.col("chunk")), "left")
    forward = joined.select("conv_id", "block", "turns", "words", "state", *_NAMES[4:]).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return settled.unionByName(forward.mapInArrow(_apply_forward, BLOCK))


def digest(blocks: DataFrame) -> DataFrame:
    """One row per conversation: the counts, the whole audit, and ``repaired_sha256`` of its ``role:text`` lines.

    ``blocks`` is what ``repair`` returns: blocks of a conversation follow each other, so the digest is a narrow fold.
    """
    ship_package(blocks.sparkSession)
    names = ["conv_id", *_NAMES[4:], "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, any_turn = [], hashlib.sha256(), False
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, part, turns, *counts in zip(*(column.to_pylist() for column in batch.columns)):
                audit.append(part)
                for t in turns:
                    line = f"{t['role']}:{t['text']}"
                    sha.update(("\n" + line if any_turn else line).encode())
                    any_turn = True
                if counts[-1] is not None:
                    for column, value in zip(out, (key, *counts, "".join(audit), sha.hexdigest())):
                        column.append(value)
                    audit, sha, any_turn = [], hashlib.sha256(), False
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in names[-2:] else pa.int64()) for n, x in zip(names, out)], names=names)

    kinds = ", ".join(f"{n} {'string' if n in names[-2:] else 'bigint'}" for n in names)
    return blocks.select("conv_id", "audit", "turns", *_NAMES[4:]).mapInArrow(run, kinds)
