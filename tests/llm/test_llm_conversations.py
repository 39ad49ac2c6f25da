"""Byte-level BPE, conversation repair and the prefix trie against brute force and the reference library."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillmesh.llm import byte_bpe, prefix_trie, turn_repair
from quillmesh.llm.queries import QUERIES

TURNS = "conv_id bigint, turn bigint, role string, text string, pos string, gone int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(parts)


# --- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.RANKS), special_tokens={})


def ids_of(text):
    return np.frombuffer(byte_bpe.rank_encoder().encode(text), "<i4").tolist()


def test_bpe_equals_the_library_on_random_texts(library):
    dice = random.Random(5)
    pools = ["ab", "aé ß", "  \n\t x", "the quick'll 've0123", "!?.,", "ǅ日本語中文", "\x1c\x1f\x85　 a", "<|endoftext|> "]
    for _ in range(4000):
        text = "".join(dice.choice(dice.choice(pools)) for _ in range(dice.choice([1, 5, 60, 400])))
        assert ids_of(text) == library.encode_ordinary(text), text
        assert byte_bpe.rank_encoder().decode(ids_of(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 70_001, " " * 65_536 + "x", "ab" * 30_000, "abcabd" * 9000 + "q", "!" * 50_000, "日本" * 20_000, "ha" * 9000 + "hah" * 9000])
def test_bpe_of_matches_of_any_length(library, text):
    assert ids_of(text) == library.encode_ordinary(text)
    assert byte_bpe.rank_encoder().decode(ids_of(text)) == text.encode()


def test_join_of_encodings_is_associative(library):
    own, dice = byte_bpe.rank_encoder(), random.Random(2)
    for _ in range(500):
        a, b, c = (own.merge("".join(dice.choice("theandin") for _ in range(dice.randint(1, 40))).encode()) for _ in range(3))
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c))
        assert own.join([], a) == a == own.join(a, [])


def test_every_token_encodes_to_itself():
    """What the argument for ``join`` needs of a rank file."""
    own = byte_bpe.rank_encoder()
    plain = byte_bpe.RankEncoder({t: r for t, r in own.ranks.items()}, byte_bpe.split_pattern())
    for token, rank in list(own.ranks.items())[::37]:
        without = dict(own.ranks)
        if len(token) > 1:
            del without[token]
            plain.ranks = without
            assert len(plain.merge(token)) == 2
        assert own.merge(token) == [rank]


def test_bpe_query(spark, data, library, monkeypatch):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(i := library.encode_ordinary(r.text or "")), sha(" ".join(map(str, i))), sha(r.text or "")) for r in texts)
    assert sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, data).collect())) == want
    monkeypatch.setattr(byte_bpe, "BATCH_IDS", 1)
    rows = [(1, None, "a"), (None, "", "b"), (2, "x y", "c"), (2, "x y", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=str) == sorted(
        ((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"))).collect() == []


# --- conversation repair --------------------------------------------------------------------------


def damaged(rows):
    out, seen = [], []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        seen.append(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    groups = {c: [] for c in seen}
    for row in out:
        groups[row[0]].append(row)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return groups


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, marks):
    """Every edit of every row with up to two inserted turns (of two roles) anywhere."""
    gaps = [(w, 2 * len(w), "I" * len(w)) for n in (0, 1, 2) for w in itertools.permutations(["user", "assistant"], n)]
    options = [[((), c, w, tuple((r, "") for r in g))[1:] for g, c, w in gaps]]
    for (_, _, role, text), mark in zip(rows, marks):
        cut = mark == "truncated"
        edits = [(3, "D", ())]
        if mark not in ("blank", "duplicate"):
            edits += [(cut, "K", ((role, text),))] + [(2 + cut, "R", ((r, text),)) for r in ("user", "assistant")]
        options += [edits, options[0]]
    best = None
    for choice in itertools.product(*options):
        turns = [t for c in choice for t in c[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            found = (sum(c[0] for c in choice), "".join(c[1] for c in choice), turns)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def best_edits(rows, marks):
    """The same by a table of whole audits per state of the order."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    table = {"": (0, "", [])}

    def widen():
        for _ in range(3):
            for q, (c, w, t) in list(table.items()):
                for r in ("user", "assistant"):
                    if (q, r[0]) in step:
                        put(table, step[q, r[0]], (c + 2, w + "I", [*t, (r, "")]))

    def put(to, q, new):
        if q not in to or new[:2] < to[q][:2]:
            to[q] = new

    for (_, _, role, text), mark in zip(rows, marks):
        cut, after = mark == "truncated", {}
        plain = dict(table)
        widen()
        for source in (plain, table):
            for q, (c, w, t) in source.items():
                put(after, q, (c + 3, w + "D", t))
                if mark not in ("blank", "duplicate"):
                    if (q, role[:1]) in step:
                        put(after, step[q, role[:1]], (c + cut, w + "K", [*t, (role, text)]))
                    for r in ("user", "assistant"):
                        if (q, r[0]) in step:
                            put(after, step[q, r[0]], (c + 2 + cut, w + "R", [*t, (r, text)]))
        table = after
    widen()
    return min((v for q, v in table.items() if q in ("", "a")), key=lambda v: v[:2])


def brute_repair(rows, search):
    out = []
    for conv, own in damaged(rows).items():
        marks = faults(own)
        cost, audit, turns = search(own, marks)
        known = [t for _, t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns))))
    return sorted(out, key=str)


def odd_turns(seed, conversations, longest, texts=("Yes.", "No!", "cut", "", None, " \t\n", "a. ", "b?\x0b", "x. y")):
    dice = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unit", "User"]
    rows = []
    for conv in range(conversations):
        for turn in range(dice.randint(1, longest)):
            at = dice.choice([turn, turn, turn + 3, turn // 2, None])
            rows.append((conv * 3 - 4 if conv else None, at, dice.choice(roles[: dice.choice([3, 10])]), dice.choice(texts) if dice.random() < 0.7 else f"Own {dice.random()}."))
    return rows


def repaired(spark, rows, **more):
    found = turn_repair.repair(turn_repair.damage(turns_of(spark, rows, **more)), turn_repair.F.col("gone"))
    return sorted(map(tuple, turn_repair.digest(found).collect()), key=str)


def test_repair_equals_all_edits(spark):
    rows = odd_turns(11, 120, 3)
    large = {c for c, own in damaged(rows).items() if len(own) > 3}
    rows = [r for r in rows if r[0] not in large]
    assert brute_repair(rows, best_edits) == brute_repair(rows, all_edits) == repaired(spark, rows)


def test_repair_equals_a_table_of_whole_audits(spark, data):
    rows = odd_turns(12, 300, 25)
    assert repaired(spark, rows) == brute_repair(rows, best_edits)
    table = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op11_turn_repair"](spark, data).collect()), key=str) == brute_repair(table, best_edits)


def test_repair_of_spilled_conversations(spark, monkeypatch):
    """Chunks of a few turns give what one piece gives."""
    rows = odd_turns(13, 40, 60)
    monkeypatch.setattr(turn_repair, "HOLD_ROWS", 7)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(turn_repair)  # workers see the small bound
    try:
        found = turn_repair.repair(turn_repair.damage(turns_of(spark, rows)), turn_repair.F.col("gone"))
        assert found.where("block > 0").count() > 20
        assert sorted(map(tuple, turn_repair.digest(found).collect()), key=str) == brute_repair(rows, best_edits)
    finally:
        cloudpickle.unregister_pickle_by_value(turn_repair)


def test_repair_of_little(spark):
    assert repaired(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    (block,) = turn_repair.repair(turns_of(spark, [(1, 0, "assistant", "So.")])).collect()
    assert (block.audit, block.cost, [tuple(t) for t in block.turns]) == ("IK", 2, [("user", ""), ("assistant", "So.")])


# --- prefix trie ----------------------------------------------------------------------------------


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    if rebuild:
        h = {c: 0 if c is None else zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: t if c is None else own.get(c - c % 5, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    nodes = defaultdict(list)
    for c, t in own.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    least = lambda ids: min(ids, key=lambda c: (c is not None, c or 0))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = leaves[key] or 1
        saved[key] += (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        if key:
            children[key[:-1]] += 1
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    out = []
    for key, ids in nodes.items():
        ends = sorted((c for c in ids if len(own[c]) == len(key)), key=lambda c: (c is not None, c or 0))
        parent = least(nodes[key[:-1]]) if key else None
        out.append((least(ids), len(key), parent, len(ids), children[key], leaves[key], saved[key], sha(",".join("" if c is None else str(c) for c in ends))))
    return sorted(out, key=str)


def shared_turns(seed, conversations, longest):
    dice = random.Random(seed)
    script = [(dice.choice(["user", "assistant", None]), dice.choice(["é", "ok", "", None, "long text"]) if i % 3 else f"t{i}") for i in range(longest)]
    rows = []
    for conv in range(conversations):
        keep, n = dice.choice([0, 3, longest, longest]), dice.randint(1, longest)
        for turn in range(n):
            role, text = script[turn] if turn < keep else (dice.choice(["user", "assistant"]), dice.choice(["a", "b"]))
            rows.append((dice.choice([conv, conv * 7 + 2, None]) if conv % 9 == 8 else conv - 3, None if turn == 0 and conv % 4 == 0 else turn, role, text))
    return rows


def tries(spark, rows, name="rebuilt_trie"):
    return sorted(map(tuple, getattr(prefix_trie, name)(turns_of(spark, rows, 5)).collect()), key=str)


def test_trie_equals_brute_force(spark, data):
    rows = shared_turns(3, 60, 10)
    assert tries(spark, rows) == brute_trie(rows)
    assert tries(spark, rows, "conversation_trie") == brute_trie(rows, rebuild=False)
    table = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_prefix_trie"](spark, data).collect()), key=str) == brute_trie(table)


@pytest.mark.parametrize("width, shard", [(64, 7), (3, 5), (2, 20_000)])
def test_trie_with_small_blocks_and_shards(spark, monkeypatch, width, shard):
    """Nodes cut by shards and conversations cut by blocks come together again."""
    from pyspark import cloudpickle

    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "CHUNK_ROWS", 4)
    monkeypatch.setattr(prefix_trie, "JOINED_CHARS", 3)
    cloudpickle.register_pickle_by_value(prefix_trie)
    try:
        rows = shared_turns(4, 50, 14)
        rows += [(c, t, "user", "same") for c in range(500, 540) for t in range(6)]
        assert tries(spark, rows) == brute_trie(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(prefix_trie)


def test_trie_of_little(spark):
    assert tries(spark, []) == []
    short = next(c for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert tries(spark, [(short, 0, "user", "x")]) == [(short, 0, None, 1, 0, 1, 0, sha(str(short)))]
    assert tries(spark, [(None, None, None, None)]) == brute_trie([(None, None, None, None)])


def test_trie_counts_turns_over_task_borders_and_stores_each_table_once(spark, monkeypatch):
    from quillmesh import session

    rows = [(7, t, "user", f"a{t}") for t in range(300)] + [(c, t, "user", f"a{t}") for c in (5, 6, 9, 12) for t in range(3)]
    stored = []
    monkeypatch.setattr(prefix_trie, "materialize", lambda df, name, *more: stored.append(name) or session.materialize(df, name, *more))
    numbered = prefix_trie.numbered(turns_of(spark, rows))
    # the long conversation lies in several tasks
    places = defaultdict(list)
    for r in numbered.collect():
        places[r.conv].append(r.pos)
    assert {c: sorted(p) for c, p in places.items()} == {7: [*range(300)], **{c: [0, 1, 2] for c in (5, 6, 9, 12)}}
    turns, totals = prefix_trie.rebuilt(numbered)
    # who takes what from whom is settled once, not again by every use
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    out = prefix_trie.trie(turns, totals)
    assert stored == ["turns", "conversations", "shards", "nodes"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_trie(rows)


# --- long texts of item words ---------------------------------------------------------------------


def test_contamination_of_long_texts_that_repeat_item_words(spark):
    """Matches grow with the text, not with its square: numbers are kept of them, never the text."""
    from quillmesh.llm import decontaminate

    item = [f"w{i % 4}" for i in range(40)]
    text = (item + ["x"]) * 2400
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item[:12] * 8000)), (3, "w0 " * 90_000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:20]))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].item_ids) == (2400 * 41, 2400 * 40, ["7", "8"])
    assert (got[2].n_hit, got[2].contaminated) == (96_000, True)
    assert (got[3].n_hit, got[3].n_items, got[3].contaminated) == (0, 0, False)
