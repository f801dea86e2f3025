"""Prefix tries against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from gridtally.llm import prefixtrie
from gridtally.session import materialize

SCHEMA = "conv_id long, turn long, role string, text string, shard int, node string, key string"


def expected(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(np.fmod(conv, 5))
        paths[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == path)))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children.get(path, 0),
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def tables() -> dict[str, list[tuple]]:
    draw = random.Random(4)
    few = [(c, t, draw.choice(["user", "assistant"]), draw.choice("abc")) for c in range(200) for t in range(draw.randint(1, 7))]
    same = [(c, t, "user", f"turn {t}") for c in range(0, 300, 5) for t in range(6)]
    odd = [
        (None, 1, "user", "x"), (1, None, "user", None), (1, None, None, "b"), (1, 2, "user", ""), (1, 2, "user", ""),
        (-7, 0, "é", "ü" * 10), (-5, 0, "user", "long " * 20_000), (3, 1, "a", "bc"), (5, 1, "ab", "c"), (10, 0, None, None),
        (2**40, 5, "user", "only"), (2**40 + 1, 5, "user", "only"),
    ]
    deep = [(c, t, "user", str(t if t < 90 or c < 5 else (t, c))) for c in (0, 1, 5, 10) for t in range(150)]
    return {"few": few, "same": same, "odd": odd, "deep": deep, "empty": [], "turnless": [(4, 0, "user", "x")]}


@pytest.mark.parametrize("name", tables())
def test_trie_equals_dictionary(spark, name):
    rows = tables()[name]
    frame = spark.createDataFrame([(*row, 1, "n", "k") for row in rows], SCHEMA).repartition(3)
    turns = materialize(prefixtrie.sequences(frame), "turns")
    found = prefixtrie.prefix_trie(prefixtrie.rebuilt(turns), shard_turns=20)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_one_shard_equals_many(spark):
    frame = spark.createDataFrame([(*row, 1, "n", "k") for row in tables()["few"]], SCHEMA)
    turns = materialize(prefixtrie.sequences(frame), "turns")
    one = prefixtrie.prefix_trie(turns, shard_turns=10**6).collect()
    many = prefixtrie.prefix_trie(turns, shard_turns=3).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_double_array_holds_exactly_its_prefixes():
    draw = random.Random(9)
    words = sorted({tuple(draw.randint(1, 30) for _ in range(draw.randint(1, 6))) for _ in range(500)})
    lengths = np.array([len(w) for w in words])
    trie = prefixtrie.build(np.array([x for w in words for x in w]), np.cumsum(lengths) - lengths, lengths)
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    states = {(): 0}
    for prefix in sorted(prefixes, key=len)[1:]:
        states[prefix] = int(trie.step(np.array([states[prefix[:-1]]]), np.array([prefix[-1]]))[0])
    assert len(set(states.values())) == len(prefixes) and -1 not in states.values()
    for prefix, state in states.items():
        to = trie.step(np.full(31, state), np.arange(31))
        assert {c for c in range(1, 31) if to[c] >= 0} == {p[-1] for p in prefixes if p[:-1] == prefix and p}
        assert to[0] == -1


def test_double_array_grows_with_its_trie():
    # The root takes every other place, and no two free ones stand together for 25 pairs of sisters.
    words = sorted([(c, d) for c in range(2, 52, 2) for d in (1, 2)] + [(c, 1) for c in range(52, 402, 2)])
    starts, lengths = np.arange(len(words)) * 2, np.full(len(words), 2)
    trie = prefixtrie.build(np.array(words).reshape(-1), starts, lengths)
    assert (trie.check >= 0).sum() == 1 + 200 + len(words) and len(trie.check) < 2000


def test_shard_of_many_different_turns_equals_dictionary(monkeypatch):
    draw = random.Random(6)
    turn = lambda: draw.randbytes(32) + draw.randint(0, 99).to_bytes(8, "big")
    own, common = set(), [turn() for _ in range(300)]
    for _ in range(400):
        first = [turn() for _ in range(8)]
        for _ in range(5):
            rest = [draw.choice(common) if draw.random() < 0.3 else turn() for _ in range(draw.randint(1, 4))]
            own.add(tuple(first[: draw.randint(0, 8)] + rest))
    own = sorted(own)
    rows = pd.DataFrame({"turns": [b"".join(s) for s in own], "n": 1, "conv_id": range(len(own)), "ends": "x", "shard": 0})
    kept, build = [], prefixtrie.build
    monkeypatch.setattr(prefixtrie, "build", lambda *args: kept.append(build(*args)) or kept[-1])
    found = prefixtrie.shard_nodes(rows, None, None)
    members, children, leaves, saved = (defaultdict(int) for _ in range(4))
    least = {}
    for number, path in enumerate(own):
        for d in range(len(path) + 1):
            least.setdefault(path[:d], number)
            members[path[:d]] += 1
    for path in least:
        children[path[:-1]] += path != ()
    for path in least:
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (members[path] - 1) * int.from_bytes(path[-1][32:], "big") if path else 0
    nodes = sorted((least[p], len(p), members[p], children[p], leaves[p], saved[p]) for p in least)
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    assert sorted(found[columns].itertuples(index=False, name=None)) == nodes
    assert len(kept[0].check) < 8 * len(nodes)


def test_long_sequences_that_stand_together_are_cut_by_turns(spark):
    # Most turns lie in few sequences of one prefix, which a range by rows takes together.
    rows = [(c, t, "user", str(t if t < 200 else (t, c))) for c in range(30) for t in range(204)]
    rows += [(c, t, "user", str((t, c))) for c in range(30, 1200) for t in range(2)]
    frame = spark.createDataFrame([(*row, 1, "n", "k") for row in rows], SCHEMA)
    found = prefixtrie.distinct_sequences(materialize(prefixtrie.sequences(frame), "turns"))
    shards = prefixtrie.sharded(found, 1000).selectExpr("shard", "turns").collect()
    sizes, line = defaultdict(int), sorted(shards, key=lambda r: r.turns)
    for row in shards:
        sizes[row.shard] += len(row.turns) // prefixtrie.TURN
    assert len(shards) == 1200 and sum(sizes.values()) == len(rows) and max(sizes.values()) < 1204
    assert [r.shard for r in line] == sorted(r.shard for r in shards)


def test_many_ids_of_one_key_are_hashed_in_pieces(spark):
    ids = list(range(-50, 3000))
    frame = spark.createDataFrame([("hot", i) for i in ids] + [("one", 5)], "key string, conv_id long").repartition(5)
    found = dict(tuple(r) for r in prefixtrie.ends_digests(frame, piece=7).collect())
    assert found == {
        "hot": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        "one": hashlib.sha256(b"5").hexdigest(),
    }
