"""The prefix trie against a plain one of Python dicts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from dqspark.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth string"


def plain(turns, rebuilt):
    said = defaultdict(list)
    for c, turn, role, text, _ in turns:
        if c is not None:
            said[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    if rebuilt:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[:heads[c]] + v[heads[c]:] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    out = []
    for node, m in members.items():
        below = [u for u in members if u[:len(node)] == node]
        leaves = [u for u in below if not any(x[:-1] == u and x for x in members)]
        ends = ",".join(str(c) for c in m if len(own[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m),
                    sum(x[:-1] == node and x != () for x in members), len(leaves),
                    sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, turns, rebuilt):
    df = trie.prefix_trie(spark.createDataFrame(turns, TURNS), rebuilt=rebuilt)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(n, seed, step=1):
    r = random.Random(seed)
    return [(step * c, t, r.choice(["user", None]) if t % 3 == 0 else "bot", r.choice(["hi", "yes é", "", None]) if t else "hello", "x")
            for c in range(n) for t in range(r.randint(1, 8))]


@pytest.mark.parametrize("rebuilt", [False, True])
def test_small_tries(spark, rebuilt, monkeypatch):
    monkeypatch.setattr(trie, "CONVERSATIONS", 4)  # several shards and blocks of positions
    monkeypatch.setattr(trie, "POSITIONS", 3)
    turns = some(30, 1, 37)
    # role and text that are empty or null are the same turn
    assert got(spark, turns, rebuilt) == plain(turns, rebuilt)


@pytest.mark.parametrize("rebuilt", [False, True])
def test_one_shard(spark, rebuilt):
    turns = some(25, 2, 51)
    assert got(spark, turns, rebuilt) == plain(turns, rebuilt)


def test_nulls_repeats_and_empty(spark):
    turns = ([(None, 1, "user", "lost", "x")] * 3 + [(7, None, "user", "a", "x")] * 4 + [(7, 1, None, None, None)]
             + [(8, None, "user", "a", "x")] * 2 + [(100, 1, "user", "b", "x"), (101, 1, "user", "c", "x"), (-250, 1, "u", "d", "x")])
    assert got(spark, turns, False) == plain(turns, False)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversation_and_text(spark):
    turns = [(1, t, "user", str(t), "x") for t in range(700)] + [(2, t, "user", str(t), "x") for t in range(690)] + [(3, 0, "user", "z" * 500_000, "x")]
    rows = {(r[0], r[1]): r for r in got(spark, turns, False)}
    assert len(rows) == 702
    assert rows[1, 690][3:6] == (2, 1, 1) and rows[1, 700][3:6] == (1, 0, 1) and rows[3, 1][6] == 0
    assert rows[1, 0][6] == sum(len(str(t)) for t in range(690))


def test_turnless_conversations(spark):
    turns = [(c, 1, "user", "only", "x") for c in range(101, 160)]  # no conversation 100 lends its turns
    assert got(spark, turns, True) == plain(turns, True)
    assert max(r[3] for r in plain(turns, True)) == 59
