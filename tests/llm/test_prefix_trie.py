"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from fieldcast.llm import prefix_trie
from fieldcast.llm.prefix_trie import shared_heads, turn_rows

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key1 string"


def rebuilt(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c in own:
        own[c] = [(r[2] or "", r[3] or "") for r in sorted(own[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs, nodes = rebuilt(rows), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for x in sorted(nodes, key=len, reverse=True):
        leaves[x] = leaves.get(x, 0) or 1
        saved[x] = saved.get(x, 0) + (len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0)
        if x:
            for total, v in ((children, 1), (leaves, leaves[x]), (saved, saved[x])):
                total[x[:-1]] = total.get(x[:-1], 0) + v
    ends = {x: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(x)) for x, m in nodes.items()}
    return sorted(((min(m), len(x), min(nodes[x[:-1]]) if x else None, len(m), children.get(x, 0), leaves[x], saved[x], hashlib.sha256(ends[x].encode()).hexdigest()) for x, m in nodes.items()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), n):
        for k in range(rng.choice((0, 1, 2, 3, 6, 8, 9, 16, 17, 30))):
            rows.append((c, rng.choice((k, k, k, None)), rng.choice(("user", "assistant", None, "")), rng.choice(("x", "é", None, "", "long " * 300)), 1, "mine"))
    return rows + rows[5:8] + [(None, 0, "user", "lost", 1, "mine")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_exact(spark, seed):
    rows = made(seed, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie.prefix_trie(shared_heads(turn_rows(df))).collect()), key=str) == brute(rows)


def test_long_conversations_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, k, "user", f"t{k}", 1, "") for c in range(200, 240) for k in range(7)]
    rows += [(100, k, "user", f"t{k % 3}", 1, "") for k in range(150)] + [(101, k, "user", f"t{k % 3}", 1, "") for k in range(149)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(shared_heads(turn_rows(df))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert prefix_trie.prefix_trie(shared_heads(turn_rows(df.limit(0)))).count() == 0


def test_only_turnless_conversations(spark):
    """Conversation 3 has h = 5 of its one turn, and no base."""
    rows = [(c, 0, "user", "x", 1, "") for c in (301, 302, 303, 304, 305, 306) if zlib.crc32(str(c).encode()) % 6]
    df = spark.createDataFrame(rows, SCHEMA)
    got = list(map(tuple, prefix_trie.prefix_trie(shared_heads(turn_rows(df))).collect()))
    assert got == brute(rows) and len(got) == 1
