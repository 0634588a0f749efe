"""The prefix trie against plain Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from martwright.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, total int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, rebuilt=True):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found[conv].append((turn, (role or "", text or "")))
    own = {
        c: [t for _, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1])))]
        for c, turns in found.items()
    }
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        way = tuple(own.get(first, [])[:h] + turns[h:])
        for d in range(len(way) + 1):
            members[way[:d]].append(c)
            if d:
                children[way[: d - 1]].add(way[:d])
        ends[way].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (
            (
                min(ids),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(ids),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
            for node, ids in members.items()
        ),
        key=str,
    )


def odd_rows():
    """NULLs, ties, repeated rows, turnless, one very long and many equal conversations."""
    pick = random.Random(11)
    words = ["a", "b", "é中", "", None, "A", "long " * 3000]
    rows = []
    for c in [*range(-120, -95), *range(0, 40), 100, 101, *range(199, 340), 505]:
        for t in range(pick.choice([1, 2, 2, 3, 5, 8])):
            turn = pick.choice([t, t, t, None])
            rows.append((c, turn, pick.choice(["user", None, ""]), pick.choice(words), 1, "k", 2))
    rows += [(c, t, "user", "same", 1, "k", 2) for c in range(1000, 1060) for t in range(3)]
    rows += [(700, t, "user", f"t{t % 7}", 1, "k", 2) for t in range(300)]
    rows += [(705, t, "user", f"t{t % 7}", 1, "k", 2) for t in range(310)]
    rows += [(None, 1, "user", "none", 1, "k", 2), (None, None, None, None, None, None, None), rows[0], rows[0]]
    pick.shuffle(rows)
    return rows


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("band", [16, 3])
def test_nodes(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 7)
    rows = odd_rows()
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), band=band)
    assert rows_of(found) == brute(rows)


def test_as_they_are(spark):
    rows = odd_rows()[:400]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuilt=False)
    assert rows_of(found) == brute(rows, False)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.prefix_trie(table)) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # Conversation 1 opens with four turns of an absent conversation 0 and has two of its own.
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 >= 4)
    rows = [(c, 0, "user", "x", 1, "k", 1), (c, 1, "user", "y", 1, "k", 1)]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert brute(rows)[0][1:6] == (0, None, 1, 0, 1)
