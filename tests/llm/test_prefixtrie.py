"""The prefix trie against brute force, at every band height, with long conversations and hard rows."""

import hashlib
import random
import zlib

import pytest

from filelake.llm import prefixtrie as P


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        inner = {x[:-1] for x in below if len(x) > len(node)}
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == node)))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(x[:-1] == node and len(x) == len(node) + 1 for x in below), sum(x not in inner for x in below),
            sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize(("band", "block", "piece"), [(16, 1024, 1 << 16), (2, 3, 4), (3, 1, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, band, block, piece):
    for name, value in (("BAND", band), ("BLOCK", block), ("PIECE", piece)):
        monkeypatch.setattr(P, name, value)
    rnd, rows = random.Random(4), []
    for c in range(40):
        rows += [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "bé", None])) for t in range(rnd.choice([1, 2, 3, 9, 12]))]
    rows += [(60 + k, t, "user", f"long {t}") for k in (0, 1, 3) for t in range(45)]  # one long path
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "user", "no conversation"), (101, 0, None, None)]
    rnd.shuffle(rows)
    turns = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, place string, a int")
    got = [tuple(r) for r in P.prefix_trie(*P.rebuilt_turns(turns)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.prefix_trie(*P.rebuilt_turns(empty)).count() == 0


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, "user", "x" * 2000 if t == 5 else "same") for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    places = [r.place for r in P.numbered_turns(turns).orderBy("place").collect()]
    assert places == [*range(3000)]
