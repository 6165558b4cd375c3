import hashlib
import random
import zlib

import numpy as np
import pytest

from spindle.llm import prefixtrie
from spindle.llm.prefixtrie import Parens, numbered_turns, prefix_trie
from spindle.llm.queries import rebuilt_turns


def brute(paths):
    """paths: {conv: [(role, text), ...]}"""
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for k, convs in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(k))
        children = sum(len(x) == len(k) + 1 for x in below)
        out.append((min(convs), len(k), min(nodes[k[:-1]]) if k else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    """Turns by conversation, ties by digest."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos int, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def some_rows(r, convs, turns, words=3):
    return [(c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "é", *(f"text {k}" for k in range(words))])) for c in range(convs) for t in range(r.randrange(1, turns))]


@pytest.fixture(params=[(512, 200_000), (4, 11)])
def sizes(request, monkeypatch):
    """Also shards of a few nodes and chunks of a few turns."""
    monkeypatch.setattr(prefixtrie, "CHUNK", request.param[0])
    monkeypatch.setattr(prefixtrie, "SHARD_NODES", request.param[1])


def test_against_brute_force(spark, sizes):
    r = random.Random(4)
    rows = some_rows(r, 60, 8, words=1)
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(5)]  # one conversation, copied
    rows += [(200, t, "user", "same") for t in range(11)] + [(201, None, "user", "first"), (201, 0, "user", "x"), (201, 0, "user", "x"), (None, 0, "user", "lost")]
    convs = ordered(rows)
    turns = numbered_turns(frame(spark, rows))
    got = prefix_trie(turns, turns.select("conv"))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(convs)


def test_rebuilt(spark):
    r = random.Random(5)
    rows = some_rows(r, 43, 10, words=2)
    rows = [x for x in rows if x[0] not in (5, 20)]
    want = rebuilt(ordered(rows))
    assert any(not v for v in want.values())  # turnless ones too
    got = prefix_trie(*rebuilt_turns(frame(spark, rows)))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(want)


def test_empty(spark):
    assert prefix_trie(*rebuilt_turns(frame(spark, []))).collect() == []


def test_positions_over_partitions(spark):
    rows = [(c, t, "user", f"{t}") for c, n in ((1, 3), (2, 4000), (3, 2)) for t in range(n)]
    got = numbered_turns(frame(spark, rows)).collect()
    assert sorted((x.conv, x.pos) for x in got) == [(c, t) for c, t, *_ in rows]
    digest = {(c, t): hashlib.md5(f"4:user{t}".encode()).digest() for c, t, *_ in rows}
    assert all(bytes(x.digest) == digest[x.conv, x.pos] for x in got)


def test_parens():
    r = random.Random(6)
    for n in (1, 5, 100, 3000):
        bits, depth = [], 0
        for _ in range(n):
            if depth and r.random() < 0.48:
                bits.append(0)
                depth -= 1
            else:
                bits.append(1)
                depth += 1
        bits += [0] * depth
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert Parens(np.array(bits, np.uint8)).findclose(at).tolist() == [close[i] for i in at.tolist()]
