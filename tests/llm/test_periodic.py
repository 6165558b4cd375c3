import hashlib
import random

import numpy as np
import pytest

from spindle.llm import periodic
from spindle.llm.periodic import active_tiles, find_runs, kept_words, primitive, solve_tile, word_ids, z_function
from spindle.llm.queries import REGISTRY, planted_words

SF = "/root/testdata/sf0.001"


def brute(words, least=6):
    """Maximal stretches of each period, shortest period first; one that a shorter period of the
    same stretch explains is none."""
    x, n, runs = word_ids(words), len(words), []
    for q in range(1, n // 4 + 1):
        eq = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for a, b in zip(eq[::2].tolist(), eq[1::2].tolist()):
            m = b - a + q
            if m >= max(least, 4 * q) and not any(q % p == 0 and s <= a and s + k >= a + m for s, k, p in runs):
                runs.append((a, m, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_text(r, bank):
    out = []
    for _ in range(r.randrange(1, 5)):
        root = r.choices(bank, k=r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 21, 40]))
        times = r.choice([1, 3, 4, 5, 9])
        out += root * times + root[: r.randrange(len(root))]
        out += r.choices(bank, k=r.randrange(12))
    return out


@pytest.fixture(params=[8, 64, 4096])
def tile(request, monkeypatch):
    """Small tiles, so that runs lie over many of them."""
    monkeypatch.setattr(periodic, "TILE_WORDS", request.param)
    return request.param


def runs_of(words):
    """The operator's steps without Spark: tiles, fragments, stitched."""
    ids = word_ids(words)
    found = {}
    for k, at, to in active_tiles(ids):
        raw = ids[at:to].astype("<i4").tobytes()
        for q, a, b in solve_tile(k, raw):
            found.setdefault(q, []).append((a + at, b + at))
    out = []
    for q, parts in found.items():
        done = []
        for a, b in sorted(parts):
            if done and a <= done[-1][1]:
                done[-1][1] = max(b, done[-1][1])
            else:
                done.append([a, b])
        out += [(a, b - a + q, q) for a, b in done if b - a + q >= max(6, 4 * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_steps_against_brute_force(tile):
    r = random.Random(tile)
    for n in range(400):
        words = some_text(r, [b"a", b"b", b"c"][: r.choice([1, 2, 3])] if n % 2 else [b"w%d" % i for i in range(30)])
        want = brute(words)
        assert runs_of(words) == want, words
        assert kept_words(words, want) == kept(words, want)


def test_long_runs(tile):
    r = random.Random(9)
    for q in (1, 3, 100, 257, 700):
        words = r.choices([b"x%d" % i for i in range(999)], k=q) * 6
        words = r.choices([b"x%d" % i for i in range(999)], k=r.randrange(500)) + words + [b"x1"] * 30
        assert runs_of(words) == brute(words)


def test_one_word_makes_tiles_of_one_octave():
    """A long stretch of period 1 wakes no tile of a larger period."""
    assert {k for k, *_ in active_tiles(word_ids([b"a"] * 50_000))} == {0}


def test_parts():
    assert z_function(list("aabaab")) == [0, 1, 0, 3, 1, 0]
    raw = np.array([1, 2, 1, 2, 1, 2, 3], "<i4").tobytes()
    assert not primitive(raw, 0, 6) and not primitive(raw, 0, 4) and primitive(raw, 0, 2) and primitive(raw, 1, 6)


def test_odd_rows(spark):
    texts = [None, "", " \t\n ", "a", "a b c", "a " * 6, "a b " * 4, "x\n" * 9000 + "y", "é b c " * 5 + "é", " ".join(f"w{i}" for i in range(50)) + " z" * 6]
    rows = [(None if n == 6 else n // 3, t, "c", n) for n, t in enumerate([*texts, texts[6]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, tiles int")
    got = sorted((None if r.doc_id is None else r.doc_id, bytes(r.words), [tuple(x) for x in r.runs], bytes(r.kept)) for r in find_runs(df).collect() if r.doc_id is not None)
    want = []
    for i, t, _, _ in rows:
        if i is not None:
            w = (t or "").encode().split()
            want.append((i, b" ".join(w), brute(w), b" ".join(kept(w, brute(w)))))
    assert got == sorted(want)
    assert find_runs(df.where("doc_id is null")).count() == 1
    assert find_runs(df.limit(0)).collect() == []


def test_query(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = planted_words(r.doc_id, (r.text or "").encode().split())
        runs = brute(words)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        text = b" ".join(kept(words, runs))
        sha = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), text)]
        want.append((r.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha))
    got = sorted(tuple(r) for r in REGISTRY["op13_periodic_runs"](spark, SF).collect())
    assert got == sorted(want)
    assert sum(x[1] > 0 for x in got) > 10
