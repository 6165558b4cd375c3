import numpy as np
import pytest

import spindle.llm.exactdedup as X
from spindle.llm.exactdedup import build_mph, exact_dedup, summarise, with_digest

SCHEMA = "doc_id long, text string, digest int, keep_id string"


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 5000])
def test_perfect_and_minimal(n):
    digests = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    _, slots = build_mph(digests)
    assert sorted(slots) == list(range(n))


def test_groups_nulls_and_repeats(spark):
    rows = [(3, "a  b"), (1, "a b"), (1, "a b"), (2, None), (5, ""), (None, "x"), (7, "a\t\nb"), (9, "z" * 100000), (None, "x")]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()), key=repr)
    want = [(3, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 2, 2, True), (5, 2, 2, False), (None, None, 2, False)] + [(None, None, 2, False), (7, 1, 4, False), (9, 9, 1, True)]
    assert got == sorted(want, key=repr)


def test_hot_group_and_history(spark):
    old = spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, "t7" if i % 3 == 0 else f"n{i % 40}") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup(new, summarise(with_digest(old))).collect()}
    first = {}
    for i in range(300):
        first.setdefault(f"n{i % 40}", 1000 + i) if i % 3 else None
    assert got == {1000 + i: (7, False) if i % 3 == 0 else (first[f"n{i % 40}"], first[f"n{i % 40}"] == 1000 + i) for i in range(300)}


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("known", [True, False])
def test_no_group_of_probes_grows_with_the_rows(spark, monkeypatch, known):
    """Mid-sized groups of copies (no digest is hot), also with equal ids, in one shard."""
    real, most = X._probe, 400

    def probe(key, rows, index):
        assert len(rows) <= 2 * most, f"{len(rows)} rows in one group"
        return real(key, rows, index)

    monkeypatch.setattr(X, "_probe", probe)
    monkeypatch.setattr(X, "PROBE_ROWS", most, raising=False)
    docs = spark.createDataFrame([(i % 3000 if i % 2000 else 7, f"t{i % 2000}") for i in range(8000)], "doc_id long, text string")
    past = None if known else summarise(with_digest(docs.limit(10)))
    out = exact_dedup(docs, past).collect()
    ids = {}
    for i in range(8000):
        ids.setdefault(f"t{i % 2000}", []).append(i % 3000 if i % 2000 else 7)
    want = sorted((d, min(g), len(g)) for g in ids.values() for d in g)
    if known:
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    else:
        assert sorted(r.doc_id for r in out) == [d for d, _, _ in want]
