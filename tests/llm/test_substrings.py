import hashlib
import random
from collections import Counter

import pytest

from spindle.llm.queries import REGISTRY
from spindle.llm.substrings import levels, remove_repeats


def brute(rows, w):
    words = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (i, _), x in zip(rows, words):
        gone = set()
        for a in range(len(x) - w + 1):
            if n[tuple(x[a : a + w])] > 1:
                gone.update(range(a, a + w))
        out.append((i, len(x), len(gone), b" ".join(v for k, v in enumerate(x) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("w", [5, 12, 35])
def test_brute_force(spark, w):
    r = random.Random(w)
    bank = [f"w{i}" for i in range(300)]
    passages = [" ".join(r.choices(bank, k=n)) for n in (w - 1, w, w + 1, 2 * w, 3 * w + 7)]
    rows = []
    for i in range(120):
        parts = [" ".join(r.choices(bank, k=r.randrange(0, 2 * w))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passages))
        rows.append((i, r.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "a " * 100), (203, "é " * (w - 1)), (None, rows[3][1]), (3, rows[3][1]), (3, "other words"), (204, "x y " * 20000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, off int")
    got = sorted((tuple(x) for x in remove_repeats(df, window=w).collect()), key=repr)
    assert got == brute(rows, w)
    assert remove_repeats(df.limit(0), window=w).collect() == []


def test_levels():
    assert levels(35) == [9, 18, 35] and levels(5) == [5] and levels(12) == [6, 12]


def test_query(spark, sf="/root/testdata/sf0.001"):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows, 35)]
    assert sorted((tuple(x) for x in REGISTRY["op4_substrings"](spark, sf).collect()), key=repr) == sorted(want, key=repr)
