import re

import pytest

import corpus_pipeline as C
from spindle.llm.quality import train, with_score

from .test_packing import verify
from .test_secrets import brute as brute_secrets
from .test_simhash import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id: r.text for r in with_score(docs, model).collect() if r.score >= 0.5}
    rows = C.quality(spark, docs, SF)
    assert rows.columns == docs.columns
    assert {r.doc_id: r.text for r in rows.collect()} == want

    first = {}
    for i in sorted(want):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", want[i]), i)
    rows = C.exact_copies(spark, rows, SF)
    assert rows.columns == docs.columns
    want = {i: want[i] for i in first.values()}
    assert {r.doc_id: r.text for r in rows.collect()} == want

    rows = C.near_copies(spark, rows, SF)
    want = {i: want[i] for i in {c for _, c in brute_groups(list(want.items())).values()}}
    assert {r.doc_id: r.text for r in rows.collect()} == want

    rows = C.secrets(spark, rows, SF)
    assert rows.columns == docs.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert brute_secrets(r.text) == []
        assert r.n_chars == len(r.text)
        if not brute_secrets(want[i]):
            assert r.text == want[i]
    used, least = verify(C.packing(spark, rows, SF).collect(), {i: r.text for i, r in got.items()})
    assert used <= least + 2


def test_run_is_its_stages(spark):
    """``run`` over the table: the rows of the last stage, from what the stages before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r.doc_id: r.text for r in docs.collect()}
    used, least = verify(C.run(spark, SF).collect(), want)
    assert used <= least + 2


@pytest.mark.parametrize("few", [True, False])
def test_odd_rows(spark, monkeypatch, few):
    """Also columns with the names that the stages use themselves."""
    if not few:  # nothing is broadcast
        monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, __score string, n string, d string, s string, clean string, g string"
    rows = [(1, None), (1, None), (None, "a b"), (None, "x y z"), (2, "password=abcdefgh"), (2, "password=abcdefgh"), (3, "")]
    df = spark.createDataFrame([(i, t, None, None, len(t or ""), *("keep" + c for c in "rsndxcg")) for i, t in rows], schema)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert {(r["__row"], r["__score"], r["n"], r["d"], r["s"], r["clean"], r["g"]) for r in out.collect()} <= {tuple("keep" + c for c in "rsndxcg")}
    assert C.exact_copies(spark, df, SF).count() == 4
    assert sorted(r.text or "" for r in C.near_copies(spark, df, SF).collect()) == ["", "a b", "password=abcdefgh", "x y z"]
    assert sorted(r.text or "" for r in C.secrets(spark, df, SF).collect()) == ["", "", "", "<assign>", "<assign>", "a b", "x y z"]
    for name, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).collect() == [], name
