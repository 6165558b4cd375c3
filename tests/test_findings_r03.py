"""Findings of round 3: work and shuffles that grew faster than the input."""

from pyspark.sql import functions as F

from spindle.operators import keyphrases as kp

from .conftest import SF_SMALL

STOPS = "lang string, term string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyphrases_deal_out_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "Ein Haus am See. Das Haus steht", "de"), (None, "lost", "de")], "doc_id long, text string, lang string")
    stops = spark.createDataFrame([("de", "das")], STOPS)
    top = kp.top_candidates(kp.keyphrase_candidates(docs, "doc_id", "text", "lang", stops), "doc_id")
    plan = _plan(top)
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert "SortMergeJoin" not in plan
    assert {r["doc_id"] for r in top.collect()} == {1}


def test_keyphrase_parts_grow_with_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "wort " * 100) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(kp, "PART_BYTES", 1000)
    assert kp.text_parts(docs, "text") == 20
    assert kp.text_parts(docs.where("doc_id < 0"), "text") == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_keyphrases_of_a_key_in_two_languages(spark):
    docs = spark.createDataFrame([(1, "das haus", "de"), (1, "das haus", "en")], "doc_id long, text string, lang string")
    stops = spark.createDataFrame([("de", "das")], STOPS)
    got = {r["phrase"]: r["tf"] for r in kp.keyphrase_candidates(docs, "doc_id", "text", "lang", stops).collect()}
    assert got == {"haus": 2, "das": 1, "das haus": 1}


def test_token_lists_are_parsed_in_one_scan(spark):
    from spindle.plans.catalog import REGISTRY

    plan = _plan(REGISTRY["parse_token_lists"](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1


def test_list_types_that_hide_a_null_or_another_type(spark):
    from spindle.functions.jsonlist import parse_string_list

    want = {
        '["a",null]': ("reject", None), "[null]": ("reject", None), "[]": ("ok", []), '["a",[]]': ("reject", None), '["a","b"]': ("ok", ["a", "b"]),
        "['a']": ("null", None), '["a"': ("null", None), "null": ("null", None), "7": ("reject", None),
    }
    df = spark.createDataFrame([(k,) for k in want], "lemmas string")
    # the name of the result equals that of the column, as in normalised rows
    p = parse_string_list("lemmas")
    got = df.select(F.col("lemmas").alias("j"), p["value"].alias("lemmas"), p["state"].alias("state"), parse_string_list("lemmas")["state"].alias("again")).collect()
    assert {r["j"]: (r["state"], r["lemmas"]) for r in got} == want
    assert all(r["state"] == r["again"] for r in got)


def test_keywords_are_counted_once_a_row(spark):
    from spindle.operators.keywords import with_keywords

    df = spark.createDataFrame([(1, ["b", "a", "b", "c"], None), (2, None, None), (3, ["x"], ["l", "l"])], "id long, tokens array<string>, lemmas array<string>")
    kw = with_keywords(df, 2)
    assert _plan(kw).count("ArrowEvalPython") == 1
    assert {r["id"]: [tuple(k) for k in r["keywords"]] for r in kw.collect()} == {1: [("b", 2), ("a", 1)], 2: [], 3: [("l", 2)]}
    assert {r["id"]: r["keyword_summary"] for r in kw.collect()} == {1: "b a", 2: None, 3: "l"}
