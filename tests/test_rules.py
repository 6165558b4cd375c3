"""Column rules against plain-Python models of the reference's behaviour."""

import json
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.functions.jsonlist import parse_string_list
from spindle.functions.ranking import with_top_frequencies
from spindle.functions.text import keyword_language, non_blank
from spindle.functions.topics import topic_display_name


def _most_common(tokens, n):
    return [(k, c) for k, c in Counter(tokens).most_common(n)] if tokens else []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(list("abcdefg")), st.text("xyz", min_size=1, max_size=2)), max_size=40), min_size=1, max_size=8))
def test_top_frequencies_matches_counter(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, toks array<string>")
    got = with_top_frequencies(df, F.col("toks"), 3, "kw").orderBy("id").collect()
    for row, toks in zip(got, lists):
        assert [(k["keyword"], k["frequency"]) for k in row["kw"]] == _most_common(toks, 3)


def test_top_frequencies_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "id int, toks array<string>")
    got = {r["id"]: r["kw"] for r in with_top_frequencies(df, F.col("toks"), 10, "kw").collect()}
    assert got == {1: [], 2: []}


def test_right_to_left_text_with_diacritics(spark):
    lemmas = ["بُسْتَان", "قَمَر", "بُسْتَان", "نَهْر", "جَبَل", "قَمَر", "شَجَرَة", "طَرِيق", "سَمَاء", "زَهْرَة", "حَجَر", "رِيح", "مَطَر"]
    df = spark.createDataFrame([(1, lemmas)], "id int, toks array<string>")
    kw = with_top_frequencies(df, F.col("toks"), 10, "kw").first()["kw"]
    assert [(k["keyword"], k["frequency"]) for k in kw] == _most_common(lemmas, 10)


def test_blank_rule_matches_python_strip(spark):
    samples = ["", "  ", "\t\n", " ", " x", "\x1c\x1d\x1e\x1f", "　", "a", " b ", "\x85", "​"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["nb"] for r in df.select(non_blank("t").alias("nb")).collect()]
    assert got == [bool(s.strip()) for s in samples]
    assert spark.createDataFrame([(None,)], "t string").select(non_blank("t")).first()[0] is None


def _py_parse(text):
    """Reference behaviour: json.loads; malformed -> no list; not a list of str -> reject."""
    if text is None:
        return "null", None
    try:
        v = json.loads(text)
    except json.JSONDecodeError:
        return "null", None
    if v is None:
        return "null", None
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        return "reject", None
    return "ok", v


def test_strict_list_parsing(spark):
    cases = [None, "", "[]", '["a"', '["a",1]', '["a","b"]', "null", '"a"', "{}", '[null]', '["a",null]',
             "[1.5]", '[["a"]]', '["\\u00e9"]', "[true]", ' ["x"] ']
    # known departures from Python's parser (trailing text, NaN) are left out on purpose
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = df.select(parse_string_list(F.col("j")).alias("p")).collect()
    for c, r in zip(cases, got):
        state, value = _py_parse(c)
        assert r["p"]["state"] == state, c
        assert (list(r["p"]["value"]) if r["p"]["value"] is not None else None) == value, c


def test_strict_list_parsing_known_departure(spark):
    """Text after a complete list is ignored by the variant parser (Python rejects it as malformed)."""
    r = spark.createDataFrame([("[]]",)], "j string").select(parse_string_list(F.col("j")).alias("p")).first()
    assert r["p"]["state"] == "ok"


def _py_name(tid, name, terms):
    if name is not None:
        default = name.startswith(f"{tid}_") and all(p for p in name.split("_")[1:])
        if not default:
            return name
    if terms:
        return f"{tid}_" + "_".join(terms[:3])
    return f"Topic {tid}"


def test_topic_name_rule(spark):
    cases = [(3, "3_Costs", ["a", "b", "c", "d"]), (3, "3__x", ["a"]), (3, "3_", ["a"]), (3, None, ["a", "b"]),
             (3, None, []), (-1, "-1_outliers", []), (4, "Custom", ["a"]), (5, "5_a_b", ["q", "r", "s"]),
             (12, "1_x", ["t"]), (7, "7_x_", ["u"])]
    df = spark.createDataFrame(cases, "tid int, name string, terms array<string>")
    got = [r[0] for r in df.select(topic_display_name(F.col("tid"), F.col("name"), F.col("terms"))).collect()]
    assert got == [_py_name(*c) for c in cases]


def test_keyword_language_rule(spark):
    df = spark.createDataFrame([("de",), ("eng",), (None,), ("",)], "l string")
    got = [r[0] for r in df.select(keyword_language("l")).collect()]
    assert got == ["de", "en", "en", "en"]
