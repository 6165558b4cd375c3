import random
import re

import numpy as np
import public_tokenizers
import sentencepiece

from spindle.llm.fertility import BANDS, Band, Fertility, quality_rules, repeated_words, script_of
from spindle.llm.queries import REGISTRY

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
SF = "/root/testdata/sf0.001"


def brute(text):
    """The base counts by the contract's words, and the figures by the plain library."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)} if len(words) < 3000 else None
    ids = LIB.encode(t)
    n = len(ids)
    share = [ids.count(i) / n for i in set(ids)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": dup, "n_repeat_words": None if hit is None else len(hit), "n_tokens": n,
        "chars_per_token": len(t) / n if n else 0.0, "fallback_share": sum(3 <= i < 259 for i in ids) / n if n else 0.0,
        "token_entropy": -sum(p * np.log2(p) for p in share) if n else 0.0,
    }


def agree(row, text):
    for k, want in brute(text).items():
        if want is not None:
            assert abs(row[k] - want) < 1e-9, (k, row[k], want, (text or "")[:80])
    failed = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
    band = BANDS[row["script"]]
    good = band.chars_from <= row["chars_per_token"] <= band.chars_to and row["fallback_share"] <= band.fallback_to and row["token_entropy"] >= band.entropy_from
    assert row["base_failed"] == failed and row["kept"] == (not failed and good)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = REGISTRY["op12_fertility"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        agree(r, texts[r.doc_id])


def test_odd_rows(spark):
    r = random.Random(3)
    plain = " ".join(r.choice(["river", "stone", "walks", "under", "bright", "a", "of", "seven"]) for _ in range(90))
    texts = [None, "", " \t\n", "a b a b a b", "x" * 5000, plain, "中文 " * 60, "мир " * 60, "\x00\x01 " * 60, "<$%>\n<$%>\n", plain + "\n" + plain, " a  b\x1c c"]
    df = spark.createDataFrame([(None if i == 2 else i // 2, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, band string, kept int")
    rows = quality_rules(df, PATH).collect()
    assert len(rows) == len(texts)
    by_words = sorted(rows, key=lambda x: (x.n_tokens, x.word_chars))
    for row, text in zip(by_words, sorted(texts, key=lambda t: (brute(t)["n_tokens"], brute(t)["word_chars"]))):
        agree(row, text)
    assert quality_rules(df.limit(0), PATH).collect() == []


def test_bands_by_language(spark):
    text = " ".join(f"word{chr(97 + i % 26)} river{i} stands" for i in range(60))
    df = spark.createDataFrame([(1, text, "en"), (2, text, "de"), (3, text, None)], "doc_id long, text string, lang string")
    strict = {"de": Band(50.0, 60.0, 0.0, 0.0)}
    assert {r.doc_id: (r.kept, r.band) for r in quality_rules(df, PATH, lang="lang", bands=strict).collect()} == {1: (True, "latin"), 2: (False, "de"), 3: (True, "latin")}


def test_rejects_text_without_words(spark):
    r = random.Random(5)
    digits = " ".join("".join(r.choices("0123456789", k=12)) for _ in range(80))
    one = " ".join(["zq"] * 20 + [chr(97 + i % 26) + chr(97 + i // 26) for i in range(40)])
    damaged = " ".join("".join(r.choices("ກሀⲀඅa", k=6)) for _ in range(80))
    df = spark.createDataFrame([(1, digits), (2, damaged + " latin words here"), (3, one)], "doc_id long, text string")
    got = {x.doc_id: x for x in quality_rules(df, PATH, bands={"other": Band(0.2, 9.0, 0.5, 3.0)}).collect()}
    assert not got[2].kept and not got[2].base_failed and got[2].fallback_share > 0.5
    assert not got[1].base_failed and got[1].script == "none"


def test_pieces_count_as_the_whole():
    f, r = Fertility(PATH), random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["word", " ", "  ", "\n", "中", "été", "x", ". ", "\t"]) for _ in range(r.randrange(60)))
        assert (f.counts(t, size=7) == f.counts(t)).all(), repr(t)


def test_repeated_words():
    assert repeated_words([]) == 0 and repeated_words(list("abc")) == 0
    assert repeated_words(list("aaaa")) == 4 and repeated_words(list("abcxabc")) == 6
    r = random.Random(2)
    for _ in range(100):
        w = r.choices("abcd", k=r.randrange(40))
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert repeated_words(w) == len({k for i, x in enumerate(g) if g.count(x) > 1 for k in range(i, i + 3)})


def test_script_of():
    assert script_of("") == "none" and script_of("12 --") == "none"
    assert script_of("abc üß") == "latin" and script_of("αβ a") == "greek" and script_of("한국어") == "cjk"
