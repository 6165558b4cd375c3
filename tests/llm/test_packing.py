import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import spindle.llm.packing as P
from spindle.llm.queries import REGISTRY, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True


def ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, texts, capacity=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        want = np.array(ids(texts[d]), "<u4")
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(-(-len(want) // capacity)))
        for k, p in enumerate(ps):
            part = want[k * capacity : (k + 1) * capacity]
            assert (p.start, p.length, p.ids_crc32) == (k * capacity, len(part), zlib.crc32(part.tobytes()))
    total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        total += at
    return len(by_seq), -(-total // capacity)


def test_query(spark, monkeypatch, sf="/root/testdata/sf0.001"):
    monkeypatch.setattr(P, "SHARD_ITEMS", 64)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = verify(REGISTRY["op2_packing"](spark, sf).collect(), texts)
    assert used <= least + 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tABaeiß019.,'s\x1ćÀΣ"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40))
def test_words_as_the_library(text):
    got = np.frombuffer(P.tokenizer(PATH).encode_many([text.encode()])[0], "<u4").tolist()
    assert got == ids(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_local_search_keeps_all(lens):
    start = P.best_fit(lens, 100)
    n, squares = len(start), sum(sum(lens[i] for i in b) ** 2 for b in start)
    bins = P.local_search(start, lens, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lens)))
    assert all(sum(lens[i] for i in b) <= 100 for b in bins) and len(bins) <= n
    assert sum(sum(lens[i] for i in b) ** 2 for b in bins) >= squares


def test_search_empties_a_bin():
    lens = [50, 50, 50, 30, 30, 30, 20, 20, 20]  # three bins of 100 exist; start from a bad packing
    assert len(P.local_search([[0, 1], [2, 3], [4, 5, 6], [7, 8]], lens, 100)) == 3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "wort " * 30000), (4, "ab c"), (4, "ab c")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, offset int")
    out = packed(df).collect()
    assert sum(r.length for r in out) == sum(len(ids(t)) for _, t in rows)
    assert packed(df.limit(0)).collect() == []


PLAIN = Tokenizer.from_file(PATH)  # as it comes, without a flag
LITERALS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "endoftext"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*LITERALS, " ", "\n", "\u0301", "Bar", "x", "'s", "\u00e9", "\u03a3", "9"]), max_size=12).map("".join))
def test_special_literals_as_the_plain_library(text):
    got = np.frombuffer(P.tokenizer(PATH).encode_many([text.encode()])[0], "<u4").tolist()
    assert got == PLAIN.encode(text, add_special_tokens=False).ids


def test_special_literals_in_rows(spark):
    texts = ["foo <|endoftext|> bar", "a<|startoftext|>b<|endoftext|>", "<|EndOfText|>", "<|endoftext|> " * 5000]
    want = [[*PLAIN.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert want[0] == [23435, 49407, 2411, 1]
    rows = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    cuts = [(d, a, w[a : a + 4096]) for d, w in enumerate(want) for a in range(0, len(w), 4096)]
    assert got == [(d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for d, a, part in cuts]


def test_search_goes_on_beyond_stuck_sources():
    lens = [35, 66, 64, 13, 13, 8]  # the emptiest bin is stuck until the next one has made an exchange
    assert len(P.local_search([[0], [1], [2, 3, 4, 5]], lens, 100, search_bins=1)) == 2


def test_rounds_go_on_while_they_free_bins(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 16)
    lens = np.random.default_rng(1).integers(1300, 1340, 150).tolist()  # three fill a bin, never full
    rows = P.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lens)], "doc_id long, length long")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lens)))
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in ps) <= 4096 for ps in fill.values())
    assert len(fill) <= 51, len(fill)


def test_blocks_and_long_texts(monkeypatch):
    """Blocks of a few bytes, texts over many blocks and words beyond a block give the same ids."""
    import random

    r = random.Random(11)
    bank = ["the", "river's", "Straße", "été", "x", "a-b", "12", "...", "ß!", "中文", "<|", "word" * 30, "\x1c", "naïve,"]
    texts = ["".join(r.choice(bank) + r.choice([" ", "\n", "\t ", " \r\n"]) for _ in range(r.randrange(80))) for _ in range(60)] + ["", " ", "z" * 300]
    raw = [t.encode() for t in texts]
    want = P.WordTokenizer(PATH).encode_many(raw)
    assert [np.frombuffer(w, "<u4").tolist() for w in want] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(P, "BLOCK_BYTES", 64)
    assert P.WordTokenizer(PATH).encode_many(raw) == want
    monkeypatch.setattr(P, "_powers", lambda n: (np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)))  # words of equal sums share a hash
    assert P.WordTokenizer(PATH).encode_many([b"ab ba", b"ab", b"ba ab ab"]) == [b"".join(x) for x in ([a, b], [a], [b, a, a])] if (a := P.tokenizer(PATH).encode_many([b"ab"])[0]) and (b := P.tokenizer(PATH).encode_many([b"ba"])[0]) else False


def test_part_cache_forgets_and_tells_parts_of_one_hash_apart(monkeypatch):
    texts = [" ".join(f"{a}{b}x" for a in "abcdefgh" for b in "ijklmnop").encode(), b"ba ab abx, abx. zz"] * 3
    want = P.WordTokenizer(PATH).encode_many(texts)
    monkeypatch.setattr(P, "CACHE_WORDS", 10)
    w = P.WordTokenizer(PATH)
    assert [w.encode_many([t])[0] for t in texts] == want and len(w.parts.key) < 80
    c, buf = P.PartCache(), np.frombuffer(b"abba", np.uint8)
    one = np.ones(1, np.int64)
    c.add(0 * one, np.array([5], np.uint64), buf, 0 * one, 2 * one, np.array([7, 8], np.uint32), 0 * one, 2 * one)
    assert c.find(np.array([5], np.uint64), buf, 0 * one, 2 * one)[1].tolist() == [True]
    assert c.find(np.array([5], np.uint64), buf, 2 * one, 2 * one)[1].tolist() == [False]  # "ba", of the same hash
    c.add(0 * one, np.array([5], np.uint64), buf, 2 * one, 2 * one, np.array([7, 8, 9], np.uint32), 2 * one, one)
    assert len(c.key) == 1


def test_texts_are_tokenized_once(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = P.token_pieces(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
