import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spindle.llm.bpe import Encoder, load_ranks
from spindle.llm.queries import REGISTRY

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENC = Encoder(PATH, PATTERN)
LIB = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def ids(texts):
    import numpy as np

    return [np.frombuffer(x, np.int32).tolist() for x in ENC.encode_many(texts)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t 'aeithséß019.,\x1c "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_as_the_library(text):
    assert ids([text])[0] == LIB.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000 + "  x", "é" * 777, "\n\n  \n a  b ", "1" * 999])
def test_long_and_odd(text):
    got = ids([text])[0]
    assert got == LIB.encode_ordinary(text)
    assert b"".join(ENC.tokens[t] for t in got) == text.encode()


def test_query(spark, sf="/root/testdata/sf0.001"):
    rows = REGISTRY["op1_byte_bpe"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = LIB.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
