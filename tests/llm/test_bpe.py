"""Byte-level BPE against the public library, and the exact round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lapsewatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                            special_tokens={})


@pytest.fixture(scope="module")
def chunks():
    return bpe.coder(RANKS, public_tokenizers.PATTERN)


def ids(text, chunks):
    return np.frombuffer(bpe.encode_texts([text], chunks)[0], "<u4").tolist()


def test_random_texts(chunks):
    random.seed(3)
    letters = " \n\t　\x1c\x85 abé'sll12 ü漢字\U0001F600.,  \r​"
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 25)))
        assert ids(text, chunks) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "ab" * 5000, " " * 3000, "a" * 4001, "\n\n a \n", "<|endoftext|>"])
def test_long_and_odd(chunks, text):
    assert ids(text, chunks) == LIBRARY.encode_ordinary(text)


def test_scalar_and_rows_agree():
    pieces = [b"ththnded", b"\xff\xfe\xfd", b"a", b"zz" * 16, b"worthlessness"]
    found = bpe.Merger(RANKS).ids(pieces)
    for piece in pieces:
        assert np.frombuffer(found[piece], "<u4").tolist() == bpe.merge(piece, RANKS)


def test_frame_with_nulls_and_repeats(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "It's\n\ncafé  1234 ", 5), (3, "It's\n\ncafé  1234 ", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = bpe.decode(bpe.encode(df, "doc_id", "text", PATH, public_tokenizers.PATTERN), PATH)
    found = sorted(((r.doc_id or 0), r.n_tokens, bytes(r.decoded)) for r in out.collect())
    texts = sorted(((i or 0), len(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert found == texts
    assert bpe.encode(df.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
