"""Packing: ids against the tokenizer, the plan's bounds, and rows that tile every sequence."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lapsewatch.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=30))
def test_plan_fills_without_overlap(counts):
    runs, where = packing.plan(counts, 50), collections.defaultdict(list)
    for length, n in counts.items():
        rows = np.array(runs[length])
        for rank in range(n):
            first, each, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            where[sequence + (rank - first) // each].append(
                (offset + length * ((rank - first) % each), length))
    assert sum(map(len, where.values())) == sum(counts.values())
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50
    bound = -(-sum(k * v for k, v in counts.items()) // 50)
    assert len(where) <= 1.7 * bound + 1


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(tokenizer):
    texts = ["It's  A\tcafé\n\n1234", "É é ́x", "<|endoftext|> a", "", None, "ΑΣ ΑΣ　x", "İI", "Don't stop, it's 'quoted.", "(hi) a1, ÉTÉ!! über%%% x.y.",
             "Straße; ǅ &&& a*b* ÀB́,", "x<|endoftext|>y, <|ENDOFTEXT|>abc <|startoftext|>abc! <|EndOfText|>.",
             "  <|endoftext|><|endoftext|>\n<|endof text|> end<|", " ", "\n\n"]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts), PATH)):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_slices_and_empty_batches(tokenizer):
    texts = pa.array([None, "a b", "", "c  d\ne", None, "a b"])
    whole = packing.token_ids(texts, PATH)
    assert packing.token_ids(texts.slice(1, 3), PATH) == whole[1:4]
    assert packing.token_ids(texts.slice(0, 0), PATH) == [] and packing.token_ids(pa.array([None, ""]), PATH) == [b"", b""]


def test_rows(spark, tokenizer):
    texts = [None, "", "a b c", "a b c", "word " * 5000, "x " * 1200, "y " * 900, "z " * 30]
    df = spark.createDataFrame([(i // 2 * 2, t, 9) for i, t in enumerate(texts)],
                               "doc_id bigint, text string, offset int")
    packed = packing.pack_texts(df, "doc_id", "text", PATH, with_ids=True)
    rows = packed.collect()
    want = collections.Counter()
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start:start + 2048], "<u4").tobytes()
            want[(i // 2 * 2, piece, start, len(part) // 4, zlib.crc32(part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {r.sequence_id: bytes(r.ids) for r in packing.assemble(packed).collect()}
    for r in rows:
        at = 4 * r.offset
        assert sequences[r.sequence_id][at:at + 4 * r.length] == bytes(r.ids)
    assert sum(map(len, sequences.values())) == 4 * sum(r.length for r in rows)
    assert packing.pack_texts(df.limit(0), "doc_id", "text", PATH).count() == 0
