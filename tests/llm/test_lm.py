"""The language model: base scores against a plain count, normalisation, held-out gain, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest

from lapsewatch.llm import lm, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in queries.op2_log_bilinear_scoring(spark, FOLDER).collect()}


def plain(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, [(i, held[i], len(ws), sum(counts[w] > 0 for w in ws),
                sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens]


def test_base(spark, found):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    n, want = plain(rows)
    for key, held, tokens, known, base in want:
        r = found[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-7)


def test_better_than_base_on_held_out(found):
    held = [r for r in found.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens
    print("gain in log10 a token", gain)
    assert gain > 0.15


def test_class_probabilities_add_up():
    frequency = np.full(lm.CLASSES, 1 / lm.CLASSES)
    table = lm.Parameters.fresh(frequency).log_table()
    assert np.allclose((10 ** table.astype(float)).sum(1), 1, atol=1e-4)


def test_draws_grow_with_the_share():
    assert lm.steps_of(1) == lm.steps_of(lm.STEPS * lm.PACE) == lm.STEPS
    assert lm.steps_of(10 * lm.STEPS * lm.PACE) == 10 * lm.STEPS


def test_noise_contrast_learns_a_rule():
    context = np.arange(10) * lm.WIDE + np.arange(10)
    of, n = np.arange(10) % 3 + 20, np.full(10, 5.0)
    frequency = np.bincount(of, n, lm.CLASSES) + 0.5
    frequency /= frequency.sum()
    flat = lm.Parameters.fresh(frequency).flat()
    for seed in range(4):
        flat = lm.train_share(flat, context, of, n, frequency, seed, 0.1)
    table = lm.Parameters.shaped(flat).log_table()
    assert (table[context].argmax(1) == of).all()


def test_small_vocabulary_known_to_tasks(spark, monkeypatch):
    rows = [(i, f"one two {'three' if i % 2 else 'four'} x{i % 7}.") for i in range(60)]
    rows += [(60, None), (61, ""), (62, "never seen"), (None, "one"), (63, "Ab " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int")
    from lapsewatch.llm.common import in_fold
    whole = sorted(lm.score(df, "doc_id", "text", in_fold("doc_id", 5, 1)).collect(), key=lambda r: r.doc_id or -1)
    monkeypatch.setattr(lm, "KNOWN", 3)
    few = sorted(lm.score(df, "doc_id", "text", in_fold("doc_id", 5, 1)).collect(), key=lambda r: r.doc_id or -1)
    n, want = plain(rows)
    by_key = {w[0]: w for w in want}
    for a, b in zip(whole, few):
        assert (a.n_tokens, a.n_known) == (b.n_tokens, b.n_known) == by_key[a.doc_id][2:4]
        assert a.base_score == pytest.approx(by_key[a.doc_id][4]) == b.base_score
        assert a.score == pytest.approx(b.score, rel=0.05) and a.score < 0
    assert lm.score(df.limit(0), "doc_id", "text", in_fold("doc_id", 5, 1)).count() == 0
