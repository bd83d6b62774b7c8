"""Near copies against brute force over all pairs of sets, with hot families and odd rows."""

import collections
import random

import numpy as np
import pytest

from lapsewatch.llm import neardup
from lapsewatch.llm.components import Union


def brute(rows):
    """The components of all similar pairs, by an index of shingles and exact counts."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    union, holders = Union(len(rows)), collections.defaultdict(list)
    for i, held in enumerate(sets):
        shared = collections.Counter(j for s in held for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(held) + len(sets[j]) - n):
                union.join(i, j)
        for s in held:
            holders[s].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        root = union.root(i)
        least[root] = min(least.get(root, key), key)
    return sorted((key, len(sets[i]), least[union.root(i)]) for i, (key, _) in enumerate(rows))


def family(random_, size, changes):
    words = [f"w{random_.randint(0, 10 ** 6)}" for _ in range(60)]
    out = []
    for _ in range(size):
        copy = list(words)
        for _ in range(random_.randint(0, changes)):
            copy[random_.randrange(60)] = f"x{random_.randint(0, 10 ** 6)}"
        out.append(" ".join(copy))
    return out


def test_against_brute_force(spark):
    random_ = random.Random(8)
    texts = [t for _ in range(60) for t in family(random_, random_.randint(1, 8), 4)]
    texts += family(random_, 150, 3) + ["Same  Text\there again for all"] * 70
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} " + " ".join(f"q{random_.random()}" for _ in range(80)) for _ in range(60)]
    texts += [None, "", " \n ", "one two", "ONE two", "one  two", "a b c d e", "é É", "é é", "long " * 30000]
    random_.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, class int")
    found = neardup.near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = neardup.near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(
        [(r.doc_id, r.text) for r in df.collect()])


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c"), (2, "d")], "doc_id bigint, text string")
    found = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in
                   neardup.near_duplicates(df, "doc_id", "text").collect())
    assert found == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True)]
    assert neardup.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_copies_of_one_original_and_a_common_passage(spark):
    random_ = random.Random(3)

    def fresh(n):
        return [f"y{random_.randrange(10 ** 9)}" for _ in range(n)]

    original, passage, texts = fresh(200), fresh(160), []
    for _ in range(400):  # 0.77 to the original, 0.61 to each other
        copy = list(original)
        for at in random_.sample(range(6, 190, 6), 5):
            copy[at] = fresh(1)[0]
        texts.append(" ".join(copy))
    texts.append(" ".join(original))
    for _ in range(150):  # in pairs 0.77, others 0.66
        more = fresh(16)
        texts += [" ".join(passage + more + fresh(24)) for _ in range(2)]
    random_.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = neardup.near_duplicates(df, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)


def test_copies_of_an_original_do_not_meet_each_other(spark, monkeypatch):
    """Copies that the first pivots leave alone are linked with the original, not compared with the family."""
    random_ = random.Random(400)
    original = [f"w{random_.randrange(10 ** 9)}" for _ in range(150)]
    texts = [" ".join(original)]
    for _ in range(400):
        copy = list(original)
        for at in random_.sample(range(150), random_.randint(0, 8)):
            copy[at] = f"x{random_.randrange(10 ** 9)}"
        texts.append(" ".join(copy))
    random_.shuffle(texts)
    rows, real, met = list(enumerate(texts)), neardup.across, []

    def counted(sets, known):
        met.append(real(sets, known))
        return met[-1]

    monkeypatch.setattr(neardup, "across", counted)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(rows)
    assert met[0].count() <= len(texts)


def test_centre_and_joined_components(spark):
    def held(*shingles):
        return np.array(sorted(shingles), np.uint64).tobytes()

    sets = spark.createDataFrame(
        [(1, held(1, 2, 3, 4, 9)), (2, held(1, 2, 3, 4)), (3, held(1, 2, 3, 8)), (4, held(2, 3, 4, 7)), (9, held(6)), (8, held(6, 7))],
        "class bigint, held binary")
    members = spark.createDataFrame([(c, 1) for c in (1, 2, 3, 4)], "class bigint, component bigint")
    assert [tuple(r) for r in neardup.centres(sets, members).collect()] == [(1, 2)]
    known = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node bigint, component bigint")
    links = spark.createDataFrame([(2, 6), (1, 2), (7, 8)], "a bigint, b bigint")
    found = sorted(tuple(r) for r in neardup.joined(known, links).collect())
    assert found == [(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 7)]
