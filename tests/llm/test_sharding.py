"""Shards: equal bytes within the tolerance, gapless slots, copies side by side, odd tables."""

import collections
import random
import zlib

import pytest

from lapsewatch.llm import sharding


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_near_equal_bytes(spark, hot):
    random.seed(5)
    rows = [(i, "copy " * 20 if random.random() < hot else f"text {i} " * random.randint(0, 30), 1)
            for i in range(4000)]
    rows += [(9001, None, 1), (9002, "", 1), (9003, "long " * 2000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    found = sharding.shard(df, "doc_id", "text", 8).collect()
    texts = {i: (t or "").encode() for i, t, _ in rows}
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8))
    mean, longest = sum(sizes.values()) / 8, max(r.size for r in found)
    assert max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + longest
    placed = [texts[r.doc_id] for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert 1 + sum(a != b for a, b in zip(placed, placed[1:])) == len(set(placed))  # copies side by side
    for taken in slots.values():
        assert sorted(taken) == list(range(len(taken)))


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, "a")], "doc_id bigint, text string")
    found = sharding.shard(df, "doc_id", "text", 24).collect()
    assert len(found) == 4 and all(0 <= r.shard < 24 for r in found)
    assert len({r.shard for r in found if r.doc_id == 1}) == 1
    assert sharding.shard(df.limit(0), "doc_id", "text").count() == 0


def test_splitters_against_a_sort(spark):
    random.seed(8)
    rows = [(random.choice([7, random.getrandbits(63) - 2**62]), random.getrandbits(63) - 2**62, random.randint(1, 900))
            for _ in range(3000)]
    cuts, n = sharding.splitters(spark.createDataFrame(rows, "high bigint, low bigint, size bigint"), 8)
    keys = sorted((sharding._number(h, low), size) for h, low, size in rows)
    total = sum(size for _, size in keys)
    assert n == 3000 and len(cuts) == 7 and cuts == sorted(cuts)
    for i, cut in enumerate(cuts, 1):
        below = sum(size for k, size in keys if k < cut)
        assert abs(below - total * i / 8) <= max(sharding.TOLERANCE * total / 8, 900)


def test_missing_splitters_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROUNDS", 1)
    rows = [(i * 1000, i, 10 + i % 7) for i in range(500)]
    with pytest.raises(RuntimeError):
        sharding.splitters(spark.createDataFrame(rows, "high bigint, low bigint, size bigint"), 8, 1e-6)
