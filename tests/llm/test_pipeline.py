"""The pipeline's stages against brute force on the smallest tables and on odd rows."""

import collections
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lapsewatch.llm import neardup
from test_neardup import brute
from test_pii import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity_only_drops_rows(stages):
    before, after = collections.Counter(rows_of(stages[0])), collections.Counter(rows_of(stages[1]))
    assert after <= before and 0 < sum(after.values())


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    kept = {i for i, n, component in brute(sorted(before.items())) if i == component}
    assert {r.doc_id for r in stages[2].collect()} == kept
    assert set(rows_of(stages[2])) <= set(rows_of(stages[1]))


def test_personal_data_goes(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    changed = 0
    for r in stages[3].collect():
        old = before[r.doc_id]
        assert r.n_chars == len(r.text) and not plain(r.text)
        changed += r.text != old.text
        if not plain(old.text) and r.text != old.text:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text)
    assert changed


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    length, places = collections.Counter(), collections.defaultdict(list)
    for r in stages[4].collect():
        length[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert length == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
                      for r in stages[3].collect()}
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_odd_rows(spark, tmp_path):
    for name in ("labels",):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(1, "a b c d e f", 11, "x"), (1, "a b c d e f", 11, "x"), (None, "a b c d e f", 11, "y"),
            (None, None, None, None), (None, None, None, None), (2, "", 0, "z"), (3, "mail me@x.org", 13, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, score string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, docs.collect()), key=key) == sorted(
        [(1, "a b c d e f", 11, "x"), (None, None, None, None), (None, None, None, None), (2, "", 0, "z"),
         (3, "mail [EMAIL]", 12, None)], key=key)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs.schema), str(tmp_path)).count() == 0


def test_texts_travel_in_small_batches(spark, monkeypatch):
    """While documents are scored an Arrow batch has few texts; the session's setting is as before afterwards."""
    from pyspark.sql import functions as F

    import corpus_pipeline
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def scorer(model):
        seen.append(int(spark.conf.get(name)))
        return lambda text: F.lit(0.0)

    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *a: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "scorer", scorer)
    before, folder = spark.conf.get(name), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == docs.count()
    assert seen == [1000] and spark.conf.get(name) == before


def test_copies_are_compared_with_their_original(spark, monkeypatch):
    """Of many copies of an original the stage keeps what brute force keeps, without pairs among the copies."""
    random_, real, met = random.Random(7), neardup.across, []
    original = [f"w{random_.randrange(10 ** 9)}" for _ in range(150)]
    texts = [" ".join(original)]
    for _ in range(300):
        copy = list(original)
        for at in random_.sample(range(150), random_.randint(0, 8)):
            copy[at] = f"x{random_.randrange(10 ** 9)}"
        texts.append(" ".join(copy))
    random_.shuffle(texts)

    def counted(sets, known):
        met.append(real(sets, known))
        return met[-1]

    monkeypatch.setattr(neardup, "across", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()}
    assert kept == {i for i, _, component in brute(list(enumerate(texts))) if i == component}
    assert met[0].count() <= len(texts)
