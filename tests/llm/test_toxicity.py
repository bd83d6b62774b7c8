"""Toxicity: the automaton against a distance table, context, held-out accuracy, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lapsewatch.llm import toxicity


def distance(a, b):
    rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def test_automaton():
    random.seed(1)
    for _ in range(5000):
        terms = ["".join(random.choice("abc") for _ in range(random.randint(2, 6))) for _ in range(2)]
        word = "".join(random.choice("abc") for _ in range(random.randint(1, 7)))
        assert toxicity.Trie(terms).within_one(word) == any(distance(word, t) <= 1 for t in terms)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(4)
    plain = ["the", "red", "house", "walks", "over", "green", "water", "and", "sings"]
    rows, labels = [], []
    for i in range(800):
        words = [random.choice(plain) + str(random.randint(0, 40)) * (random.random() < 0.3) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(random.randint(0, 40), random.choice(["idiot", "worthless", "stupid"]) + ".")
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(toxic)))
    odd = [(801, None, 1.0), (802, "", 1.0), (803, "such a worthles and stupidd idoit you are", 1.0),
           (804, 'the house has a sign, it said "no idiot here" over the red water', 1.0),
           (805, "w" * 100000 + " the " * 20000, 1.0), (805, "the", 1.0)]
    return (spark.createDataFrame(rows + odd, "doc_id bigint, text string, score double"),
            spark.createDataFrame(labels + [(0, None), (1, 7), (None, 1)], "doc_id bigint, toxic int"))


def test_learns_and_scores(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels.where("doc_id % 5 <> 0 or doc_id is null"), "doc_id", "text", "toxic")
    assert model.words == {"idiot", "worthless", "stupid"}
    found = {(r.doc_id, r.n): r.s for r in docs.select(
        "doc_id", F.length("text").alias("n"), toxicity.scorer(model)("text").alias("s")).collect()}
    assert len(found) == docs.count()
    by_id = {i: s for (i, _), s in found.items()}
    assert all((by_id[i] >= 0.5) == (i % 4 == 0) for i in range(800))
    assert by_id[803] >= 0.5 and by_id[804] < 0.5 and max(by_id[801], by_id[802], by_id[805]) < 0.5


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.learn(docs, some, "doc_id", "text", "toxic")
        assert docs.where(toxicity.scorer(model)("text") >= 0.5).count() == 0


def test_held_out_accuracy(spark):
    from lapsewatch.llm import queries
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    rows = queries.op3_lexicon_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    print(caught, wrong)
    assert caught >= 0.7 and wrong <= 0.02
