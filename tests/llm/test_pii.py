"""Personal data: base spans against a plain reading of the patterns, added spans, redaction."""

import hashlib
import random
import re

import pytest

from lapsewatch.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 // 10 + v * 2 % 10 for i, v in enumerate(values)) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items()
            for m in re.finditer(p, text or "") if holds(k, m.group())]


def texts():
    random.seed(9)
    alphabet = ["a", "b.", "@", ".", "-", " ", "1", "23", "255", "+", "(", ")", "é", "\U0001F600", "x@y.z",
                "4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "+1 (017) 555-7713", "_", "%"]
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    made += [None, "", "9" * 30000, "a" * 30000, "a." * 5000 + "@" + "b." * 5000 + "c", "1 " * 9000,
             "a@b.c_x@d.e é 1.2.3.4 " * 400]
    return made


def test_base(spark):
    made = texts()
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string").repartition(4)
    rows = {r.doc_id: r for r in pii.spans(df, "doc_id", "text").collect()}
    assert len(rows) == len(made)
    for i, text in enumerate(made):
        want = plain(text)
        assert rows[i].base == ",".join(want), repr(text)
        assert set(want) <= set(rows[i].spans.split(",")) or not want
        counts = [rows[i][f"n_{k}"] for k in pii.KINDS]
        assert counts == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts_of = {r.doc_id: r.text for r in df.collect()}
    for r in pii.spans(df, "doc_id", "text").collect():
        digest = hashlib.sha256(",".join(plain(texts_of[r.doc_id])).encode()).hexdigest()
        assert hashlib.sha256(r.base.encode()).hexdigest() == digest


def test_added_spans_and_redaction(spark):
    rows = [(1, "mail ann [at] home [dot] org or call (415) 555-0134 now", "en"),
            (2, "é ip 10.0.0.1, x@y.com; card 4111 1111 1111 1111!", "en"),
            (3, None, "en"), (4, "version 1.2, nothing here", None), (4, "version 1.2, nothing here", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    found = {r.doc_id: r.spans for r in pii.spans(df, "doc_id", "text").collect()}
    assert found[1] == "email:5:28,phone:37:51" and found[4] == ""
    out = sorted((r.doc_id, r.text) for r in pii.redact(df, "text").collect())
    assert out[1][1] == "é ip [IP], [EMAIL]; card [CARD]!"
    assert out[0][1] == "mail [EMAIL] or call [PHONE] now"
    assert out[2][1] is None and out[3] == out[4] == (4, rows[3][1])
    assert pii.spans(df.limit(0), "doc_id", "text").count() == 0


def test_reliability_is_recovered():
    random.seed(1)
    counts = {}
    for _ in range(4000):
        true = random.random() < 0.5
        votes = "".join("y" if (random.random() < (0.95 if i < 3 else 0.5)) == true else "n" for i in range(4))
        counts["email", votes] = counts.get(("email", votes), 0) + 1
    model = pii.estimate(counts)
    assert min(model.reliability["email", "pattern"]) > 0.9
    assert max(abs(r - 0.5) for r in model.reliability["email", "cue"]) < 0.1
    assert model.probability("yyyn") > 0.5 > model.probability("nnny")
